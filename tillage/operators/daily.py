"""Daily observations -> season features (an extension: the thresholds are parameters)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.operators.ordered import along


def season_features(daily: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = (), day_counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Sum, mean and counts of days that meet a condition for each key, combined on the map side."""
    aggs = [F.sum(c).alias(f"{c}_sum") for c in sums] + [F.avg(c).alias(f"{c}_mean") for c in means]
    aggs += [F.count_if(cond).alias(name) for name, cond in (day_counts or {}).items()]
    return daily.groupBy(*keys).agg(*aggs)


def longest_spell(daily: DataFrame, keys: Sequence[str], day: str, condition: Column, name: str = "longest_spell", spread: bool = False) -> DataFrame:
    """Longest run of consecutive days that meet the condition, 0 if none does. day is a date; repeats count once.

    Null keys are keys like others; a row without a day is on no day, though its key still counts. spread numbers the
    days of a series by running sums over ranges, so that a long series is no single task's; runs a job.
    """
    days = daily.groupBy(*keys, day).agg(F.bool_or(F.coalesce(condition, F.lit(False)) & F.col(day).isNotNull()).alias("_hit"))
    if spread:
        days = along(days, [*keys, "_hit"], [day], sums={"_nth": F.lit(1)}).withColumn("_nth", F.col("_nth").cast("int"))
    else:
        days = days.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_hit").orderBy(day)))
    island = F.when(F.col("_hit"), F.date_sub(F.col(day), F.col("_nth")))
    runs = days.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count_if("_hit").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").cast("long").alias(name))


def flag(condition: Column) -> Column:
    """0/1 as double; an unknown condition stays null."""
    return condition.cast("double")
