"""Operators along an order within groups, in which no group is one task's, however many of all rows it has.

Rows are dealt out by ranges of (group, order), each range is worked on by itself, and a range's last row or sums are
carried over its border into the group's next one. What is carried is a row for each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.sources.tables import cut

PART = "_range"


def _last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def ranged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df dealt out by ranges of columns, nulls last, with its range's number as PART. Written and read again, since a
    number is only right for the ranges that were drawn then."""
    return cut(df.repartitionByRange(*_last(columns)).withColumn(PART, F.spark_partition_id()))


def along(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lags: Mapping[str, str] | None = None) -> DataFrame:
    """df with new columns. sums: name -> the sum of a column over the rows of the group up to and with this one, null
    counting nothing. lags: name -> the value of a column in the row before, null in a group's first.

    Null keys form a group, and nulls come last in the order, which must be total within a group. Runs a job that writes
    df once, dealt out by (group, order): a group with half of all rows is spread over half of the ranges.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    rows = ranged(df.withColumns({f"_add_{n}": c for n, c in sums.items()}), [*groups, *order])
    place = Window.partitionBy(PART, *groups).orderBy(*_last(order))
    to_here, by_range = place.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*groups).orderBy(PART)
    sort_key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    ends = [F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums] + [F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lags.items()]), sort_key).alias("_end")] * bool(lags)
    ranges = rows.groupBy(PART, *groups).agg(F.count(F.lit(1)).alias("_n"), *ends)
    before = [F.sum(f"_sum_{n}").over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}") for n in sums]
    carried = [F.lag("_end").over(by_range).alias("_carried")] if lags else []
    # a range continues at most one group, so these are at most as many rows as there are ranges
    borders = ranges.select(PART, *groups, *before, *carried, F.row_number().over(by_range).alias("_nth")).where("_nth > 1").withColumnsRenamed({c: f"_border_{c}" for c in (PART, *groups)})
    met = F.col(PART) == F.col(f"_border_{PART}")
    for g in groups:
        met = met & F.col(g).eqNullSafe(F.col(f"_border_{g}"))
    inside = {f"_in_{n}": F.sum(f"_add_{n}").over(to_here) for n in sums} | {f"_in_{n}": F.lag(c).over(place) for n, c in lags.items()} | {"_first": F.row_number().over(place) == 1}
    joined = rows.withColumns(inside).join(F.broadcast(borders), met, "left")
    new = [F.when(F.col(f"_in_{n}").isNull(), F.col(f"_before_{n}")).otherwise(F.col(f"_in_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums]
    new += [F.when(F.col("_first"), F.col(f"_carried.{n}")).otherwise(F.col(f"_in_{n}")).alias(n) for n in lags]
    return joined.select(*df.columns, *new)


def add_lag(df: DataFrame, value: str, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """As relational.add_lag, the previous available row's value, for groups of any size; runs a job."""
    return along(df, groups, order, lags={name: value})


def places(df: DataFrame, columns: Sequence[str], name: str = "place") -> DataFrame:
    """df with each row's place from 1 on in the order of columns, nulls last; ties in any order. No task sees all rows."""
    rows = cut(df.orderBy(*_last(columns)).withColumns({PART: F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(PART, F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each range
    in_range = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), PART).select(*df.columns, (F.col("_start") + in_range + 1).alias(name))
