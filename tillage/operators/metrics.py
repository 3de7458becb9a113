"""Regression metrics as one combinable aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics_table(df: DataFrame, label: str, predictions: Mapping[str, str | Column]) -> DataFrame:
    """A row (model, mae, rmse, r2) for each prediction, best mean absolute error first; all of them in one pass over df.

    r2 is about the mean of the labels. A constant label gives r2 of 1 for an exact fit and 0 else. Rows with a null
    label or prediction don't count for that model; with none left its metrics are null.
    """
    y = F.col(label).cast("double")
    both = {name: (F.col(p) if isinstance(p, str) else p).cast("double") for name, p in predictions.items()}
    frame = df.select(y.alias("y"), *[p.alias(f"p{i}") for i, p in enumerate(both.values())])
    aggs = []
    for i in range(len(both)):
        known = F.col("y").isNotNull() & F.col(f"p{i}").isNotNull()
        error = F.col("y") - F.col(f"p{i}")
        aggs += [F.avg(F.abs(error)).alias(f"mae{i}"), F.avg(error * error).alias(f"mse{i}"), F.count_if(known).alias(f"n{i}"), F.var_pop(F.when(known, F.col("y"))).alias(f"var{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(f"{c}{i}").alias(c) for c in ("mae", "mse", "n", "var")]) for i, name in enumerate(both)]))
    found = frame.agg(*aggs).select(rows.alias("x")).select("x.*")
    r2 = F.when(F.col("var") > 0, F.lit(1.0) - F.try_divide("mse", "var")).when(F.col("mse") == 0, F.lit(1.0)).when(F.col("n") > 0, F.lit(0.0))
    return found.select("model", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2")).orderBy("mae", "model")


def regression_metrics(df: DataFrame, model: str, label: str, prediction: str | Column) -> DataFrame:
    """The row of one model."""
    return metrics_table(df, label, {model: prediction})
