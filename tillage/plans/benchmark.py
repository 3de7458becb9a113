"""The model benchmark: three baselines, ridge and a tree; fitted on train, scored on validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage import schemas as S
from tillage.operators import relational as R
from tillage.operators.metrics import metrics_table
from tillage.operators.models import Preprocessor, fit_ridge, fit_tree
from tillage.operators.profile import describe_columns


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical); never the target, nor Production, from which the target is made."""
    return R.existing(df, [S.YEAR, "Area", S.LAG, *S.WEATHER_COLUMNS]), R.existing(df, S.ENTITY_COLUMNS)


def separate(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(features, target), rows in the same order of the same plan."""
    return R.project(df, features), R.project(df, [label])


def naive(train: DataFrame, label: str, lag: str) -> dict[str, Column]:
    """The three baselines as expressions over constants of the train rows; runs jobs."""
    found = describe_columns(train, [label]).first()
    mean, middle = found["mean"], found["q50"]
    mean, middle = (F.lit(x).cast("double") for x in (mean, middle))
    return {"train_mean": mean, "train_median": middle, "historical": F.coalesce(F.col(lag).cast("double"), middle)}


def baselines(train: DataFrame, validation: DataFrame, label: str, lag: str) -> DataFrame:
    return metrics_table(validation, label, naive(train, label, lag))


def run(train: DataFrame, validation: DataFrame, label: str = S.TARGET, lag: str = S.LAG, numeric: list[str] | None = None, categorical: list[str] | None = None) -> DataFrame:
    """model, mae, rmse, r2, best first. The test split isn't an argument: nothing here can read it.

    All five models predict in one pass over the validation rows, and are scored by one aggregation.
    """
    found = feature_columns(train)
    train = train.persist()
    try:
        prep = Preprocessor(found[0] if numeric is None else numeric, found[1] if categorical is None else categorical).fit(train)
        fitted = prep.transform(train).persist()
        try:
            ridge, tree = fit_ridge(fitted, label, width=prep.width), fit_tree(fitted, label)
        finally:
            fitted.unpersist()
        constants = naive(train, label, lag)
    finally:
        train.unpersist()
    held = tree.transform(ridge.transform(prep.transform(validation), prediction="_ridge"), prediction="_tree")
    return metrics_table(held, label, {**constants, "ridge": "_ridge", "tree": "_tree"})
