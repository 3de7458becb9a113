"""DataFrame -> DataFrame operators. Each is lazy unless its docstring names an action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    """df itself, or ValueError; looks at metadata only."""
    if absent := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {absent}")
    return df


def project(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    return require_columns(df, names, what).select(*names)


def has_columns(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names that df has, in the order given."""
    return [c for c in names if c in df.columns]


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows without a null in any of names (NaN counts as missing). Plain conjuncts: they are pushed into scans and turn outer joins inner."""
    kinds = dict(df.dtypes)
    for c in names:
        known = F.col(c).isNotNull()
        df = df.where(known & ~F.isnan(c) if kinds.get(c) in ("double", "float") else known)
    return df


def within(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Both ends included; null is outside. Above a scan this is a pushed filter."""
    return df.where(F.col(column).between(low, high))


def distinct_rows(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Whole-row distinct with nulls equal. With an ordinal column each kept row carries its first ordinal."""
    if ordinal is None:
        return df.distinct()
    data = [c for c in df.columns if c != ordinal]
    return df.groupBy(*data).agg(F.min(ordinal).alias(ordinal)).select(*df.columns)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by a total order, nulls equal as keys.

    The order is the caller's: Spark has no row order of its own. min_by over a struct combines on the map side,
    so a hot key costs one row per task, where a window would sort all of its rows in one.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ordering = F.struct(*[F.struct(c.isNull() if isinstance(c, Column) else F.col(c).isNull(), c) for c in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_row"))
    return kept.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def distinct_tuples(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """One row: number of distinct tuples, those with nulls included."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias(name))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; runs one job and raises ValueError if a key repeats."""
    if found := repeated_keys(df, keys).take(1):
        raise ValueError(f"keys are not unique: {found[0].asDict()}")
    return df


def once_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, whose rows raise an error where they are read if their key repeats; nulls are equal. No job of its own: rows
    are counted by key in the exchange that brings them together, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row"))
    said = F.concat(F.lit("keys are not unique: "), F.to_json(F.struct(*keys)))
    checked = counted.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    return checked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def join_features(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool | str = False) -> DataFrame:
    """Left join on null-safe equal keys, many to one; key columns appear once.

    No broadcast hint: the planner and AQE broadcast the right side when its measured size allows, else they
    sort-merge and split skewed partitions of the left. validate=True first checks (a job) that right keys are unique;
    validate="in run" makes the join's own run fail if they aren't.
    """
    if validate == "in run":
        right = once_by_key(right, keys)
    elif validate:
        assert_unique(right, keys)
    l, r = left.alias("l"), right.alias("r")
    condition = None
    for k in keys:
        equal = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        condition = equal if condition is None else condition & equal
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, condition, "left").select("l.*", *added)


def missing_ratio(df: DataFrame, column: str, name: str = "missing_ratio") -> DataFrame:
    return df.agg(F.avg(F.col(column).isNull().cast("double")).alias(name))


def add_lag(df: DataFrame, value: str, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Value of the previous available row of the group (not of the previous year), null for the first.

    Null group keys form a group; null values pass through. order must be total (end it with an ordinal or key).
    """
    window = Window.partitionBy(*groups).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(name, F.lag(value, 1).over(window))


def split_label(year: Column, splits: Sequence[tuple[str, int, int]]) -> Column:
    """Name of the split that holds the year, null outside all of them."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(splits):
        label = F.when(year.between(low, high), F.lit(name)).otherwise(label)
    return label


def sorted_nulls_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def head(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows by an order (TakeOrderedAndProject); Spark has no head of an unordered table."""
    return sorted_nulls_last(df, columns).limit(n)
