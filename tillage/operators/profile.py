"""Data-quality profile: one pass over the data for each report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.operators.ordered import along
from tillage.sources.tables import cut, release


#: Kinds whose values are whole numbers, or become them without two becoming one.
_WHOLE = {
    **{k: lambda c: c.cast("long") for k in ("tinyint", "smallint", "int", "bigint", "boolean")},
    "date": lambda c: F.unix_date(c).cast("long"),
    "timestamp": lambda c: F.unix_micros(c),
}
#: Values that a bitmap covers, and bytes that it takes; bytes that a value by itself takes in an exchange.
_BITMAP_VALUES, _BITMAP_BYTES, _VALUE_BYTES = 32768, 4096, 24


def _dense(df: DataFrame, whole: dict[str, Column]) -> dict[str, tuple[int, int]]:
    """Of columns of whole numbers, (rows, nulls) of those whose values take less room as bitmaps. One pass."""
    if not whole:
        return {}
    asked = [f(v).alias(f"{name}{i}") for i, v in enumerate(whole.values()) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("d", F.approx_count_distinct))]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *asked).first()
    out = {}
    for i, c in enumerate(whole):
        low, high = seen[f"lo{i}"], seen[f"hi{i}"]
        if low is not None and ((high - low) // _BITMAP_VALUES + 2) * _BITMAP_BYTES < seen[f"d{i}"] * _VALUE_BYTES:
            out[c] = (seen["rows"], seen["rows"] - seen[f"n{i}"])
    return out


def _bitmap_profile(df: DataFrame, whole: dict[str, Column], counts: dict[str, tuple[int, int]]) -> DataFrame:
    """The rows of column_profile for dense columns: a bitmap for each 32768 values in a row, which tasks combine."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), whole[c].alias("v")) for c in counts]))
    values = df.select(pairs.alias("x")).select("x.column_name", "x.v").where("v is not null")
    bits = values.groupBy("column_name", F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    found = bits.groupBy("column_name").agg(F.sum(F.bitmap_count("bits")).alias("distinct_values"))
    missing = F.create_map(*[F.lit(x) for c, (_, k) in counts.items() for x in (c, k)])[F.col("column_name")]
    rows = F.create_map(*[F.lit(x) for c, (n, _) in counts.items() for x in (c, n)])[F.col("column_name")]
    return found.select("column_name", missing.cast("long").alias("missing"), (missing.cast("double") / rows).alias("missing_ratio"), "distinct_values")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: nulls, null ratio (null for an empty table) and exact distinct values (null not counted,
    0.0 and -0.0 one value).

    Values are counted by (column, value) first, so that the distinct count is two combinable aggregations and no
    task ever holds a set of values. Values go as whole numbers, floating ones or strings, by their type. Columns of
    whole numbers that lie close together by their range and about how many they are, which a first pass tells, go as
    bitmaps.
    """
    if not columns:
        raise ValueError("no columns to profile")
    kinds = dict(df.dtypes)
    whole = {c: _WHOLE[kinds[c]](F.col(c)) for c in columns if kinds[c] in _WHOLE}
    dense = _dense(df, whole)
    parts = [_bitmap_profile(df, whole, dense)] if dense else []
    if others := [c for c in columns if c not in dense]:
        parts.append(_value_profile(df, others, kinds, whole))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _value_profile(df: DataFrame, columns: Sequence[str], kinds: dict[str, str], whole: dict[str, Column]) -> DataFrame:
    """The rows of column_profile by values of their own types; one of w, r and t holds a value."""
    empty = {"w": F.lit(None).cast("long"), "r": F.lit(None).cast("double"), "t": F.lit(None).cast("string")}

    def typed(c: str) -> Column:
        if c in whole:
            value = {"w": whole[c]}
        elif kinds[c] in ("double", "float"):
            value = {"r": F.col(c).cast("double") + F.lit(0.0)}  # no sign on zero
        else:
            value = {"t": F.hex(c) if kinds[c] == "binary" else F.col(c).cast("string")}
        return F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in (empty | value).items()])

    by_value = df.select(F.explode(F.array(*map(typed, columns))).alias("x")).groupBy("x.column_name", "x.w", "x.r", "x.t").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    seeded = by_value.unionByName(names.select("column_name", *[v.alias(k) for k, v in empty.items()], F.lit(0).cast("long").alias("n")))
    is_null = F.col("w").isNull() & F.col("r").isNull() & F.col("t").isNull()
    nulls = F.sum(F.when(is_null, F.col("n")).otherwise(0))
    return seeded.groupBy("column_name").agg(
        nulls.cast("long").alias("missing"),
        F.try_divide(nulls.cast("double"), F.sum("n")).alias("missing_ratio"),
        F.count_if(~is_null).alias("distinct_values"),
    )


#: A quantile sketch errs by one in so many of all ranks at most.
ACCURACY = 10_000
#: Distinct values near wanted ranks that the driver may pick from; beyond, ranks are found by running sums.
FEW = 100_000


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _sketched(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int) -> list[dict]:
    """One pass: n, mean, std, min and max of each column, and values on either side of each quantile."""
    sides = [min(1.0, max(0.0, p + side / accuracy)) for p in probabilities for side in (-2, 2)]
    aggs = []
    for i, c in enumerate(columns):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        aggs += [F.percentile_approx(x, sides, accuracy).alias(f"sides{i}")] if sides else []
    row = df.agg(*aggs).first().asDict()
    return [{k: row.get(f"{k}{i}") for k in ("n", "mean", "std", "min", "max", "sides")} for i in range(len(columns))]


def _picked(df: DataFrame, columns: Sequence[str], stats: list[dict], probabilities: Sequence[float], accuracy: int, few: int) -> list[list[float | None]]:
    """A second pass: how many values lie below each quantile's bracket, and how often each value inside occurs."""
    brackets, wanted = {}, {}
    for i, s in enumerate(stats):
        for j, p in enumerate(probabilities if s["n"] else ()):
            place = p * (s["n"] - 1)
            wanted[i, j] = (math.floor(place), math.ceil(place), place)
            exact = s["n"] <= accuracy  # then a bracket could miss the neighbour, and all values are few
            brackets[i, j] = (s["min"] if exact or p <= 2 / accuracy else s["sides"][2 * j], s["max"] if exact or p >= 1 - 2 / accuracy else s["sides"][2 * j + 1])
    found: dict[tuple[int, int, int], float] = {}
    while brackets:
        entry = lambda i, j, x, low, high: F.when(x <= high, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(x >= low, x + F.lit(0.0)).alias("x")))  # noqa: E731 - no sign on zero
        entries = F.array(*[entry(i, j, _number(columns[i]), F.lit(low), F.lit(high)) for (i, j), (low, high) in brackets.items()])
        counts = cut(df.select(F.inline(F.array_compact(entries))).groupBy("i", "j", "x").agg(F.count(F.lit(1)).alias("n")))
        below = {(i, j): 0 for i, j in brackets} | {(r.i, r.j): r.n for r in counts.where("x is null").collect()}
        inside = counts.where("x is not null")
        sizes = {(r.i, r.j): (r.n, r.rows) for r in inside.groupBy("i", "j").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
        ranks = {(i, j, k - below[i, j]): k for i, j in brackets for k in wanted[i, j][:2]}
        if sum(rows for _, rows in sizes.values()) <= few:
            run = {}
            for r in inside.orderBy("i", "j", "x").collect():
                start = run.get((r.i, r.j), 0)
                run[r.i, r.j] = start + r.n
                found.update({(r.i, r.j, k): r.x for k in wanted[r.i, r.j][:2] if start <= k - below[r.i, r.j] < start + r.n})
        else:
            summed = along(inside, ["i", "j"], ["x"], sums={"upto": F.col("n")})
            asked = F.broadcast(df.sparkSession.createDataFrame([(i, j, k) for i, j, k in ranks], "i int, j int, k long"))
            for r in summed.join(asked, ["i", "j"]).where("upto - n <= k and k < upto").collect():
                found[r.i, r.j, ranks[r.i, r.j, r.k]] = r.x
        release(counts)
        missed = {ij for ij in brackets if any((*ij, k) not in found for k in wanted[ij][:2])}  # no sketch errs so far; if one did, all values decide
        brackets = {(i, j): (stats[i]["min"], stats[i]["max"]) for i, j in missed if brackets[i, j] != (stats[i]["min"], stats[i]["max"])}
    out = []
    for i, s in enumerate(stats):
        if not s["n"]:
            out.append([None] * len(probabilities))
            continue
        ends = [(found[i, j, wanted[i, j][0]], found[i, j, wanted[i, j][1]], wanted[i, j][2] % 1) for j in range(len(probabilities))]
        out.append([low if low == high else low + share * (high - low) for low, high, share in ends])
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY, few: int = FEW) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of each column's values, null and NaN left out; None for a column without any.

    Two passes for any number of columns: mergeable sketches give a bracket around each wanted rank, then what is below
    is counted, and the values inside are counted one by one. A bracket holds some 4 / accuracy of the rows; if that is
    more than `few` distinct values, running sums over ranges of them find the ranks, else the driver does.
    """
    stats = _sketched(df, columns, probabilities, accuracy)
    return dict(zip(columns, _picked(df, columns, stats, probabilities, accuracy, few)))


DESCRIBED = "column_name string, n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"


def describe_columns(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """count, mean, std (n-1), min, interpolated quartiles and max of each column, exact, in two passes for all of them;
    null and NaN are left out."""
    stats = _sketched(df, columns, [0.25, 0.5, 0.75], accuracy)
    middle = _picked(df, columns, stats, [0.25, 0.5, 0.75], accuracy, few)
    return df.sparkSession.createDataFrame([(c, s["n"], s["mean"], s["std"], s["min"], *q, s["max"]) for c, s, q in zip(columns, stats, middle)], DESCRIBED)


def describe(df: DataFrame, column: str, accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """describe_columns of one column, as one row."""
    return describe_columns(df, [column], accuracy, few).drop("column_name")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows for each value, ordered by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(column).asc_nulls_last())


def group_bounds(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows and bounds of column for each group; bounds of an empty group are null."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns); runs one job."""
    return df.count(), len(df.columns)
