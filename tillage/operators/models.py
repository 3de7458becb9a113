"""Statistics fitted on train rows, and the estimators that use them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.operators.ordered import along, places
from tillage.operators.profile import quantiles
from tillage.sources.tables import cut, release


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of exact medians (midpoint for an even count); runs jobs."""
    found = quantiles(df, columns, [0.5])
    return df.sparkSession.range(1).select(*[F.lit(found[c][0]).cast("double").alias(c) for c in columns])


def impute(df: DataFrame, fill: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of columns become the value in the one-row frame fill (a scalar join of one row)."""
    renamed = fill.agg(*[F.any_value(c).alias(f"_fill_{c}") for c in columns])  # one row, whatever fill is
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(renamed)).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent non-null value, the smallest among ties. Counts combine on the map side."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(1).select(column)


def population_scales(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of population deviations, 1 where a column is constant or empty."""
    return df.agg(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(c) for c in columns])


def scale(df: DataFrame, scales: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the deviations of the one-row frame scales, without centring."""
    renamed = scales.agg(*[F.any_value(c).alias(f"_scale_{c}") for c in columns])  # one row, whatever scales is
    scaled = {c: F.col(c) / F.col(f"_scale_{c}") for c in columns}
    return df.crossJoin(F.broadcast(renamed)).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """level, code: the distinct non-null values, numbered from 0 in their order. Numbers come from counts of a range
    sort's parts, so no task and no driver holds all levels."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    return cut(places(levels, ["level"], "code").select("level", (F.col("code") - 1).alias("code")))


#: A feature row: place and value of the features that aren't 0.
ENTRIES = "array<struct<i:bigint,x:double>>"
#: Features up to which rows are made dense, for the vector `features` and the normal equations.
DENSE = 512


@dataclass
class Preprocessor:
    """Median-impute and scale numerics, mode-impute and one-hot categoricals; fitted on train rows only.

    Numerics are divided by their population deviation, 1 where that is 0, without centring. A category that train
    rows don't have gets no indicator. Places: the numerics, then each categorical's levels in their order.
    """

    numeric: Sequence[str]
    categorical: Sequence[str]

    def fit(self, train: DataFrame) -> Preprocessor:
        middle = quantiles(train, self.numeric, [0.5]) if self.numeric else {}
        self.median_ = {c: 0.0 if middle[c][0] is None else float(middle[c][0]) for c in self.numeric}
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.median_[c])).alias(c) for c in self.numeric])
        scales = population_scales(filled, self.numeric).first() if self.numeric else {}
        self.scale_ = {c: scales[c] for c in self.numeric}
        self.mode_, self.levels_, self.start_, self.width = {}, {}, {}, len(self.numeric)
        for c in self.categorical:
            mode = most_frequent(train, c).first()
            self.mode_[c], self.levels_[c], self.start_[c] = mode[0] if mode else "", dictionary(train, c), self.width
            self.width += self.levels_[c].count()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `entries`, and up to DENSE features also with the vector `features`. A categorical's codes are joined;
        the planner broadcasts a dictionary if it is small."""
        out = df
        for k, c in enumerate(self.categorical):
            codes = self.levels_[c].select(F.col("level").alias(f"_level{k}"), F.col("code").alias(f"_code{k}"))
            out = out.join(codes, F.coalesce(F.col(c), F.lit(self.mode_[c])) == F.col(f"_level{k}"), "left").drop(f"_level{k}")
        numbers = [(F.lit(k).cast("long"), F.coalesce(F.col(c).cast("double"), F.lit(self.median_[c])) / F.lit(self.scale_[c])) for k, c in enumerate(self.numeric)]
        flags = [(F.col(f"_code{k}") + self.start_[c], F.when(F.col(f"_code{k}").isNotNull(), F.lit(1.0))) for k, c in enumerate(self.categorical)]
        kept = [F.when(x != 0, F.struct(i.alias("i"), x.alias("x"))) for i, x in numbers + flags]
        out = out.withColumn("entries", F.array_compact(F.array(*kept)).cast(ENTRIES) if kept else F.array().cast(ENTRIES)).drop(*[f"_code{k}" for k in range(len(self.categorical))])
        if self.width > DENSE:
            return out
        at = F.map_from_entries("entries")
        dense = [F.coalesce(F.try_element_at(at, F.lit(k).cast("long")), F.lit(0.0)) for k in range(self.width)]
        return out.withColumn("features", array_to_vector(F.array(*dense).cast("array<double>")))


def centred(df: DataFrame, features: str = "features") -> tuple[list[float], DataFrame]:
    """The means of a vector column, and df with that column less its means: the same model but for its intercept, and
    normal equations that a column of large mean and small deviation doesn't spoil."""
    means = df.select(Summarizer.mean(F.col(features)).alias("m")).first().m
    shift = F.array(*[F.lit(float(x)) for x in means])
    return list(means), df.withColumn(features, array_to_vector(F.zip_with(vector_to_array(features), shift, lambda x, m: x - m)))


class Ridge:
    """A linear model over features whose means were taken off for fitting."""

    def __init__(self, coefficients: list[float], intercept: float):
        self.coefficients, self.intercept = coefficients, intercept

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        if features not in df.columns:
            weights, start = F.split(F.lit(",".join(map(repr, self.coefficients))), ",").cast("array<double>"), F.lit(float(self.intercept))  # one literal, folded once
            return df.withColumn(prediction, F.aggregate("entries", start, lambda total, e: total + e.x * F.get(weights, e.i.cast("int"))))
        terms = F.zip_with(vector_to_array(features), F.array(*map(F.lit, self.coefficients)), lambda x, w: x * w)
        return df.withColumn(prediction, F.aggregate(terms, F.lit(float(self.intercept)), lambda total, x: total + x))


def fit_ridge(train: DataFrame, label: str, alpha: float = 1.0, width: int | None = None) -> Ridge:
    """sum of squares + alpha * |w|^2 with a free intercept. Spark divides by n and scales by the label's deviation.

    Constant features get no weight under the penalty; they are left out, as they spoil the normal equations. Rows
    without the vector `features`, which are too wide for these, are fitted from their `entries` by conjugate gradients.
    """
    if "features" not in train.columns:
        return fit_ridge_sparse(train, label, alpha, width)
    s = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    means, shifted = centred(train)
    spread = shifted.select(Summarizer.variance(F.col("features")).alias("v")).first().v
    kept = [i for i, x in enumerate(spread) if x > 1e-12]
    own = F.array(*[F.element_at(vector_to_array("features"), i + 1) for i in kept])
    penalty = alpha * (s["s"] or 1.0) / max(s["n"], 1)
    model = LinearRegression(featuresCol="features", labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=penalty).fit(shifted.withColumn("features", array_to_vector(own)))
    weights = [0.0] * len(means)
    for i, w in zip(kept, model.coefficients):
        weights[i] = float(w)
    return Ridge(weights, model.intercept - sum(w * m for w, m in zip(weights, means)))


#: Bytes of a weight vector that may be sent to each task.
MAX_WEIGHTS = 64 << 20


def fit_ridge_sparse(train: DataFrame, label: str, alpha: float = 1.0, width: int | None = None, tolerance: float = 1e-11, rounds: int = 1000) -> Ridge:
    """The same model by preconditioned conjugate gradients on the normal equations, over rows of `entries`.

    A round is a pass: each task multiplies its rows with the vector and adds up their transposed products, which are
    summed by place. Rows stay where they are, written once; the driver holds vectors of `width` numbers, of which the
    one that is broadcast has at most MAX_WEIGHTS bytes. Means are taken off in the products, not in the rows.
    """
    spark = train.sparkSession
    rows = cut(train.where(F.col(label).isNotNull()).select(F.col("entries.i").alias("i"), F.col("entries.x").alias("x"), F.col(label).cast("double").alias("y")))
    width = 1 + (rows.agg(F.max(F.array_max("i"))).first()[0] or 0) if width is None else width
    if width * 8 > MAX_WEIGHTS:
        raise ValueError(f"{width} features are more than a task can be sent weights of ({MAX_WEIGHTS} bytes)")
    n, mean_y = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("y"), F.lit(0.0))).first()
    by_place = rows.select("y", F.inline(F.arrays_zip("i", "x"))).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("x") * (F.col("y") - mean_y)).alias("b"))
    sums, squares, b = np.zeros(width), np.zeros(width), np.zeros(width)
    for r in by_place.toLocalIterator():
        sums[r.i], squares[r.i], b[r.i] = r.s, r.q, r.b
    means = sums / max(n, 1)
    scale = 1 / (np.maximum(squares - n * means * means, 0) + alpha)  # of the preconditioner

    def product(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                at, x = batch.column(0), batch.column(1)
                i, x, ends = at.flatten().to_numpy(), x.flatten().to_numpy(), np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(len(ends)), ends)
                t = np.bincount(row, x * sent.value[i], len(ends))
                total += np.bincount(i, x * t[row], width)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.float64())], names=["i", "g"])

        out = np.zeros(width)
        for r in rows.select("i", "x").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toLocalIterator():
            out[r.i] = r.g
        sent.unpersist()
        return out - n * means * (means @ v) + alpha * v

    w, r = np.zeros(width), b.copy()
    z = scale * r
    p, rz, end = z.copy(), r @ z, tolerance * np.linalg.norm(b)
    for _ in range(rounds):
        if np.linalg.norm(r) <= end:
            break
        ap = product(p)
        step = rz / (p @ ap)
        w, r = w + step * p, r - step * ap
        z = scale * r
        rz, last = r @ z, rz
        p = z + (rz / last) * p
    release(rows)
    return Ridge([float(x) for x in w], float(mean_y - w @ means))


#: Levels of a tree: its nodes, up to twice 2 to this power, are sent to each task.
MAX_DEPTH = 18
#: A node whose labels vary by a smaller part of their squares than this is pure. Gains are compared to as many digits.
PURE, DIGITS = 1e-12, 12


class Tree:
    """Nodes by number: the root is 1, the children of k are 2k (a feature at most its threshold) and 2k + 1."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature, self.threshold, self.value = np.full(2 << depth, -1, np.int64), np.zeros(2 << depth), np.zeros(2 << depth)

    def descend(self, entries: pa.ListArray) -> np.ndarray:
        """The node that each row comes to, all rows a level at a time; a feature without an entry is 0."""
        flat, n = entries.flatten(), len(entries)
        i, x = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        width = 1 + max(int(i.max(initial=0)), int(self.feature.max()))
        key = np.repeat(np.arange(n), np.diff(entries.offsets.to_numpy())) * width + i
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, x = key[order], x[order]
        key, x = np.append(key, np.iinfo(np.int64).max), np.append(x, 0.0)
        node, rows = np.ones(n, np.int64), np.arange(n)
        for _ in range(self.depth):
            feature = self.feature[node]
            wanted = rows * width + feature
            at = np.searchsorted(key, wanted)
            value = np.where(key[at] == wanted, x[at], 0.0)
            node = np.where(feature >= 0, 2 * node + (value > self.threshold[node]), node)
        return node

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        tree, names = df.sparkSession.sparkContext.broadcast(self), df.columns
        at = names.index("entries")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.value[tree.value.descend(b.column(at))], pa.float64())], names=[*names, prediction])

        kept = [c for c in names if c != "features"]  # a vector, of which entries tell the same
        df = df.select(*kept)
        names, at = kept, kept.index("entries")
        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(prediction, T.DoubleType())]))


#: Rows of a node that one task may finish; larger nodes are split by passes over all rows.
LOCAL_ROWS = 200_000


def _best_split(i: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, s: float, leaf: int, total: float) -> tuple[int, float] | None:
    """(feature, threshold) of a node of n rows whose labels sum to s, from its entries that aren't 0: y is that of the
    entry's row. By the same rule as the passes."""
    features, at = np.unique(i, return_inverse=True)
    seen, seen_s = np.bincount(at, minlength=len(features)), np.bincount(at, y, len(features))
    add = np.flatnonzero(seen < n)
    i, x = np.append(i, features[add]), np.append(x, np.zeros(len(add)))
    cn, cs = np.append(np.ones(len(y)), n - seen[add]), np.append(y, s - seen_s[add])
    order = np.lexsort((x, i))
    i, x, cn, cs = i[order], x[order], cn[order], cs[order]
    new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (x[1:] != x[:-1])) if len(i) else np.zeros(0, bool))
    i, x, cn, cs = i[new], x[new], np.add.reduceat(cn, new) if len(new) else cn, np.add.reduceat(cs, new) if len(new) else cs
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    ln, ls = np.cumsum(cn) - cn, np.cumsum(cs) - cs  # over all features
    size = np.diff(np.append(first, len(i)))
    ln, ls = ln - np.repeat(ln[first], size), ls - np.repeat(ls[first], size)
    fair = np.flatnonzero((ln >= leaf) & (n - ln >= leaf) & (ln > 0))
    if not len(fair):
        return None
    ln, ls, t = ln[fair], ls[fair], (x[fair - 1] + x[fair]) / 2
    gain = np.round((ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n) / total, DIGITS)
    best = np.lexsort((t, i[fair], -gain))[0]
    return int(i[fair][best]), float(t[best])


def _finish(rows: pd.DataFrame, depth: int, leaf: int, total: float) -> pd.DataFrame:
    """All nodes below one, from its rows' entries (rid, y, i, x; i is null for a row without any)."""
    ids, first, row = np.unique(rows["rid"].to_numpy(), return_index=True, return_inverse=True)
    labels = rows["y"].to_numpy()[first]
    has = rows["i"].notna().to_numpy() & (rows["x"].to_numpy() != 0)
    i, x, row = rows["i"].to_numpy()[has].astype(np.int64), rows["x"].to_numpy()[has], row[has]
    out, waiting = [], [(int(rows["node"].iloc[0]), np.arange(len(ids)), np.arange(len(i)))]
    while waiting:
        node, own, entries = waiting.pop()
        y = labels[own]
        n, s, q = len(y), y.sum(), (y * y).sum()
        split = None
        if node < 1 << depth and n >= 2 * leaf and q - s * s / n > PURE * q:
            split = _best_split(i[entries], x[entries], labels[row[entries]], n, s, leaf, total)
        out.append((node, *(split or (-1, 0.0)), s / n))
        if split:
            value = np.zeros(len(ids))
            hit = entries[i[entries] == split[0]]
            value[row[hit]] = x[hit]
            right = value > split[1]
            for k, side in ((2 * node, ~right), (2 * node + 1, right)):
                waiting.append((k, own[side[own]], entries[side[row[entries]]]))
    return pd.DataFrame(out, columns=["node", "feature", "threshold", "value"])


def fit_tree(train: DataFrame, label: str, depth: int = 12, leaf: int = 20, local_rows: int = LOCAL_ROWS) -> Tree:
    """Least-squares regression tree over rows of `entries`, by exact search: every midpoint between two values that a
    node's rows have is a threshold, at least `leaf` rows stay on either side, and an impure node of 2 * leaf rows is
    split while it has a threshold, up to `depth` levels. Of equal gains the lowest feature wins, then the least threshold.

    A level is one pass. Rows are summed by (node, feature, value) on the map side, entries that are 0 following from
    the node's sums; running sums along the values, over ranges of (node, feature, value) that no feature or node fills
    alone, give what lies on the left of each threshold, and the best of each node is one reduction. The driver gets a
    row for each node. Rows are written once and their node is found from the splits so far. A node of at most
    local_rows rows isn't passed over level by level: a task gets its rows and finds all that is below by the same rule.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
    spark, tree = train.sparkSession, Tree(depth)
    rows = cut(train.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), "entries", F.col(label).cast("double").alias("y")))
    n, mean, spread = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("y"), F.lit(0.0)), F.coalesce(F.var_pop("y"), F.lit(0.0))).first()
    tree.value[1] = mean
    opened = {1: (n, 0.0, n * spread)}  # rows, and sums of labels less their mean and of the squares

    def placed(nodes: list[int]) -> tuple[DataFrame, Any]:
        """rid, node, entries, y (less the mean) of the rows that are in these nodes now."""
        wanted = np.zeros(2 << depth, bool)
        wanted[nodes] = True
        sent = spark.sparkContext.broadcast((tree, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, wanted = sent.value
            for b in batches:
                node = tree.descend(b.column(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], names=["rid", "entries", "y", "node"]).filter(pa.array(wanted[node]))

        return rows.mapInArrow(run, f"rid long, entries {ENTRIES}, y double, node long").withColumn("y", F.col("y") - mean), sent

    small: list[int] = []
    for _ in range(depth):
        opened = {k: v for k, v in opened.items() if v[0] >= 2 * leaf and v[2] - v[1] * v[1] / v[0] > PURE * v[2]}
        small += [k for k, v in opened.items() if v[0] <= local_rows]
        opened = {k: v for k, v in opened.items() if v[0] > local_rows}
        if not opened:
            break
        held, sent = placed(list(opened))
        entries = held.select("node", "y", F.inline("entries")).where("x <> 0")
        cells = cut(entries.groupBy("node", "i", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")))
        whole = F.broadcast(spark.createDataFrame([(k, *v) for k, v in opened.items()], "node long, all_n long, all_s double, all_q double"))
        seen = cells.groupBy("node", "i").agg(*[F.sum(c).alias(c) for c in "nsq"]).join(whole, "node").where("n < all_n")
        zeros = seen.select("node", "i", F.lit(0.0).alias("x"), *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nsq"])
        summed = along(cells.unionByName(zeros), ["node", "i"], ["x"], sums={f"to_{c}": F.col(c) for c in "nsq"}, lags={"before": "x"})
        left = summed.where("before is not null").join(whole, "node").select("node", "i", ((F.col("before") + F.col("x")) / 2).alias("t"), "all_n", "all_s", "all_q", *[(F.col(f"to_{c}") - F.col(c)).alias(c) for c in "nsq"])
        rest_n, rest_s = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")
        gain = F.col("s") * F.col("s") / F.col("n") + rest_s * rest_s / rest_n - F.col("all_s") * F.col("all_s") / F.col("all_n")
        fair = left.where((F.col("n") >= leaf) & (rest_n >= leaf)).withColumn("gain", F.round(gain / (n * spread), DIGITS))
        best = fair.groupBy("node").agg(F.max_by(F.struct("i", "t", "n", "s", "q"), F.struct("gain", -F.col("i"), -F.col("t"))).alias("best")).select("node", "best.*").collect()
        parents, opened = opened, {}
        for r in best:
            tree.feature[r.node], tree.threshold[r.node] = r.i, r.t
            all_n, all_s, all_q = parents[r.node]
            for k, (own_n, s, q) in ((2 * r.node, (r.n, r.s, r.q)), (2 * r.node + 1, (all_n - r.n, all_s - r.s, all_q - r.q))):
                tree.value[k], opened[k] = mean + s / own_n, (own_n, s, q)
        release(cells)
        sent.unpersist()
    if small:
        held, sent = placed(small)
        below = held.select("node", "rid", "y", F.inline_outer("entries")).groupBy("node").applyInPandas(lambda own: _finish(own, depth, leaf, n * spread), "node long, feature long, threshold double, value double")
        for r in below.collect():
            tree.feature[r.node], tree.threshold[r.node], tree.value[r.node] = r.feature, r.threshold, mean + r.value
        sent.unpersist()
    release(rows)
    return tree
