"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.llm.common import broadcast, cut, drop_cut, in_arrow, shared_dir

#: Bytes of query vectors and of a task's answers to them: of a block that is sent to the executors; the driver holds one.
QUERY_BLOCK_BYTES = 16 << 20
#: Vectors that are scanned at a time, and by one task at least.
ROWS = 8192
#: Of these, queries that are estimated together, and pairs whose exact products are taken together: bound a task's memory.
QUERIES, RERANK = 32, 1 << 14
#: Times k: how many of a query's best estimates are first taken exactly, for a floor under the others.
TOP = 3
#: Bits to which a query's rotated components are rounded, so that estimates are sums of population counts.
QUERY_BITS = 4
ANSWER = "query_id long, rank int, vec_id long, score double"
#: Half-width of the error bound in standard deviations.
EPSILON = 3.0


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v as doubles, n dimensions) without vectors that are null, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    return clean.withColumn("dims", F.size("v"))


@dataclass
class Codes:
    """The rotation, the centre and what an index of them holds.

    A vector v = c + r is stored as the signs of the rotated residual r, packed, with |r| and <o, x> (the cosine of the
    residual and its code). A query's estimate of <q, v> is <q, c> + |r| <x, Pq> / <o, x>, whose error is at most
    |r| |q| sqrt((1 - <o, x>^2) / <o, x>^2) EPSILON / sqrt(dims - 1) but for rare cases. Pq is rounded to QUERY_BITS
    bits, which adds |r| |e| / <o, x> EPSILON / sqrt(dims - 1) for what rounding took off, e; then <x, Pq> is a sum of
    population counts of the code and the query's bit planes.
    """

    centre: np.ndarray
    seed: int = 42

    @property
    def rotation(self) -> np.ndarray:
        if not hasattr(self, "_rotation"):
            d = len(self.centre)
            q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((d, d)))
            self._rotation = q * np.sign(np.diag(r))
        return self._rotation

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs, |r|, <o, x>)."""
        r = (v - self.centre) @ self.rotation
        norm = np.linalg.norm(r, axis=1)
        signs = r > 0
        aligned = np.abs(r).sum(axis=1) / np.sqrt(r.shape[1]) / np.where(norm > 0, norm, 1)
        return np.packbits(signs, axis=1), norm, np.where(norm > 0, aligned, 1)


def words_of(packed: np.ndarray) -> np.ndarray:
    """Packed signs as 64-bit words, a row for each word."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(wide.view(np.uint64).T)


class Rounded:
    """Rotated queries as bit planes: component i is about low + step * sum of 2^j bit j of plane i."""

    def __init__(self, rotated: np.ndarray):
        n, self.dims = rotated.shape
        top = (1 << QUERY_BITS) - 1
        self.low = rotated.min(axis=1)
        width = rotated.max(axis=1) - self.low
        self.step = np.where(width > 0, width / top, 1.0)
        level = np.clip(np.rint((rotated - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.uint8)
        self.rest = np.linalg.norm(rotated - (self.low[:, None] + self.step[:, None] * level), axis=1)
        self.sums = level.sum(axis=1, dtype=np.int64)
        self.planes = [words_of(np.packbits((level >> j) & 1, axis=1)) for j in range(QUERY_BITS)]

    def counts(self, part: slice, words: np.ndarray) -> np.ndarray:
        """Sum of the levels where a code has a one, from population counts alone, for each query and code."""
        out = np.zeros((len(self.low[part]), words.shape[1]), np.int32)
        for j, plane in enumerate(self.planes):
            for q, w in zip(plane, words):
                out += np.left_shift(np.bitwise_count(q[part, None] & w[None, :]), j, dtype=np.int32)
        return out

    def products(self, part: slice, words: np.ndarray, ones: np.ndarray, scale: np.ndarray, plus: np.ndarray) -> np.ndarray:
        """<x, q> scale + plus of each query and code; ones are the codes' own numbers of ones."""
        root = np.sqrt(self.dims)
        out = self.counts(part, words).astype(np.float32)
        out *= (2 * self.step[part] / root).astype(np.float32)[:, None]
        out *= scale.astype(np.float32)[None, :]
        own = np.column_stack([2 * self.low[part] / root, -(self.low[part] * self.dims + self.step[part] * self.sums[part]) / root, plus])
        out += own.astype(np.float32) @ np.stack([ones * scale, scale, np.ones(len(scale))]).astype(np.float32)
        return out


def exact(qt: np.ndarray, vt: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of qt and j of vt in double precision, summed from the first component to the last.

    One component at a time for many pairs: the rows that are gathered from stay in the cache.
    """
    total = np.zeros(len(i))
    for x in range(0, len(i), RERANK):
        a, b, part = i[x : x + RERANK], j[x : x + RERANK], total[x : x + RERANK]
        for q, v in zip(qt, vt):
            part += q[a] * v[b]
    return total


def build(vectors: DataFrame, dims: int, seed: int = 42) -> tuple[DataFrame, Codes]:
    """An index of every row of valid(): (id, v, code, norm, aligned), and the codes' parameters (one vector)."""
    means = vectors.where(F.col("dims") == dims).select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).collect()
    centre = np.zeros(dims)
    for r in means:
        centre[r.j] = r.m
    codes = Codes(centre, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, dims)
                packed, norm, aligned = codes.encode(v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norm), pa.array(aligned)], names=["id", "v", "code", "norm", "aligned"])

    rows = vectors.where(F.col("dims") == dims).select("id", "v")
    return rows.transform(in_arrow, run, "id long, v array<double>, code binary, norm double, aligned double"), codes


def _scan(block, codes: Codes, dims: int, k: int):
    """The k nearest of one task's rows for each query of the block: bounds first, exact products for what they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        rounded, centred = Rounded(q @ codes.rotation), q @ codes.centre
        lengths, qt = np.linalg.norm(q, axis=1), np.ascontiguousarray(q.T)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.full((len(ids), k), -np.inf)

        def take(rows: list[np.ndarray]) -> None:
            nonlocal best, best_id
            own, v, packed, norm, aligned = (np.concatenate(x) for x in zip(*rows))
            vt = np.ascontiguousarray(v.T)
            words = words_of(packed)
            ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
            scale = norm / aligned
            deviation = scale * EPSILON / np.sqrt(max(dims - 1, 1))
            errors = np.stack([deviation * np.sqrt(np.maximum(0, 1 - aligned**2)), deviation, scale + norm, np.ones(len(norm))]).astype(np.float32)
            for at in range(0, len(ids), QUERIES):
                part = slice(at, at + QUERIES)
                own_q = qt[:, part]
                estimate = rounded.products(part, words, ones, scale, centred[part])
                estimate[own[None, :] == ids[part, None]] = -np.inf
                floor = best[part, k - 1]
                if estimate.shape[1] > TOP * k:  # exact products of the best estimates: the k-th nearest is as near as their k-th
                    top = np.argpartition(estimate, -TOP * k, axis=1)[:, -TOP * k :]
                    row = np.repeat(np.arange(len(top)), TOP * k)
                    sure = np.where(estimate[row, top.ravel()] > -np.inf, exact(own_q, vt, row, top.ravel()), -np.inf).reshape(-1, TOP * k)
                    floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
                # the last term is what float32 may be off
                own_error = np.column_stack([lengths[part], rounded.rest[part], 1e-5 * lengths[part], 1e-5 * np.abs(centred[part])]).astype(np.float32)
                near = estimate + own_error @ errors
                near -= floor[:, None].astype(np.float32)
                i, j = np.nonzero((near >= -1e-5 * np.abs(floor)[:, None].astype(np.float32) - 1e-30) & (estimate > -np.inf))
                if not len(i):
                    continue
                score = exact(own_q, vt, i, j)
                i = i + at
                touched = np.unique(i)
                all_q = np.concatenate([i, np.repeat(touched, k)])
                all_s = np.concatenate([score, best[touched].ravel()])
                all_v = np.concatenate([own[j], best_id[touched].ravel()])
                order = np.lexsort((all_v, -all_s, all_q))
                all_q, all_s, all_v = all_q[order], all_s[order], all_v[order]
                begin = np.searchsorted(all_q, touched)
                pick = begin[:, None] + np.arange(k)[None, :]
                best[touched], best_id[touched] = all_s[pick], all_v[pick]

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, dims)
            packed = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            held.append((b.column(0).to_numpy(), v, packed, b.column(3).to_numpy(), b.column(4).to_numpy()))
            n += b.num_rows
            if n >= ROWS:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        q_at, r_at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q_at]), pa.array(best_id[q_at, r_at]), pa.array(best[q_at, r_at])], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, codes: Codes, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index, ties to smaller ids, the query's own id left out.

    queries are rows (id, v), an id once. They are written once, by blocks of about QUERY_BLOCK_BYTES, of which each is
    read by itself and goes to the executors after the one before; each block scans every row of the index and its
    answers are written before the next is fetched. A task sends on k rows for each query, of which a window keeps the
    k best.
    """
    spark, dims = index.sparkSession, len(codes.centre)
    queries = cut(queries.select("id", "v"))
    blocks = max(1, -(-queries.count() * (dims * 8 + k * 16) // QUERY_BLOCK_BYTES))
    by_block = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if blocks > 1:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
        dealt.repartition("block").write.partitionBy("block").parquet(by_block)
        drop_cut(queries)
        queries = spark.read.schema(dealt.schema).parquet(by_block)
    tasks = max(1, min(index.rdd.getNumPartitions(), -(-index.count() // ROWS)))
    rows, path = index.coalesce(tasks), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    spark.createDataFrame([], ANSWER).write.parquet(path)
    for b in range(blocks):
        got = (queries.where(F.col("block") == b) if blocks > 1 else queries).select("id", "v").toArrow()
        ids = got.column(0).to_numpy()
        if not len(ids):
            continue
        v = got.column(1).combine_chunks().flatten().to_numpy().reshape(len(ids), dims)
        block = broadcast(spark, (ids, v), "a block of queries")
        found = rows.transform(in_arrow, _scan(block, codes, dims, k), "query_id long, vec_id long, score double")
        ranked = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        ranked.write.mode("append").parquet(path)
        block.destroy()
    drop_cut(queries)
    return spark.read.schema(ANSWER).parquet(path)


def nearest(df: DataFrame, query_condition, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index every valid vector and search for those that meet query_condition on (id).

    Vectors of other dimensions are other spaces: each is indexed by itself, once, in the shared folder. An id that
    occurs more than once counts as a row each time, as a candidate; as a query it is asked once, with the least of its
    vectors; a query's own id is no candidate. Vectors that are null, zero or hold null or non-finite components, and
    rows without an id, take no part. No valid vectors, no rows. Columns of df besides these two may have any names.
    """
    vectors = valid(df, id_col, vector_col)
    parts = []
    for r in vectors.select("dims").distinct().orderBy("dims").collect():
        index, codes = build(vectors, r.dims)
        index = cut(index)
        # one query for each id: repeated rows of an id would only repeat its answer
        queries = index.where(query_condition).groupBy("id").agg(F.min("v").alias("v"))
        parts.append(search(index, codes, queries, k))
        drop_cut(index)
    if not parts:
        return df.sparkSession.createDataFrame([], ANSWER)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
