"""Texts of similar word shingles: an exact Jaccard join by prefix filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, bytes_of, cut, in_arrow
from tillage.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A shingle's bucket of more texts than this is linked to hubs first, and what these leave apart meets in a grid.
SMALL_BUCKET = 64
BLOCK = 128
#: Shingles that this many of the texts in a sample of one in SAMPLE have stand last in the order; at most MAX_COMMON.
SAMPLE, COMMON, MAX_COMMON = 16, 8, 200_000
#: Cells of a text's sketch, and its keys that may be broadcast where texts are fetched: beyond, texts are shuffled.
CELLS, FEW_KEYS = 256, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """The sorted distinct hashes of a text's word shingles. A text of fewer words is one shingle, without words it has none."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, np.int64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64).view(np.int64)
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > 100_000:
            known.clear()
        codes = np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
        n = len(words) - self.words + 1
        out = codes[:n].copy()
        for i in range(1, self.words):
            out = (out ^ (out >> np.uint64(29))) * _MIX + codes[i : n + i]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with any similar set."""
    return max(1, math.ceil(n * similarity - 1e-9))


def needed_both(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that similar sets of n and m share at least."""
    return np.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)


def sketch(found: np.ndarray) -> np.ndarray:
    """How many shingles fall into each cell, 255 for more."""
    return np.minimum(np.bincount(found & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8)


def may_be_similar(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Sketches and sizes, row by row: two sets share no more than the lesser counts of all cells add up to."""
    full = (x.max(axis=-1) == 255) | (y.max(axis=-1) == 255)
    return full | (np.minimum(x, y).sum(axis=-1, dtype=np.int64) >= needed_both(n, m, similarity))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < overlap(max(len(a), len(b)), similarity):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= (len(a) + len(b) - both) * similarity - 1e-9


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order (common, hash): of two similar sets these share one."""
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        late = common[at] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: len(found) - overlap(len(found), similarity) + 1]


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts. Any order of shingles gives the same links; this one keeps buckets small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in batches:
            for t in bytes_of(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(make(t))], names=["gram"])

    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("key", "t").dropDuplicates(["key"]).select("t")
    counts = sample.transform(in_arrow, run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.array(sorted(r.gram for r in counts.orderBy(F.desc("n"), "gram").limit(MAX_COMMON).select("gram").collect()), np.int64)


def _streamed(done, names: list[str]):
    """Calls done with the columns of each run of whole groups; rows come sorted by the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        flush = lambda parts: done(*(np.concatenate(x) for x in zip(*parts)))
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(len(names))]
            last = np.flatnonzero(columns[0] != columns[0][-1])
            end = last[-1] + 1 if len(last) else 0
            if end or (held and held[-1][0][-1] != columns[0][0]):
                yield from flush([*held, [c[:end] for c in columns]])
                held = []
            held.append([c[end:] for c in columns])
        if held:
            yield from flush(held)

    return run


def _groups(gram: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    ends = np.append(starts[1:], len(gram))
    keep = ends - starts > 1
    return zip(starts[keep].tolist(), ends[keep].tolist())


def _pairs(similarity: float):
    """Rows (gram, key, size << 32 | place) by gram: pairs to verify (kind 0), and members of large buckets (kind 1: gram,
    key, size). At the first shingle that two sets share they can share no more than either has from there on."""

    def done(gram: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        for s, e in _groups(gram):
            keys, first = np.unique(key[s:e], return_index=True)
            if len(keys) < 2:
                continue
            sizes, places = size[s:e][first] >> 32, size[s:e][first] & 0xFFFFFFFF
            order = np.lexsort((keys, sizes))
            keys, sizes = keys[order], sizes[order]
            after = sizes - places[order]
            # each i meets the later ones whose size is near enough
            need = np.ceil(sizes * similarity - 1e-9)
            low = np.searchsorted(sizes, need)  # j meets low[j] .. j - 1
            if len(keys) <= SMALL_BUCKET:
                j = np.repeat(np.arange(len(keys)), np.arange(len(keys)) - low)
                i = np.concatenate([np.arange(x, k) for k, x in enumerate(low)]).astype(np.int64)
                near = np.minimum(after[i], after[j]) >= needed_both(sizes[i], sizes[j], similarity)
                i, j = i[near], j[near]
            else:
                hubs, at = [], 0
                for k in range(len(keys)):
                    if low[k] > at:
                        at = k
                    hubs.append(at)
                i, j = np.array(hubs), np.arange(len(keys))
                i, j = i[i != j], j[i != j]
                out.append([np.ones(len(keys), np.int64), np.full(len(keys), gram[s]), keys, sizes])
            out.append([np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["kind", "gram", "a", "b"])

    return _streamed(done, ["gram", "key", "size"])


def _cells(similarity: float):
    """Rows (gram, key, size, root) by gram: grid cells of the members whose roots differ. Buckets of the same members are one."""

    def done(gram: np.ndarray, key: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in _groups(gram):
            if (root[s:e] == root[s]).all():
                continue
            order = np.lexsort((key[s:e], size[s:e]))
            keys, sizes, roots = key[s:e][order], size[s:e][order], root[s:e][order]
            name = xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)
            blocks = -(-len(keys) // BLOCK)
            part = lambda x, i: x[i * BLOCK : (i + 1) * BLOCK]
            for i in range(blocks):
                for j in range(i, blocks):
                    if part(sizes, i)[-1] < overlap(int(part(sizes, j)[0]), similarity):
                        break
                    k, r = (np.concatenate([part(x, i), part(x, j)]) if j > i else part(x, i) for x in (keys, roots))
                    if (r != r[0]).any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), name)), pa.array(np.full(len(k), i * blocks + j)), pa.array(k), pa.array(r)], names=["bucket", "cell", "key", "root"])

    return _streamed(done, ["gram", "key", "size", "root"])


def _verify(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known, held = Shingler(words), {}, 0  # a text is in many pairs

        def sets(key: int, text: bytes) -> np.ndarray:
            nonlocal held
            if key not in known:
                if held > 1_000_000:
                    known.clear()
                    held = 0
                known[key] = make(text)
                held += len(known[key])
            return known[key]

        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b.column(2)), bytes_of(b.column(3)))
            keep = [similar(sets(a, x), sets(c, y), similarity) for a, c, x, y in rows]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _filter_pairs(similarity: float):
    """Rows (a, b, x, n, y, m) of sketches and sizes: the pairs that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(may_be_similar(_matrix(b.column(2)), b.column(3).to_numpy(), _matrix(b.column(4)), b.column(5).to_numpy(), similarity))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], names=["a", "b"])

    return run


def _by_cell(done):
    """Calls done with the rows (key, root, ..) of each cell; rows (bucket, cell, key, root, ..) come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, cell, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, cell) != current:
                    if held:
                        yield done(*current, held)
                    current, held = (bucket, cell), []
                held.append(row)
        if held:
            yield done(*current, held)

    return run


def _filter_cells(similarity: float):
    """Rows (bucket, cell, key, root, sketch, size): the members that may be similar to one of another root."""

    def done(bucket: int, cell: int, rows: list[list]) -> pa.RecordBatch:
        keys, roots, sizes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3))
        sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, CELLS)
        told = np.zeros(len(rows), bool)
        for i in range(1, len(rows)):
            near = (roots[:i] != roots[i]) & may_be_similar(sketches[:i], sizes[:i], sketches[i][None, :], sizes[i], similarity)
            told[:i] |= near
            told[i] |= near.any()
        n = int(told.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int64)) for x in (bucket, cell)] + [pa.array(keys[told]), pa.array(roots[told])], names=["bucket", "cell", "key", "root"])

    return _by_cell(done)


def _verify_cells(words: int, similarity: float):
    """Rows (bucket, cell, key, root, t): links between what is not yet joined, a tree in each cell."""
    make = Shingler(words)

    def done(bucket: int, cell: int, rows: list[list]) -> pa.RecordBatch:
        parent, a, b = {r[1]: r[1] for r in rows}, [], []
        sets = [make((r[2] or "").encode("utf-8", "surrogatepass")) for r in rows]

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, (key, root, _) in enumerate(rows):
            for j in range(i):
                x, y = find(root), find(rows[j][1])
                if x != y and similar(sets[i], sets[j], similarity):
                    parent[x] = y
                    a.append(key)
                    b.append(rows[j][0])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_cell(done)


def _texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, t) of the distinct keys; they are broadcast if they are few, else the texts are shuffled."""
    needed = cut(keys.select("key").distinct())
    few = F.broadcast(needed) if needed.count() <= FEW_KEYS else needed
    return cut(texts.select("key", "t").join(few, "key", "left_semi").groupBy("key").agg(F.any_value("t").alias("t")))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; the texts of their keys are fetched once."""
    pairs = cut(pairs)
    own = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), texts)
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(both.transform(in_arrow, _verify(words, similarity), "a long, b long"))


def similar_texts(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Texts (key, t) -> links (a, b) whose components are those of all pairs with that Jaccard of their word shingles.

    Of two similar sets the prefixes share a shingle, in whatever order; so no pair is missed. What places, sizes and
    sketches rule out is not compared; for the rest the texts are. Rows of a key have the same text. A bucket of many
    texts links its members to hubs; pairs that this leaves in different components meet in a grid of cells. Shingles
    are known by 64 bits. Null and empty texts have no shingle and no link; no texts give no links.
    """
    common = broadcast(texts.sparkSession, _common(texts, words), "the common shingles")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        grams, keys, sizes, whole, n = [], [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names = ["gram", "key", "size", "sketch"]
            flat = [pa.array(np.concatenate(x)) for x in (grams, keys, sizes)]
            yield pa.RecordBatch.from_arrays([*flat, pa.nulls(len(flat[0]), pa.binary())], names=names)
            own = list(zip(*whole))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(whole), pa.int64()), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(own[2], pa.binary())], names=names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                if key in seen:
                    continue
                seen.add(key)
                found = make(text)
                if len(found):
                    first = prefix(found, common.value, similarity)
                    grams.append(first)
                    keys.append(np.full(len(first), key))
                    sizes.append((len(found) << 32) | np.arange(len(first), dtype=np.int64))
                    whole.append((key, len(found), sketch(found).tobytes()))
                    n += len(first)
                if n > 200_000:
                    yield from out()
                    grams, keys, sizes, whole, n = [], [], [], [], 0
            if len(seen) > 200_000:
                seen.clear()
        if whole:
            yield from out()

    rows = cut(texts.select("key", "t").transform(in_arrow, prefixes, "gram long, key long, size long, sketch binary"))
    sketches = rows.where("gram is null").select("key", "sketch", "size").dropDuplicates(["key"])
    grams = rows.where("gram is not null").select("gram", "key", "size")
    met = cut(grams.repartition("gram").sortWithinPartitions("gram").transform(in_arrow, _pairs(similarity), "kind long, gram long, a long, b long"))
    pairs = met.where("kind = 0").select("a", "b").distinct()
    both = pairs.join(sketches.toDF("a", "x", "n"), "a").join(sketches.toDF("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m")
    found = _verified(both.transform(in_arrow, _filter_pairs(similarity), "a long, b long"), texts, words, similarity)
    large = met.where("kind = 1").select("gram", F.col("a").alias("key"), F.col("b").alias("size"))
    if not large.take(1):
        return found
    roots = connected_components(found)
    rooted = large.join(roots, large.key == roots.node, "left").select("gram", "key", "size", F.coalesce("root", "key").alias("root"))
    grid = rooted.repartition("gram").sortWithinPartitions("gram").transform(in_arrow, _cells(similarity), "bucket long, cell long, key long, root long").distinct()
    cells = grid.join(sketches, "key").select("bucket", "cell", "key", "root", "sketch", "size").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    members = cut(cells.transform(in_arrow, _filter_cells(similarity), "bucket long, cell long, key long, root long"))
    if not members.take(1):
        return found
    told = members.join(_texts_of(members, texts), "key").select("bucket", "cell", "key", "root", "t").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return found.union(told.transform(in_arrow, _verify_cells(words, similarity), "a long, b long"))
