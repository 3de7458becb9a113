"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.llm.common import bytes_of, cut, in_arrow, whole_text
from tillage.llm.components import connected_components
from tillage.llm.shingles import similar_texts

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a text that are hashed at a time: bounds the memory of a very long text.
CHUNK_WORDS = 1 << 16
#: An anchor with more rows than this is compared in a grid of blocks of this size, by many tasks.
BLOCK_ROWS = 4096


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes of the word shingles. No words: 0."""
    words = text.translate(LOWER).split()  # splits at 20 and 09-0D, as wanted
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ones, n, hash_ = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK_WORDS):
        part = words[at : at + CHUNK_WORDS + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        begins = np.concatenate(([0], ends[: len(part) - shingle] + 1)).tolist()
        stops = ends[shingle - 1 :].tolist()
        hashes = np.fromiter((hash_(joined[b:e], seed) for b, e in zip(begins, stops)), np.uint64, len(begins))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, fp): fp is the fingerprint of the whole text as a signed long, version another hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, shingle, seed) for t in bytes_of(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found.view(np.int64))], names=["id", "version", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col), F.xxhash64(whole_text(text_col)).alias("version"))
    return source.transform(in_arrow, run, "id long, version long, fp long")


@dataclass(frozen=True)
class Segment:
    """Bits offset .. offset+hamming+free of a fingerprint, of which at most budget may differ.

    The anchors of a segment are the words whose first `hamming` = 2^r - 1 bits are a codeword of the perfect Hamming
    code; the other bits are free. Every word is within covering radius 1 of exactly one anchor, its home.
    """

    offset: int
    hamming: int
    free: int
    budget: int

    def patterns(self) -> dict[int, np.ndarray]:
        """By syndrome: the differences to every anchor that a partner within budget can have as its home.

        A home has its word's free bits, so with e free bits changed, at most 1 + budget - e of the others are.
        """
        found: dict[int, list[int]] = {s: [] for s in range(self.hamming + 1)}
        for e in range(self.budget + 1):
            for loose in combinations(range(self.hamming, self.hamming + self.free), e):
                f = sum(1 << x for x in loose)
                for w in range(self.budget + 2 - e):
                    for bits in combinations(range(self.hamming), w):
                        s = 0
                        for x in bits:
                            s ^= x + 1
                        found[s].append(f | sum(1 << x for x in bits))
        return {s: np.array(sorted(x), np.int64) for s, x in found.items()}

    def words(self, fps: np.ndarray) -> np.ndarray:
        return ((fps >> np.uint64(self.offset)) & np.uint64((1 << (self.hamming + self.free)) - 1)).astype(np.int64)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        s = np.zeros(len(words), np.int64)
        for x in range(self.hamming):
            s ^= ((words >> x) & 1) * (x + 1)
        return s


def layout(distance: int, count: int) -> list[Segment]:
    """Segments of a 64-bit fingerprint such that any pair within the distance is within budget in one of them.

    Three segments with about 2^17 anchors each serve up to 2^25 fingerprints; beyond, two segments with 2^27
    anchors cost eight times the copies but keep the lists of an anchor short. Both are exact.
    """
    if count <= 1 << 25:
        budget = distance // 3
        return [Segment(0, 15, 7, budget), Segment(22, 15, 6, budget), Segment(43, 15, 6, budget)]
    budget = distance // 2
    return [Segment(0, 31, 1, budget), Segment(32, 31, 1, budget)]


def replicate(fps: np.ndarray, segments: list[Segment], patterns: list[dict[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, fingerprint, is home) of all anchors within covering radius plus budget."""
    for k, (seg, by_syndrome) in enumerate(zip(segments, patterns)):
        words = seg.words(fps)
        syndromes = seg.syndromes(words)
        for s, deltas in by_syndrome.items():
            at = np.flatnonzero(syndromes == s)
            if len(at):
                home = 0 if s == 0 else 1 << (s - 1)
                anchors = words[at][:, None] ^ deltas[None, :]
                yield ((k << 40) | anchors).ravel(), np.repeat(fps[at], len(deltas)), np.tile(deltas == home, len(at))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: (nodes, their roots), roots left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def compare(keys: np.ndarray, fps: np.ndarray, homes: np.ndarray, distance: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: links between each home row and all rows of its key, as stars that keep every component."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    run = np.repeat(np.arange(len(starts)), ends - starts)
    left = np.flatnonzero(homes & ((ends - starts)[run] > 1))
    sizes = (ends - starts)[run[left]]
    total = np.concatenate(([0], np.cumsum(sizes)))
    out_a, out_b = [], []
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, total[at] + chunk, "right")) - 1)
        n = sizes[at:to]
        i = np.repeat(left[at:to], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run[left[at:to]]], n)
        x, y = fps[i], fps[j]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        if near.any():
            a, b = _roots(x[near], y[near])
            out_a.append(a)
            out_b.append(b)
        at = to
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _per_anchor(distance: int, defer: bool, block_rows: int):
    """Streams rows sorted by (anchor, cell). With defer, an anchor of over block_rows rows goes out as grid cells."""

    def batch(kind: int, key, cell, a, b, home) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(cell.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(home)],
            names=["kind", "anchor", "cell", "a", "b", "home"],
        )

    def done(key, cell, fps, homes) -> Iterator[pa.RecordBatch]:
        if defer:
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            keep = np.ones(len(key), bool)
            for s, n in zip(starts[sizes > block_rows], sizes[sizes > block_rows]):
                keep[s : s + n] = False
                part, is_home = fps[s : s + n], homes[s : s + n]
                blocks, block = -(-n // block_rows), np.arange(n) // block_rows
                for k in range(blocks):  # row k of the grid compares the homes of block k with each block
                    own = np.flatnonzero(is_home & (block == k))
                    for j in range(blocks) if len(own) else ():
                        other = np.flatnonzero(block == j)
                        pick = np.concatenate([own, other])
                        flags = np.concatenate([np.ones(len(own), bool), np.zeros(len(other), bool)])
                        yield batch(1, np.full(len(pick), key[s]), np.full(len(pick), k * blocks + j), part[pick], part[pick], flags)
            key, fps, homes = key[keep], fps[keep], homes[keep]
            cell = cell[keep]
        if len(key):
            changed = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            a, b = compare(np.cumsum(changed), fps, homes, distance)
            zero = np.zeros(len(a), np.int64)
            if len(a):
                yield batch(0, zero, zero, a, b, zero.astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, cell, fp = (b.column(i).to_numpy() for i in (0, 1, 2))
            homes = b.column(3).to_numpy(zero_copy_only=False)
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            end = last[-1] + 1 if len(last) else 0  # the rest may go on in the next batch
            if end or (held and (held[-1][0][-1], held[-1][1][-1]) != (key[0], cell[0])):
                parts = [*held, (key[:end], cell[:end], fp[:end].view(np.uint64), homes[:end])]
                yield from done(*(np.concatenate([p[i] for p in parts]) for i in range(4)))
                held = []
            held.append((key[end:], cell[end:], fp[end:].view(np.uint64), homes[end:]))
        if held:
            yield from done(*(np.concatenate([p[i] for p in held]) for i in range(4)))

    return run


_LINKS = "kind int, anchor long, cell long, a long, b long, home boolean"


def links(distinct_fps: DataFrame, distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within the distance.

    Each task emits a star for each component of what it compares, so a dense group of g fingerprints makes about g
    links and never g squared. An anchor with many rows is dealt out again as blocks that meet in a grid.
    """
    segments = layout(distance, distinct_fps.count())
    patterns = [s.patterns() for s in segments]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for anchors, copies, home in replicate(fps, segments, patterns):
                    yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.zeros(len(anchors), np.int64)), pa.array(copies.view(np.int64)), pa.array(home)], names=["anchor", "cell", "fp", "home"])

    rows = distinct_fps.select("fp").transform(in_arrow, spread, "anchor long, cell long, fp long, home boolean")
    met = cut(rows.repartition("anchor").sortWithinPartitions("anchor").transform(in_arrow, _per_anchor(distance, True, block_rows), _LINKS))
    found, hot = met.where("kind = 0").select("a", "b"), met.where("kind = 1")
    if hot.take(1):
        cells = hot.select("anchor", "cell", F.col("a").alias("fp"), "home").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
        found = found.union(cells.transform(in_arrow, _per_anchor(distance, False, block_rows), _LINKS).select("a", "b"))
    return found


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, fp, root, component): root names the class, a fingerprint in it; component is the least id reachable over links of at most `distance` differing bits.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come back repeated. A null id is
    kept; a component of null ids only has a null component. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle, seed, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(distinct, distance))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select(distinct.fp, "first", F.coalesce("root", distinct.fp).alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component"))
    named = classes.join(least, "root").select("fp", "root", "component")
    return prints.join(named, "fp").select("id", "version", "fp", "root", "component")


def _joined(found: DataFrame, docs: DataFrame, similarity: float, words: int, text_col: str) -> DataFrame:
    """found with the classes made one that hold texts of that Jaccard of their word shingles."""
    found = cut(found.select("id", "version", "root"))
    texts = docs.select(F.xxhash64(whole_text(text_col)).alias("key"), whole_text(text_col).alias("t"))
    of = found.select("version", "root").distinct()
    pairs = similar_texts(texts, words, similarity).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    roots = connected_components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("root", "least")
    return found.join(roots, found.root == roots.node, "left").select("id", "version", F.coalesce("least", "root").alias("root"))


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """docs with one row of each class of near_duplicates: the least id's, among equal ids the least text hash's.

    With a similarity, texts whose sets of `words`-word shingles have at least that Jaccard link too, exactly.
    Columns are known by position meanwhile, so docs may have any names.
    """
    found = near_duplicates(docs, distance, shingle, seed, id_col, text_col)
    if similarity is not None:
        found = _joined(found, docs, similarity, words, text_col)
    kept = found.groupBy("root").agg(F.min(F.struct("id", "version")).alias("k")).select(F.col("k.id").alias("id"), F.col("k.version").alias("version"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    marked = docs.toDF(*names).withColumn("v", F.xxhash64(whole_text(text)))
    rows = marked.join(kept, F.col(own).cast("long").eqNullSafe(F.col("id")) & (F.col("v") == F.col("version")), "left_semi")
    one = Window.partitionBy(own, "v").orderBy(F.lit(1))  # rows that repeat id and text
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select(*names).toDF(*docs.columns)


def hex_fingerprint(c):
    """The 16 lowercase hexadecimal digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
