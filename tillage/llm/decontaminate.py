"""Benchmark decontamination: a generalised suffix automaton of the items' words, through which texts are streamed."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, bytes_of, cut, in_arrow, no_clash, whole_text

#: A-Z to a-z; 0-9, a-z and all bytes of non-ASCII characters stay; the rest parts words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of item text in one automaton; a larger benchmark is matched in blocks of items of this size, one after the other.
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


@dataclass
class Automaton:
    """States of a generalised suffix automaton over word ids, with the items whose windows end in each state.

    window: words in a window. An item with fewer words is one window as a whole. item_of has, for the state of each
    window, the items (numbers into item_ids) that contain it.
    """

    window: int = 10
    ids: dict[bytes, int] = field(default_factory=dict)
    item_ids: list[str] = field(default_factory=list)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: array = field(default_factory=lambda: array("l", [-1]))
    length: array = field(default_factory=lambda: array("l", [0]))
    full: dict[tuple[int, int], set[int]] = field(default_factory=dict)
    shortest: int = 1 << 30

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the word sequence so far is known from another item
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def build(self, items: list[tuple[str, bytes]]) -> Automaton:
        sequences = []
        for item_id, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if seq:
                sequences.append((len(self.item_ids), seq))
                self.item_ids.append(item_id)
                self.shortest = min(self.shortest, len(seq), self.window)
                last = 0
                for w in seq:
                    last = self._extend(last, w)
        for k, seq in sequences:
            n = min(self.window, len(seq))
            for state, longest in self.walk(seq):
                if longest >= n:
                    self.full.setdefault((self.state_of(state, n), n), set()).add(k)
        if len(self.full) and self.shortest < self.window:  # an item shorter than a window ends where its whole sequence does
            self.short = sorted({n for _, n in self.full if n < self.window})
        else:
            self.short = []
        return self

    def state_of(self, state: int, n: int) -> int:
        """The state of the last n words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        state = longest = 0
        for w in seq:
            while state and w not in self.next[state]:
                state = self.link[state]
                longest = self.length[state]
            state = self.next[state].get(w, 0)
            longest = longest + 1 if state else 0
            yield state, longest

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans (first word, last word + 1) inside window occurrences, and the numbers of their items."""
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for at, to in zip(edge[::2], edge[1::2]):  # runs of words that occur in items; a match can't leave its run
            if to - at < self.shortest:
                continue
            for i, (state, longest) in enumerate(self.walk(ids[at:to].tolist()), int(at) + 1):
                if longest < self.shortest:
                    continue
                hit = 0
                if longest >= self.window:
                    hit = self.window
                    if found := self.full.get((self.state_of(state, hit), hit)):
                        items |= found
                    else:
                        hit = 0
                for n in self.short:
                    if n > longest:
                        break
                    if found := self.full.get((self.state_of(state, n), n)):
                        items |= found
                        hit = max(hit, n)
                if hit:
                    if spans and i - hit <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - hit), i)
                        while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                            last = spans.pop()
                            spans[-1] = (min(spans[-1][0], last[0]), last[1])
                    else:
                        spans.append((i - hit, i))
        return spans, items


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of at most about BLOCK_BYTES: collected one at a time, each of bounded size."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-size[0] // BLOCK_BYTES), -(-size[1] // (BLOCK_BYTES // 16)))
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(2 * n)) == k) for k in range(2 * n)]


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what parts them from their neighbours on the left goes too."""
    kept, at, places = [], 0, [(m.start(), m.end()) for m in _WORD.finditer(text)]
    for a, b in spans:
        kept.append(text[at : places[a][0]].rstrip())
        at = places[b - 1][1]
    kept.append(text[at:])
    return b"".join(kept)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, max_words: int | None = None, max_cover: float | None = None) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids of benchmark items with a window in it), text (cleaned).

    A window is `window` consecutive words of an item (item_id, text); an item of fewer words is one window. Words
    inside any occurrence of a window are hit. The cleaned text lacks the hit spans; it is null, a document to drop,
    if a limit is given and over max_words words or over the share max_cover of all words are hit. Without hits it is
    the text itself. Null and empty texts have no words; items without words match nothing; a null item_id counts as
    the text "null". `extra` columns are carried along.

    An item_id that stands in several rows has the windows of all of them and is listed once, however many blocks the
    benchmark takes. Rows of docs that repeat come back repeated; empty docs give no rows, an empty benchmark no hits. An
    extra column may not have the name of a result column: that raises ValueError.
    """
    no_clash(extra, {"id", "n_words", "n_hit", "items", "cleaned"})
    spark = docs.sparkSession
    benchmark = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), whole_text().alias("text"))
    extra = [c for c in extra or [] if c not in (id_col, text_col)]
    xs = [f"x{i}" for i in range(len(extra))]
    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("t"), *[F.col(f"`{c}`").alias(x) for x, c in zip(xs, extra)])
    blocks = _blocks(benchmark)
    limits = (max_words, max_cover)
    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    schema = f"id long, n_words long, n_hit long, items array<string>, cleaned string{fields}"
    if len(blocks) == 1:
        out = source.transform(in_arrow, _in_one_pass(broadcast(spark, _automaton(blocks[0], window), "an automaton of all items"), limits, xs), schema)
    else:
        out = _in_passes(source, blocks, benchmark, window, limits, xs, schema)
    return out.select("id", "n_words", "n_hit", "items", "cleaned", *[F.col(x).alias(c) for x, c in zip(xs, extra)])


def _automaton(block: DataFrame, window: int) -> Automaton:
    return Automaton(window).build([(r.item_id, (r.text or "").encode()) for r in block.toLocalIterator()])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _over(hit: int, n: int, limits: tuple) -> bool:
    max_words, max_cover = limits
    return bool(hit and ((max_words is not None and hit > max_words) or (max_cover is not None and hit > max_cover * n)))


def _batch(first, counts, hits, found, cleaned, rest, xs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [first, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(cleaned, pa.string()), *rest], names=["id", "n_words", "n_hit", "items", "cleaned", *xs]
    )


def _in_one_pass(automaton, limits: tuple, xs: list[str]):
    """Rows (id, t, x..): all items are in one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            counts, hits, found, cleaned = [], [], [], []
            for text in bytes_of(b.column(1)):
                words = words_of(text)
                spans, numbers = a.match(words)
                spans = _merged(spans)
                hit = sum(e - s for s, e in spans)
                counts.append(len(words))
                hits.append(hit)
                found.append(sorted({a.item_ids[k] for k in numbers}))
                over = _over(hit, len(words), limits)
                while spans and not over:  # what is left may form a window across a cut
                    text = _cut_out(text, spans)
                    spans = _merged(a.match(words_of(text))[0])
                cleaned.append(None if over else text.decode())
            yield _batch(b.column(0), counts, hits, found, cleaned, b.columns[2:], xs)

    return run


def _in_passes(source: DataFrame, blocks: list[DataFrame], benchmark: DataFrame, window: int, limits: tuple, xs: list[str], schema: str) -> DataFrame:
    """A pass over the texts for each block of items, with that block's automaton alone; what they find meets by text.

    A text that was cut is matched again, as its ends may form a window across the cut, until none does.
    """
    spark, row = source.sparkSession, F.xxhash64("id", "t")

    def spans_of(automaton):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for key, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                    spans, numbers = automaton.value.match(words_of(text))
                    if spans:
                        rows.append((key, [x for s in spans for x in s], [automaton.value.item_ids[k] for k in numbers]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["row", "spans", "items"])

        return run

    found = None
    for block in blocks:
        built = _automaton(block, window)
        if not built.item_ids:
            continue
        automaton = broadcast(spark, built, "an automaton of a block of items")
        part = cut(source.select(row.alias("row"), "t").transform(in_arrow, spans_of(automaton), "row long, spans array<long>, items array<string>").dropDuplicates(["row"]))
        automaton.destroy()
        found = part if found is None else found.union(part)
    if found is None:  # no item has a word
        return source.transform(in_arrow, _in_one_pass(broadcast(spark, Automaton(window), "an automaton without items"), limits, xs), schema)
    hits = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, words_hit, cleaned = [], [], []
            for text, flat in zip(bytes_of(b.column(1)), b.column(2)):
                n, flat = len(words_of(text)), flat.as_py() or []
                spans = _merged(list(zip(flat[::2], flat[1::2])))
                hit = sum(e - s for s, e in spans)
                counts.append(n)
                words_hit.append(hit)
                cleaned.append(None if _over(hit, n, limits) else (_cut_out(text, spans) if spans else text).decode())
            yield _batch(b.column(0), counts, words_hit, [x or [] for x in b.column(3).to_pylist()], cleaned, b.columns[4:], [*xs, "row"])

    keyed = source.withColumn("row", row).join(hits, "row", "left")
    once = cut(keyed.select("id", "t", "spans", "items", *xs, "row").transform(in_arrow, finish, f"{schema}, row long"))
    again = once.where("n_hit > 0 and cleaned is not null").groupBy("row").agg(F.any_value("cleaned").alias("t"))
    if not again.take(1):
        return once
    rest = contamination(again, benchmark, window, "row", "t").select(F.col("id").alias("row"), F.col("cleaned").alias("left_over"))
    return once.join(rest, "row", "left").withColumn("cleaned", F.coalesce("left_over", "cleaned"))
