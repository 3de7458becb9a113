"""Language ID by prediction by partial matching: per-language byte context trees with frozen counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, bytes_of, in_arrow, no_clash, whole_text

#: Longest context in bytes.
ORDER = 4
#: Bytes of text that are scored at a time.
CHUNK = 1 << 18
#: Labelled documents of each language, and of all languages, that the counts are learned from at most, as expected numbers.
SAMPLE_DOCS, ALL_DOCS = 1500, 12_000


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Key of the k bytes before and the byte at each place: 8 bits a byte, the last byte lowest."""
    key = data.astype(np.uint64)
    out = key[k:].copy()
    for j in range(1, k + 1):
        out |= key[k - j : len(key) - j] << np.uint64(8 * j)
    return out


class Table:
    """An open-addressed hash table of uint64 keys, filled and probed in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, ~np.uint64(0))
        self.rows = np.full(1 << self.bits, -1, np.int32)
        slots, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.rows[slots] < 0
            first = np.unique(slots[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.rows[slots[put]] = keys[rest[put]], rest[put]
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, slots = rest[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.rows[slots], -1)
        rest = np.flatnonzero((seen != keys) & (self.rows[slots] >= 0))
        slots = slots[rest]
        for _ in range(self.probes):
            if not len(rest):
                break
            slots = (slots + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots]
            hit = seen == keys[rest]
            out[rest[hit]] = self.rows[slots[hit]]
            on = ~hit & (self.rows[slots] >= 0)
            rest, slots = rest[on], slots[on]
        return out


@dataclass
class Model:
    """What is broadcast are the counts, a row for each (context, byte) of each language that has it; a worker makes of
    them, by order k and for all languages, the bits of each known (context, byte) and of leaving each known context.

    A byte's bits in a language: if its context of k bytes is known there and the byte followed it c of n times with
    d distinct bytes, log2((n + d) / c); if the byte never followed, log2((n + d) / d) and then those of k - 1
    bytes; if the context is unknown there, just those. Below order 0 each byte takes 8 bits.
    """

    languages: list[str]
    #: (order, language number) -> sorted keys and how often each occurs
    counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]

    def __post_init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.leave: list[np.ndarray] = []
        self.by_key: list[Table] = []
        self.by_context: list[Table] = []

    def __reduce__(self):
        return Model, (self.languages, self.counts)

    def tables(self) -> None:
        """Make the tables, once."""
        if self.by_key or not self.languages:
            return
        counts, languages, empty = self.counts, self.languages, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for k in range(ORDER + 1):
            parts = [counts.get((k, lang), empty) for lang in range(len(languages))]
            keys = np.unique(np.concatenate([x[0] for x in parts]))
            contexts = np.unique(keys >> np.uint64(8))
            lower = self.score_keys(keys & np.uint64((1 << (8 * k)) - 1), k - 1)
            bits, leave = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
            owner = np.searchsorted(contexts, keys >> np.uint64(8))
            for lang, (own, n) in enumerate(parts):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, own)] = n
                total, kinds = np.bincount(owner, c, len(contexts)), np.bincount(owner, c > 0, len(contexts))
                known = total > 0
                leave[known, lang] = np.log2((total[known] + kinds[known]) / kinds[known])
                seen = c > 0
                bits[seen, lang] = np.log2((total + kinds)[owner[seen]] / c[seen])
                bits[~seen, lang] = leave[owner[~seen], lang] + lower[~seen, lang]
            self.keys.append(keys)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.leave.append(leave)
        self.by_key, self.by_context = [Table(x) for x in self.keys], [Table(x) for x in self.contexts]

    def score_keys(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each key, given the k bytes before it, in each language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        rest = np.arange(len(keys))
        while k >= 0 and len(rest):
            if len(self.keys[k]):
                at = np.minimum(np.searchsorted(self.keys[k], keys[rest]), len(self.keys[k]) - 1)
                known = self.keys[k][at] == keys[rest]
                out[rest[known]] += self.bits[k][at[known]]
                rest = rest[~known]
                context = keys[rest] >> np.uint64(8)
                at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
                known = self.contexts[k][at] == context
                out[rest[known]] += self.leave[k][at[known]]
            keys = keys & np.uint64((1 << (8 * k)) - 1) if k else keys
            k -= 1
        out[rest] += 8
        return out

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text in each language; before its beginning there are zero bytes."""
        self.tables()
        total = np.zeros(len(self.languages))
        data = np.frombuffer(b"\0" * ORDER + text, np.uint8)
        for at in range(0, len(text), CHUNK):
            keys = grams(data[at : at + CHUNK + ORDER], ORDER)
            for k in range(ORDER, -1, -1):
                rows = self.by_key[k].find(keys)
                known = rows >= 0
                total += np.bincount(rows[known], minlength=len(self.keys[k])) @ self.bits[k].astype(np.float64) if known.sum() > len(self.keys[k]) else self.bits[k][rows[known]].sum(axis=0, dtype=np.float64)
                keys = keys[~known]
                if not len(keys):
                    break
                left = self.by_context[k].find(keys >> np.uint64(8))
                total += self.leave[k][left[left >= 0]].sum(axis=0, dtype=np.float64)
                keys = keys & np.uint64((1 << (8 * k)) - 1) if k else keys
            total += 8 * len(keys) if len(keys) else 0
        return total

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language of the shortest code (ties: the first by name) and its posterior under equal priors.

        The posterior is taken for as many bytes as 16 at most: it says how clear-cut the language is, where over
        a whole long text it would always be 1.
        """
        bits = self.code_lengths(text)
        best = int(np.argmin(bits))
        scale = min(len(text), 16) / max(len(text), 1)
        return self.languages[best], float(1 / np.exp2(np.minimum((bits[best] - bits) * scale, 0)).sum())


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, all_docs: int = ALL_DOCS) -> Model:
    """Counts of all byte contexts of about sample_docs whole documents of each language, all_docs in all at most.

    The sample is every document of a language that has no more, else those whose hash falls below the share wanted.
    Counting runs on executors; what the driver gets is bounded by the sample. Rows without language or text are left
    out, repeated rows count each time; without labelled rows the model knows no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), whole_text(text_col).alias("t"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    sample_docs = min(sample_docs, -(-all_docs // len(languages)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample_docs / sizes[lang])))])
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            by_lang: dict[int, list[bytes]] = {}
            for name, text in zip(names, bytes_of(b.column(1))):
                by_lang.setdefault(number[name], []).append(b"\0" * ORDER + text)
            for lang, texts in by_lang.items():
                for k in range(ORDER + 1):
                    parts = [grams(np.frombuffer(t[ORDER - k :], np.uint8), k) for t in texts if len(t) > ORDER]
                    keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "lang", "gram", "n"])

    found = sample.select("lang", "t").transform(in_arrow, count, "k int, lang int, gram long, n long").groupBy("k", "lang", "gram").agg(F.sum("n").alias("n"))
    kept = found.toArrow()
    k, lang, gram, n = (kept.column(c).to_numpy() for c in range(4))
    counts = {}
    for key in {(int(a), int(b)) for a, b in zip(np.unique(k), np.unique(lang))} | {(a, b) for a in range(ORDER + 1) for b in range(len(languages))}:
        at = np.flatnonzero((k == key[0]) & (lang == key[1]))
        order = np.argsort(gram[at].view(np.uint64))
        counts[key] = (gram[at].view(np.uint64)[order], n[at][order].astype(np.int32))
    return Model(languages, counts)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Per document: id, lang_pred, score and the extra columns; the whole text is scored.

    Null, empty and letterless texts, and all texts under a model without languages, give `und` and 0. Repeated rows
    come back repeated, a null id stays null, an empty table gives no rows. An extra column may not have the name of a
    result column: that raises ValueError.
    """
    shared = broadcast(docs.sparkSession, model, "the language model")
    extra = [c for c in extra or [] if c != id_col]
    no_clash(extra, {"id", "lang_pred", "score"})
    named = [f"x{i}" for i in range(len(extra))]
    own = [i for i, c in enumerate(extra) if c == text_col]  # the text is sent once, also where it is carried along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.tables()
        for b in batches:
            letters = b.column(2).to_pylist()
            found = [m.predict(t) if ok and m.languages else ("und", 0.0) for t, ok in zip(bytes_of(b.column(1)), letters)]
            carried = list(b.columns[3:])
            for i in own:
                carried.insert(i, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *carried], names=["id", "lang_pred", "score", *named])

    text = whole_text(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), has_letter(text).alias("ok"), *[F.col(f"`{c}`").alias(x) for x, c in zip(named, extra) if c != text_col])
    types = dict(source.dtypes)
    schema = ["id long", "lang_pred string", "score double"] + [f"{x} {types.get(x, 'string')}" for x in named]
    return source.transform(in_arrow, run, ", ".join(schema)).withColumnsRenamed(dict(zip(named, extra)))


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
