"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tillage.llm.common import broadcast, in_arrow, no_clash, texts_of, whole_text

NONE = np.int64(1) << 62
#: The library's own normal form: its Unicode orders other marks than Python's. Below U+0300 nothing composes.
_NFC, _MARKS = normalizers.NFC(), re.compile("[^\\x00-\u02ff]")
#: Words whose tokens a worker remembers; it forgets all of them when it knows this many.
CACHE_WORDS = 200_000
#: Words of up to this many symbols are merged side by side, longer ones one at a time.
SIDE_BY_SIDE = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one of Latin-1's visible ones, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def newer_characters() -> tuple[str, dict[int, int]]:
    """Where three Unicode versions disagree, for characters that Python's doesn't assign: the letters and digits, as ranges
    of a set, that the pattern library knows and the tokenizer's library takes for other signs; and the lower case
    that the latter knows. A few thousand characters at a time: all of them would take 100 MB of the driver."""
    told, ranges, lower = regex.compile(r"[\p{L}\p{N}]"), [], {}
    for begin in range(0x80, 0x110000, 8192):
        new = [c for c in map(chr, range(begin, min(begin + 8192, 0x110000))) if unicodedata.category(c) == "Cn"]
        low = normalizers.Lowercase().normalize_str("".join(new))
        lower |= {ord(a): ord(b) for a, b in zip(new, low, strict=True) if a != b}
        new = [c for c in new if told.match(c)]
        others = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str("".join(new))
        for c in "".join(x for x, _ in others):
            if ranges and ord(c) == ord(ranges[-1][1]) + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{a}-{b}" for a, b in ranges), lower


@dataclass
class Vocabulary:
    """Tokens, merge ranks and text rules of a byte-level BPE with word ends."""

    tokens: list[str]
    pairs: np.ndarray  # sorted: left id << 32 | right id
    ranks: np.ndarray
    merged: np.ndarray
    first: list[int]  # id of each byte inside a word
    last: list[int]  # id of each byte at a word's end
    special: dict[str, int]
    pattern: str
    cache: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for t, i in [*ids.items(), *special.items()]:
            tokens[i] = t
        rows = sorted((ids[a] << 32 | ids[b], r, ids[a + b]) for r, (a, b) in enumerate(model["merges"]))
        pairs, ranks, merged = (np.array(x, np.int64) for x in zip(*rows))
        symbols = byte_symbols()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(tokens, pairs, ranks, merged, [ids[s] for s in symbols], [ids[s + end] for s in symbols], special, pattern, {}, newer_characters())

    newer: tuple[str, dict[int, int]] = ("", {})

    def __post_init__(self) -> None:
        self.unknown = re.compile(f"[{self.newer[0]}]") if self.newer[0] else None
        self.words = regex.compile(self.pattern)
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.by_pair = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def __reduce__(self):
        return Vocabulary, (self.tokens, self.pairs, self.ranks, self.merged, self.first, self.last, self.special, self.pattern, {}, self.newer)

    # -- text -> words

    def split(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, word) in order."""
        at = 0
        for m in self.parts.finditer(text) if self.parts else ():
            yield from ((False, w) for w in self._words(text[at : m.start()]))
            yield True, m.group()
            at = m.end()
        yield from ((False, w) for w in self._words(text[at:] if at else text))

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if _MARKS.search(text):
                text = _NFC.normalize_str(text).translate(self.newer[1])
            text = text.replace("Σ", "σ")  # lower() would look for a final sigma
        text = text.lower()
        if self.unknown and not text.isascii() and self.unknown.search(text):
            return [text[m.start() : m.end()] for m in self.words.finditer(self.unknown.sub("\ue000", text))]
        return self.words.findall(text)

    # -- words -> tokens

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NONE for what doesn't merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[at] == key
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def symbols(self, word: str) -> list[int]:
        data = word.encode()
        return [*map(self.first.__getitem__, data[:-1]), self.last[data[-1]]]

    def merge_one(self, ids: list[int]) -> list[int]:
        """A segment tree whose leaves are the pairs' rank << 32 | place: its root is the leftmost pair of lowest rank."""
        n, none, get = len(ids), int(NONE), self.by_pair.get
        size = 1 << max(0, n - 2).bit_length() if n > 1 else 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if found := get(ids[i] << 32 | ids[i + 1]):
                tree[size + i] = found[0] << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            found = get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            k = size + i
            tree[k] = found[0] << 32 | i if found else none
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        while n > 1 and tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = get(ids[i] << 32 | ids[j])[1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put_j = size + j  # the pair that began at j is gone
                tree[put_j] = none
                put_j >>= 1
                while put_j:
                    tree[put_j] = min(tree[2 * put_j], tree[2 * put_j + 1])
                    put_j >>= 1
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[list[int]], width: int) -> list[list[int]]:
        """merge_one for many words of up to `width` (a power of two) symbols: a tree for each, updated together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.arange(width + 1)[None, :] < lengths[:, None]] = np.fromiter((x for w in words for x in w), np.int64, int(lengths.sum()))
        place = np.arange(width, dtype=np.int64)
        rank, _ = self.look_up(ids[:, :-1], ids[:, 1:])
        rank[ids[:, 1:] < 0] = NONE
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = np.where(rank < NONE, rank << 32 | place, NONE)
        at = width
        while at > 1:
            at >>= 1
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after = np.minimum(after, lengths[:, None])
        before = np.tile(np.arange(-1, width), (n, 1))

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = i + width
            tree[rows, k] = value
            while width > 1 and k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def renew(rows: np.ndarray, i: np.ndarray) -> None:
            j = after[rows, i]
            inside = j < lengths[rows]
            rank, _ = self.look_up(ids[rows, i], ids[rows, np.minimum(j, width)])
            put(rows, i, np.where(inside & (rank < NONE), rank << 32 | i, NONE))

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            i = tree[rows, 1] & 0xFFFFFFFF
            j = after[rows, i]
            ids[rows, i] = self.look_up(ids[rows, i], ids[rows, j])[1]
            ids[rows, j] = -1
            k = after[rows, j]
            after[rows, i] = k
            before[rows, np.minimum(k, width)] = i
            put(rows, np.minimum(j, width - 1), np.full(len(rows), NONE))
            renew(rows, i)
            left = before[rows, i]
            has = left >= 0
            if has.any():
                renew(rows[has], left[has])
            rows = rows[tree[rows, 1] < NONE]
        flat, kept = ids[:, :width], ids[:, :width] >= 0
        return [x.tolist() for x in np.split(flat[kept], np.cumsum(kept.sum(axis=1))[:-1])]

    def learn(self, words: set[str]) -> None:
        """Put the tokens of new words into the cache: (ids as text, number, tokens as text, ids)."""
        by_width: dict[int, list[tuple[str, list[int]]]] = {}
        for w in words:
            s = self.symbols(w)
            width = 1 << max(1, (len(s) - 1).bit_length())
            by_width.setdefault(width if width <= SIDE_BY_SIDE else 0, []).append((w, s))
        for width, rows in by_width.items():
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                merged = self.merge_many([s for _, s in part], width) if width else [self.merge_one(s) for _, s in part]
                for (w, _), ids in zip(part, merged):
                    self.cache[w] = (" ".join(map(str, ids)), len(ids), " ".join([self.tokens[i] for i in ids]), ids)

    def pieces(self, text: str) -> list:
        """The words of a text in order; a special token is already its cache entry."""
        if not self.parts or not self.parts.search(text):
            return self._words(text)
        return [(str(self.special[w]), 1, w, [self.special[w]]) if special else w for special, w in self.split(text)]

    def encode(self, texts: list[str]) -> Iterator[list[tuple[str, int, str, list[int]]]]:
        """For each text the entries (ids as text, number, tokens as text, ids) of its words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found = [self.pieces(t) for t in texts]
        cache = self.cache
        self.learn({w for words in found for w in words if w.__class__ is str and w not in cache})
        get = cache.__getitem__
        for words in found:
            yield [get(w) if w.__class__ is str else w for w in words]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _groups(texts: Iterator[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of texts of about `limit` characters: what is split into words at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """Per document: id, n_tokens, and as asked the token ids and SHA-256 digests of ids and decoded text.

    The whole text is encoded without added special tokens; special tokens written in the text are recognised. Null
    and empty texts have no tokens. The vocabulary is read once, on the driver, and broadcast: its size is fixed.
    Repeated rows come back repeated, an empty table gives no rows. An extra column may not have the name of a result
    column: that raises ValueError.
    """
    no_clash([c for c in extra or [] if c != id_col], {"id", "n_tokens", *["tokens"] * ids, *["ids_sha256", "decoded_sha256"] * digests})
    vocabulary = broadcast(docs.sparkSession, Vocabulary.read(vocabulary_path), "the tokenizer's vocabulary")
    extra = [c for c in extra or [] if c != id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sha = vocabulary.value, lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            at = 0
            for group in _groups(texts_of(b.column(1))):
                counts, lists, left, right = [], [], [], []
                for words in v.encode(group):
                    counts.append(sum([w[1] for w in words]))
                    if ids:
                        lists.append(np.fromiter((i for w in words for i in w[3]), np.int32, counts[-1]))
                    if digests:
                        left.append(sha(" ".join([w[0] for w in words])))
                        right.append(sha(" ".join([w[2] for w in words])))
                part = b.slice(at, len(group))
                at += len(group)
                columns = {"id": part.column(0), "n_tokens": pa.array(counts, pa.int64())}
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))
                if digests:
                    columns |= {"ids_sha256": pa.array(left, pa.string()), "decoded_sha256": pa.array(right, pa.string())}
                columns |= {f"x{i}": x for i, x in enumerate(part.columns[2:])}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("t"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    schema = ["id long", "n_tokens long"] + ["tokens array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    schema += [f"x{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[2:])]
    out = source.transform(in_arrow, run, ", ".join(schema))
    return out.withColumnsRenamed({f"x{i}": c for i, c in enumerate(extra)})


def decode(encoded: DataFrame, vocabulary_path: str, tokens_col: str = "tokens") -> DataFrame:
    """encoded with a column decoded: the tokens' strings joined by spaces. Null tokens decode to null. A column of
    encoded may not be named decoded: that raises ValueError."""
    no_clash(encoded.columns, {"decoded"})
    vocabulary = broadcast(encoded.sparkSession, Vocabulary.read(vocabulary_path), "the tokenizer's vocabulary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(b.schema.get_field_index(tokens_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.transform(in_arrow, run, f"{fields}, decoded string")
