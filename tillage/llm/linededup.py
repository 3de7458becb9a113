"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, cut, in_arrow, lookup, no_clash, texts_of, whole_text
from tillage.llm.components import connected_components

#: Edits between near-duplicate lines, by the shorter line's characters: (from that many on, edits). Shorter ones are
#: compared for equality. A number instead of the list holds for every length.
EDITS = ((16, 1), (32, 2))
#: Lines of fewer characters, white space collapsed, are never removed.
MIN_CHARS = 1
#: A segment's bucket of more candidate pairs than this is compared in blocks that carry the texts.
SMALL_BUCKET = 256
BLOCK = 512
#: A segment that this many lines have, in a sample of one text in SAMPLE, is split by segments of what else its lines hold.
SAMPLE, HOT_LINES, DEPTH = 16, 256, 2
#: Segments that are split, at most; the others' buckets are compared in blocks, with the same links.
MAX_HOT = 100_000

Edits = int | Sequence[tuple[int, int]]


def allowed(edits: Edits, n: int) -> int:
    """Edits for a pair whose shorter line has n characters."""
    return edits if isinstance(edits, int) else max([0, *[e for least, e in edits if n >= least]])


def first_allowed(edits: Edits) -> int:
    """From how many characters on lines have allowed edits."""
    return (1 if edits else 1 << 62) if isinstance(edits, int) else min([least for least, e in edits if e], default=1 << 62)


def most(edits: Edits) -> int:
    return edits if isinstance(edits, int) else max([0, *[e for _, e in edits]])


def normal(line: str) -> str:
    """White space collapsed; of it only the space itself is printable."""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def line_key(line: str) -> bytes:
    """128 bits that stand for a line; segments know lines by the first 64."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def halves(keys: list[bytes]) -> np.ndarray:
    """Line keys as two columns of signed longs."""
    return np.frombuffer(b"".join(keys), np.dtype(np.int64).newbyteorder(">")).astype(np.int64).reshape(-1, 2)


def counts(line: str, min_chars: int) -> bool:
    """Whether a line, white space collapsed, takes part: it is long enough and has a letter or digit."""
    return len(line) >= min_chars and (line.isalnum() or any(map(str.isalnum, line)))


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(begin, length) of k segments that cover n characters, the longer ones last."""
    base, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def probe_starts(n: int, m: int, k: int) -> list[tuple[int, int, int]]:
    """(segment, start in a line of n characters, length): which substrings can equal a segment of a line of m <= n.

    Of the alignments with at most k - 1 edits one keeps the segment and spends at most i edits before the i-th
    segment and k - 1 - i after it, so that its shift is within i of 0 and within k - 1 - i of n - m.
    """
    out, tau, delta = [], k - 1, n - m
    for i, (at, size) in enumerate(segments(m, k)):
        low = max(at - i, at + delta - (tau - i), 0)
        high = min(at + i, at + delta + (tau - i), n - size)
        out += [(i, p, size) for p in range(low, high + 1)]
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: An odd number and its inverse modulo 2^64: what substrings are hashed with.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """Segment keys of lines: index keys are even, probe keys the same number made odd.

    Substrings are hashed for many lines at once, as differences of a running sum of characters times powers; equal
    ones have equal hashes, and what else meets is told apart by its text. A key in `hot` is replaced by keys of the
    line's rest: two lines that share a segment and are within some edits have rests within as many, so the rests
    share a segment too.
    """

    def __init__(self, edits: Edits, hot: frozenset[int] = frozenset()):
        self.edits, self.hot, self.plans = edits, hot, {}
        self.sorted_hot = np.array(sorted(hot), np.int64)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def plan(self, n: int) -> np.ndarray:
        """Rows (mixed seed of length and segment, begin, end, role, length of the shorter line, segments), own segments first.

        A line finds each of its own segments again at no shift: an index key is a probe too, and has no row as one.
        """
        if n not in self.plans:
            own, probes = [], []
            for m in range(max(1, n - most(self.edits)), n + 1):
                k = allowed(self.edits, m) + 1
                if k > 1 and n - m < k:
                    own += [(m << 8 | i, at, at + size, 0, m, k) for i, (at, size) in enumerate(segments(m, k))] if m == n else []
                    probes += [(m << 8 | i, p, p + size, 1, m, k) for i, p, size in probe_starts(n, m, k)]
            if len(self.plans) > 20_000:
                self.plans.clear()
            selves = {x[:2] for x in own}
            rows = np.array(own + [x for x in probes if x[:2] not in selves], np.int64).reshape(-1, 6)
            rows[:, 0] = _mixed(rows[:, 0].astype(np.uint64)).view(np.int64)
            self.plans[n] = rows
        return self.plans[n]

    def batch(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(keys to store, how many each line has): index keys, of which each is a probe as well, and the other probe keys."""
        if not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) > len(self.powers):
            self.powers, self.inverses = _powers(_BASE, 2 * len(codes)), _powers(_INVERSE, 2 * len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=total[1:])
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        plans = [self.plan(n) for n in sizes.tolist()]
        n = np.fromiter(map(len, plans), np.int64, len(lines))
        rows = np.concatenate(plans)
        starts = np.repeat(np.cumsum(sizes) - sizes, n)
        at = starts + rows[:, 1]
        sums = (total[starts + rows[:, 2]] - total[at]) * self.inverses[np.minimum(at, len(self.inverses) - 1)]
        x = (_mixed(sums + rows[:, 0].astype(np.uint64)) >> np.uint64(2)).astype(np.int64) << 1
        found = x | rows[:, 3]
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.sorted_hot, x), len(self.sorted_hot) - 1)
            many = np.flatnonzero(self.sorted_hot[place] == x)
            if len(many):
                owner = np.repeat(np.arange(len(lines)), n)
                more: list[int] = []
                whose: list[int] = []
                for i in many.tolist():
                    _, a, b, role, m, k = rows[i].tolist()
                    line, before = lines[owner[i]], len(more)
                    self._rest(int(x[i]), line[:a] + line[b:], m - (b - a), role, k, 1, more)
                    whose += [int(owner[i])] * (len(more) - before)
                kept = np.ones(len(found), bool)
                kept[many] = False
                who = np.concatenate([owner[kept], np.array(whose, np.int64)])
                order = np.argsort(who, kind="stable")
                found = np.concatenate([found[kept], np.array(more, np.int64)])[order]
                n = np.bincount(who, minlength=len(lines))
        return found, n

    def rows(self, line: str) -> list[int]:
        return self.batch([line])[0].tolist()

    def _rest(self, key: int, rest: str, m: int, role: int, k: int, depth: int, out: list[int]) -> None:
        own = [(i, at, size, 0) for i, (at, size) in enumerate(segments(m, k))] if role == 0 else []
        selves = {x[:2] for x in own}
        for i, p, size, r in own + [(i, p, size, 1) for i, p, size in probe_starts(len(rest), m, k) if (i, p) not in selves]:
            x = xxhash.xxh3_64_intdigest(rest[p : p + size].encode("utf-8", "surrogatepass"), (key << 4 | i) & 0xFFFFFFFFFFFFFFFF) >> 2 << 1
            if depth < DEPTH and x in self.hot:
                self._rest(x, rest[:p] + rest[p + size :], m - size, r, k, depth + 1, out)
            else:
                out.append(x | r)

    def of(self, line: str) -> list[int]:
        """All index and probe keys."""
        rows = self.rows(line)
        return [*rows, *[x | 1 for x in rows if not x & 1]]


def _moved(levels: tuple[int, ...], match: int, valid: int) -> tuple[int, ...]:
    """The levels one character on: a match keeps a level, each edit leads to the next one."""
    new = [levels[0] & match & valid]
    for e in range(1, len(levels)):
        new.append(((levels[e] & match) | levels[e - 1] | (levels[e - 1] >> 1) | (new[e - 1] << 1)) & valid)
    return tuple(new)


class _Moves:
    """Moves away from the ends of both lines, where all places of the band are valid, remembered: few occur for few
    edits, so that a long line costs a lookup a character. More than MAX_MOVES are forgotten at once. dead is where the
    edits do not suffice."""

    def __init__(self, edits: int):
        self.band, self.known, self.n = (1 << (2 * edits + 1)) - 1, {}, 0
        self.dead = {None: (0,) * (edits + 1)}

    def at(self, levels: tuple[int, ...]) -> dict:
        return self.known.setdefault(levels, {None: levels}) if levels[-1] else self.dead

    def add(self, node: dict, match: int) -> dict:
        to = _moved(node[None], match, self.band)
        self.n += 1
        if self.n > MAX_MOVES:
            self.known, self.n = {}, 0
            return self.at(to)
        node[match] = self.at(to)
        return node[match]


#: Remembered moves for a number of edits, in each worker.
MAX_MOVES = 100_000
_MOVES: dict[int, _Moves] = {}
#: Characters whose matches are found at a time.
_AT_ONCE = 1 << 16


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def _alike(equal: np.ndarray) -> int:
    """How many are true from the first on."""
    first = int(equal.argmin()) if len(equal) else 0
    return first if len(equal) and not equal[first] else len(equal)


def _matches(a: np.ndarray, padded: np.ndarray, begin: int, end: int, width: int) -> list[int]:
    """For characters begin to end of a: bit d says that it equals padded[i + d]."""
    shifted = np.ndarray((width, end - begin), np.uint32, padded, 4 * begin, (4, 4))
    rows = np.packbits(shifted == a[begin:end], axis=0, bitorder="little")
    out = rows[0].tolist()
    for j, row in enumerate(rows[1:], 1):
        out = [x | y << 8 * j for x, y in zip(out, row.tolist())]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit d of level e says that the prefixes of i and i + d - edits
    characters differ by at most e edits, so a level is a word of 2 * edits + 1 bits that moves along the diagonal.
    A character costs as much in a long line as in a short one."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    x, y = _codes(a), _codes(b)
    short = min(len(x), len(y))
    low = _alike(x[:short] == y[:short])
    same = _alike((x[len(x) - short + low :] == y[len(y) - short + low :])[::-1])
    n, m = len(x) - low - same, len(y) - low - same
    if not n or not m:
        return max(n, m) <= edits
    x, y = x[low : low + n], y[low : low + m]
    padded = np.full(max(n, m) + 2 * edits + 1, 0xFFFFFFFF, np.uint32)  # no character
    padded[edits : edits + m] = y
    moves = _MOVES.setdefault(edits, _Moves(edits))
    band, dead, inner = moves.band, moves.dead, range(edits - 1, m - edits)  # where no place of the band is outside of b
    levels = tuple(((1 << (e + 1)) - 1) << edits & band & ((1 << (m + edits + 1)) - 1) for e in range(edits + 1))
    for begin in range(0, n, _AT_ONCE):
        words = _matches(x, padded, begin, min(begin + _AT_ONCE, n), 2 * edits + 1)
        i, end = begin, begin + len(words)
        while i < end:
            if i in inner:
                node, stop = moves.at(levels), min(end, inner.stop)
                for match in words[i - begin : stop - begin]:
                    node = node.get(match) or moves.add(node, match)
                    if node is dead:
                        return False
                levels, i = node[None], stop
            else:
                top = m - i - 1 + edits
                valid = band & ((1 << (top + 1)) - 1) if top >= 0 else 0
                if i + 1 < edits:
                    valid &= ~((1 << (edits - i - 1)) - 1)
                levels, i = _moved(levels, words[i - begin], valid), i + 1
                if not levels[edits]:
                    return False
    return bool(levels[edits] >> (m - n + edits) & 1)


def _source(docs: DataFrame, id_col: str, text_col: str, extra: list[str] | None = None) -> DataFrame:
    """(id, t, version, x0, x1 ..); version, a hash of the text, tells apart rows that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("t"), F.xxhash64(whole_text(text_col)).alias("version"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra or [])])


def _occurrences(source: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that takes part: id, version, line_no, key, key2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, places, keys, start = [], [], [], 0

            def out() -> pa.RecordBatch:
                whose, both = pa.array(docs, pa.int32()), halves(keys)
                return pa.RecordBatch.from_arrays([b.column(0).take(whose), b.column(2).take(whose), pa.array(places, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["id", "version", "line_no", "key", "key2"])

            for i, text in enumerate(texts_of(b.column(1))):
                for no, line in enumerate(text.split("\n")):
                    line = normal(line)
                    if counts(line, min_chars):
                        places.append(no)
                        keys.append(line_key(line))
                docs += [i] * (len(keys) - start)
                start = len(keys)
                if start >= 50_000:
                    yield out()
                    docs, places, keys, start = [], [], [], 0
            if keys:
                yield out()

    return source.select("id", "t", "version").transform(in_arrow, run, "id long, version long, line_no int, key long, key2 long")


def _fuzzy(source: DataFrame, edits: Edits, min_chars: int, what: str, hot=None) -> DataFrame:
    """Of the lines that have allowed edits, once a task: (seg, key) or, what = "line", (key, key2, line).

    A task leaves out lines that it has just seen, so a line with a third of all rows makes a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen, least = Keys(edits, hot.value if hot else frozenset()), set(), first_allowed(edits)
        keys: list[bytes] = []
        lines: list[str] = []
        size = 0

        def out() -> pa.RecordBatch:
            both = halves(keys)
            if what == "line":
                return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(lines, pa.string())], names=["key", "key2", "line"])
            segs, n = maker.batch(lines)
            return pa.RecordBatch.from_arrays([pa.array(segs), pa.array(np.repeat(both[:, 0], n))], names=["seg", "key"])

        for b in batches:
            for text in texts_of(b.column(0)):
                for line in text.split("\n"):
                    if len(line) < least:
                        continue
                    line = normal(line)
                    if len(line) < least or not counts(line, min_chars):
                        continue
                    key = line_key(line)
                    if key in seen:
                        continue
                    seen.add(key)
                    keys.append(key)
                    lines.append(line)
                    size += len(line)
                    if size >= 400_000 or len(lines) >= 10_000:
                        yield out()
                        keys, lines, size = [], [], 0
            if len(seen) > 200_000:
                seen.clear()
        if lines:
            yield out()

    return source.select("t").transform(in_arrow, run, "key long, key2 long, line string" if what == "line" else "seg long, key long")


def _hot_segments(source: DataFrame, edits: Edits, min_chars: int) -> frozenset[int]:
    """Segments that many different lines have, by a sample; whichever they are, the links come out the same."""
    hot: frozenset[int] = frozenset()
    part = source.where(F.pmod("version", F.lit(SAMPLE)) == 0)
    for _ in range(DEPTH):
        held = broadcast(source.sparkSession, hot, "the hot segments")
        rows = _fuzzy(part, edits, min_chars, "seg", held).select(F.shiftright("seg", 1).alias("bucket"), "key").distinct()
        many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LINES)
        found = frozenset(r.bucket << 1 for r in many.orderBy(F.desc("n"), "bucket").limit(MAX_HOT - len(hot)).select("bucket").collect()) - hot
        if not found:
            break
        hot |= found
    return hot


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment: candidate pairs of small buckets (cell -1), members of large ones by grid cell."""

    def done(seg: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, probe = seg >> 1, (seg & 1).astype(bool)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(starts, len(seg)))
        meets = (np.add.reduceat(~probe, starts) > 0) & (np.minimum.reduceat(key, starts) < np.maximum.reduceat(key, starts))
        a, b, buckets, cells = [], [], [], []
        for s, n in zip(starts[meets], sizes[meets]):  # an index key of one line and any key of another
            part = key[s : s + n]
            left, right = np.unique(part[~probe[s : s + n]]), np.unique(part)
            if len(left) * len(right) <= SMALL_BUCKET:
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
                x, y = x[x != y], y[x != y]
                a += np.minimum(x, y).tolist()
                b += np.maximum(x, y).tolist()
                buckets += [0] * len(x)
                cells += [-1] * len(x)
            else:
                high = -(-len(right) // BLOCK)
                for i in range(-(-len(left) // BLOCK)):
                    for j in range(high):
                        own, other = left[i * BLOCK : (i + 1) * BLOCK], right[j * BLOCK : (j + 1) * BLOCK]
                        a += [*own.tolist(), *other.tolist()]
                        b += [0] * len(own) + [1] * len(other)
                        buckets += [int(bucket[s])] * (len(own) + len(other))
                        cells += [i * high + j] * (len(own) + len(other))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (buckets, cells, a, b)], names=["bucket", "cell", "a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seg, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = np.flatnonzero(seg >> 1 != seg[-1] >> 1)
        end = last[-1] + 1 if len(last) else 0
        if end or (held and held[-1][0][-1] >> 1 != seg[0] >> 1):
            parts = [*held, (seg[:end], key[:end])]
            yield from done(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held = []
        held.append((seg[end:], key[end:]))
    if held:
        yield from done(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]))


def _near(a: str, b: str, edits: Edits) -> bool:
    return within(a, b, allowed(edits, min(len(a), len(b))))


def _verify_pairs(edits: Edits):
    """Rows (a, a2, b, b2, x, y): those whose texts are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_near(x.as_py(), y.as_py(), edits) for x, y in zip(b.column(4), b.column(5))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:4]], names=["a", "a2", "b", "b2"])

    return run


def _verify_cells(edits: Edits):
    """Rows (bucket, cell, key, key2, role, line) sorted by cell: links that keep the components, a tree in each cell.

    A pair that earlier links of the cell already join is not compared again. Lines are grouped by the counts of
    their characters first: an edit changes at most two counts.
    """

    def done(keys: list[tuple[int, int]], roles: list[int], lines: list[str]) -> Iterator[tuple[int, int, int, int]]:
        order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        text = [""] * len(order)
        for k, t in zip(keys, lines):
            text[order[k]] = t
        hist = np.zeros((len(text), 64), np.int16)
        for i, t in enumerate(text):
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 63
            hist[i] = np.minimum(np.bincount(codes, minlength=64), 30_000)
        parent = np.arange(len(text))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left = sorted({order[k] for k, r in zip(keys, roles) if r == 0})
        right = np.array(sorted({order[k] for k, r in zip(keys, roles) if r == 1}), np.int64)
        names = list(order)
        for i in left:
            near = right[np.abs(hist[right] - hist[i]).sum(axis=1) <= 2 * most(edits)] if len(right) else right
            for j in near.tolist():
                x, y = find(i), find(j)
                if x != y and _near(text[i], text[j], edits):
                    parent[max(x, y)] = min(x, y)
                    yield *names[i], *names[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [])

        def flush() -> pa.RecordBatch:
            found = list(done(*held))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["a", "a2", "b", "b2"])

        for batch in batches:
            for bucket, cell, key, key2, role, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, cell) != current:
                    if current is not None:
                        yield flush()
                    current, held = (bucket, cell), ([], [], [])
                held[0].append((key, key2))
                held[1].append(role)
                held[2].append(line)
        if current is not None:
            yield flush()

    return run


_LINKS = "a long, a2 long, b long, b2 long"


def similar_lines(source: DataFrame, edits: Edits = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links (a, b), structs of 128-bit keys, between different lines; their components are those of all near pairs."""
    hot = broadcast(source.sparkSession, _hot_segments(source, edits, min_chars), "the hot segments")
    rows = _fuzzy(source, edits, min_chars, "seg", hot)
    met = cut(rows.repartition(F.shiftright("seg", 1)).sortWithinPartitions("seg").transform(in_arrow, _buckets, "bucket long, cell long, a long, b long"))
    pairs = met.where("cell < 0").select("a", "b").distinct()
    cells = met.where("cell >= 0")
    needed = met.select(F.explode(F.when(F.col("cell") < 0, F.array("a", "b")).otherwise(F.array("a"))).alias("key")).distinct()
    texts = cut(_fuzzy(source, edits, min_chars, "line").join(needed, "key", "left_semi").groupBy("key", "key2").agg(F.first("line").alias("line")))
    both = pairs.join(texts.toDF("a", "a2", "x"), "a").join(texts.toDF("b", "b2", "y"), "b")
    found = both.select("a", "a2", "b", "b2", "x", "y").transform(in_arrow, _verify_pairs(edits), _LINKS)
    if cells.take(1):
        members = cells.select("bucket", "cell", F.col("a").alias("key"), F.col("b").alias("role")).join(texts, "key")
        grid = members.select("bucket", "cell", "key", "key2", "role", "line").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
        found = found.union(grid.transform(in_arrow, _verify_cells(edits), _LINKS))
    return found.select(F.struct(F.col("a").alias("key"), F.col("a2").alias("key2")).alias("a"), F.struct(F.col("b").alias("key"), F.col("b2").alias("key2")).alias("b"))


def dedup_lines(docs: DataFrame, edits: Edits = EDITS, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: id, text without lines that repeat or nearly repeat an earlier one, n_lines, n_removed, extra.

    Lines are compared with white space collapsed. A class is a connected component of lines within the edits allowed
    for the shorter of two, equality included; its first line by (id, text hash, line number) stays, the others go
    with their line feed. Lines of fewer than min_chars characters and lines without letter or digit stay. With a
    number for edits every pair of lines is compared by it, whatever its length.

    Null text stays null, an empty one empty; a null id comes first; rows that agree in id and text are treated alike and
    come back repeated; an empty table gives no rows. A line is known by 128 bits. An extra column may not have the name
    of a result column: that raises ValueError.
    """
    extra = [c for c in extra or [] if c not in (id_col, text_col)]
    no_clash(extra, {"id", "text", "n_lines", "n_removed"})
    source = _source(docs, id_col, text_col, extra)
    seen = cut(_occurrences(source, min_chars))
    place, own = F.struct("id", "version", "line_no"), F.struct("key", "key2")
    found = seen.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"))
    roots = connected_components(similar_lines(source, edits, min_chars)).select(F.col("node.key").alias("key"), F.col("node.key2").alias("key2"), "root")
    linked = cut(found.join(roots, ["key", "key2"], "left").where("n > 1 or root is not null").select("key", "key2", "n", F.coalesce("root", own).alias("root")))
    met = cut(lookup(seen, linked, ["key", "key2"], "n", seen.count(), F.xxhash64("id", "version", "line_no")).drop("n", "key", "key2"))
    first = met.groupBy("root").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n"))
    told = lookup(met, first, ["root"], "n", met.count(), F.xxhash64("id", "version", "line_no"))
    gone = told.where(~place.eqNullSafe(F.col("kept"))).groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(F.collect_set("line_no").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lines, removed = [], [], []
            for text, drop in zip(b.column(1), b.column(2)):
                text, drop = text.as_py(), set(drop.as_py() or ())
                parts = [] if text is None else text.split("\n")
                lines.append(len(parts))
                removed.append(len(drop))
                out.append("\n".join([x for i, x in enumerate(parts) if i not in drop]) if drop else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), *b.columns[3:]], names=["id", "text", "n_lines", "n_removed", *[f"x{i}" for i in range(len(extra))]])

    joined = source.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left").select("id", "t", "gone", *[f"x{i}" for i in range(len(extra))])
    schema = ["id long", "text string", "n_lines long", "n_removed long"] + [f"x{i} {f.dataType.simpleString()}" for i, f in enumerate(joined.schema.fields[3:])]
    return joined.transform(in_arrow, run, ", ".join(schema)).withColumnsRenamed({f"x{i}": c for i, c in enumerate(extra)})
