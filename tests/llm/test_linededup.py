import random
import time

import pytest
from pyspark.sql import functions as F

from tillage.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("abé ")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = edited(rng, a, rng.randint(0, 5)) if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        assert L.within(a, b, edits) == (distance(a, b) <= edits), (a, b)


@pytest.mark.parametrize("edits", [1, 2, 3, L.EDITS])
def test_every_similar_pair_shares_a_key(edits):
    """Also where the segments that many lines have are split, once or twice."""
    rng = random.Random(1)
    lines = [("prefix " * rng.randint(0, 3)) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    hot = frozenset()
    for _ in range(3):
        keys, seen = L.Keys(edits, hot), {}
        for a in lines:
            for x in keys.of(a):
                seen.setdefault(x & ~1, set()).add(a)
        for a in lines + [x + y for x in ("", "long line that is the same ") for y in ("a", "b1", "c22")]:
            for n in range(1, 4):
                b = edited(rng, a, n)
                short, long = sorted((a, b), key=len)
                if short and a != b and distance(a, b) <= L.allowed(edits, len(short)):
                    assert {k for k in keys.of(short) if not k & 1} & {k - 1 for k in keys.of(long) if k & 1}, (short, long)
        hot |= {k for k, v in seen.items() if len(v) > 3}
    assert len(hot) > 10


def brute(rows, edits=L.EDITS, min_chars=1):
    lines = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((text or "").split("\n")):
            n = " ".join(line.split())
            if len(n) >= min_chars and any(c.isalnum() for c in n):
                lines.setdefault(n, []).append((i, no))
    names = list(lines)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            tau = L.allowed(edits, min(len(a), len(b)))
            if tau and abs(len(a) - len(b)) <= tau and find(a) != find(b) and distance(a, b) <= tau:
                root[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).extend(lines[n])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in rows}


SCHEMA = "doc_id long, text string"


def test_against_brute_force(spark):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
    base = [line() for _ in range(40)]
    hub = "this is the head of a very common line with a tail of "
    pool = [*base, *[edited(rng, x, rng.randint(1, 3)) for x in base], *[hub + edited(rng, "abcdefgh", 2) for _ in range(60)], "  padded   " + base[0], "}", "--", "a", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(90, None), (91, ""), (92, "x" * 5000 + "\n" + "x" * 5001)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("gone", F.lit(None).cast("string"))
    found = L.dedup_lines(df.union(df.where("doc_id = 3")), extra=["key", "gone"]).collect()
    assert {r.id: r.text for r in found} == brute(rows) and len(found) == len(rows) + 1
    assert {r.id: r.text for r in L.dedup_lines(df, min_chars=20).collect()} == brute(rows, min_chars=20)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_every_length(spark):
    """Lengths 1 to 40, two edits for all of them."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in range(1, 41) for _ in range(2)]
    pool = base + [edited(rng, x, rng.randint(1, 3)) for x in base]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(4))) for i in range(50)]
    assert {r.id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, SCHEMA), edits=2).collect()} == brute(rows, 2)


def test_a_segment_of_many_lines_is_split(spark, monkeypatch):
    """100 000 lines share two segments; pairs planted among them are found, and no bucket holds more than a few."""
    rng = random.Random(4)
    head = "a line whose first and second parts are everywhere the same, but not "
    tails = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34)) for _ in range(100_000)]
    rows = [(i, "\n".join(head + t for t in tails[i * 100 : i * 100 + 100])) for i in range(1000)]
    rows += [(2000 + i, head + edited(rng, tails[i * 37], 2)) for i in range(50)]
    largest = []
    source = L._source(spark.createDataFrame(rows, SCHEMA).repartition(8), "doc_id", "text")
    for depth in (0, 2):
        monkeypatch.setattr(L, "DEPTH", depth)
        hot = L._hot_segments(source, 2, 1) if depth else frozenset()
        keys = L._fuzzy(source, 2, 1, "seg", L.broadcast(spark, hot, "hot"))
        largest.append(keys.groupBy(F.shiftright("seg", 1)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0])
    assert largest[0] >= 100_000 and largest[1] < 8 * 16 * L.HOT_LINES
    got = {r.id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(8), edits=2).where("id >= 2000").collect()}
    assert got == dict.fromkeys(range(2000, 2050), "")


def test_distance_of_long_lines(monkeypatch):
    """Edits at both ends of 1 MB, far apart, one too many; blocks and forgotten moves change nothing."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghij klmno") for _ in range(1_000_000))
    begin = time.process_time()
    assert L.within("Z" + line, line + "Q", 2) and not L.within("Z" + line, line + "Q", 1)
    assert L.within(line, "Z" + line[:500_000] + line[500_001:], 2) and not L.within(line, "Z" + line[:500_000] + line[500_001:-1] + "QQ", 2)
    assert time.process_time() - begin < 4
    monkeypatch.setattr(L, "_AT_ONCE", 3)
    monkeypatch.setattr(L, "MAX_MOVES", 20)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(2))
        for edits in (0, 1, 2, 3, 7):
            assert L.within(a, b, edits) == (distance(a, b) <= edits)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a line")], SCHEMA).withColumn("n_lines", F.lit(1))
    with pytest.raises(ValueError, match="n_lines"):
        L.dedup_lines(df, extra=["n_lines"])
