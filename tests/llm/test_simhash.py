import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tillage.llm import common, components, simhash


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {i: plain(t) for i, t in rows}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\x0b "]).join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "One Two"), (n + 4, "one two"), (n + 5, "a\xa0b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(df).select("id", simhash.hex_fingerprint(F.col("fp")).alias("fp"), "component").collect()}
    assert got == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_every_link_is_found(spark, monkeypatch):
    """Random fingerprints with planted neighbours, in all layouts and through the grid of a hot anchor."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = set(map(int, base))
    for x in map(int, base[:150]):
        for _ in range(2):
            for b in rng.choice(64, 4, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    pairs = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 4]}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")

    def classes(edges):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = {}
        for x in parent:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    for segments in (simhash.layout(4, 0), simhash.layout(4, 1 << 40)):
        monkeypatch.setattr(simhash, "layout", lambda *_, s=segments: s)
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 4, block_rows=8).collect()]
        assert classes(got) == classes(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    joins = []

    def cut(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return common.cut(df)

    monkeypatch.setattr(components, "cut", cut)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert max(joins) == 2  # the two of a lookup: a plan holds no other star's


def test_one_of_each_keeps_columns_of_any_name(spark):
    clashing = ["_id", "_version", "id", "version", "v", "n", "root", "fp", "c0", "a.b"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, ""), (5, "other words of another text")]
    docs = spark.createDataFrame([(i, t, *range(len(clashing))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in clashing))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got.collect()) == [(False, 0, ""), (True, 1, "a b c d e f"), (True, 5, "other words of another text")]
    assert all(tuple(r)[2:] == tuple(range(len(clashing))) for r in got.collect())
