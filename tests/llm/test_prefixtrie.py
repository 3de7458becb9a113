"""The trie against plain Python over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillage.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, family=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % family, [])[:h] + own[c][h:]
    return out


def brute(rows, **kw):
    members = defaultdict(list)
    paths = rebuilt(rows, **kw)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in members:
        below, wait = [], [k]
        while wait:
            below.append(x := wait.pop())
            wait += children[x]
        ends = ",".join(str(c) for c in members[k] if len(paths[c]) == len(k))
        out[members[k][0], len(k)] = (
            members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), sum(not children[x] for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def rows_of(df):
    got = {(r.conv_id, r.depth): tuple(r)[2:8] for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    openings = [("user", "hi"), ("user", ""), (None, None), ("system", "être"), ("", "hi")]
    made = []
    for c in rng.sample(range(400), 230):
        for t in range(rng.randint(1, 12)):
            role, text = openings[0] if t < 4 and c % 3 else rng.choice(openings)
            made.append((c, t if rng.random() < 0.9 else rng.choice([None, 0]), role, text))
    made += [(c, t, "a", f"same {t}") for c in range(1000, 1100) for t in range(4)]  # copies, in several families
    made += [(2000, t, "user", "x" * 50_000 if t == 2 else "long") for t in range(60)] + [(None, 0, "user", "no id"), (7, 3, "user", "hi"), (7, 3, "user", "hi")]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("most", [P.MAX_TURNS, 30, 1])
def test_trie(spark, rows, most, monkeypatch):
    monkeypatch.setattr(P, "RANGE", 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit(1) for c in ("id", "path", "code", "key", "depth", "n", "least")})
    assert rows_of(P.prefix_trie(df, max_turns=most)) == brute(rows)


def test_other_families(spark, rows):
    assert rows_of(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), family=3, most=4, max_turns=50)) == brute(rows, family=3, most=4)


def test_turnless_and_empty(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 1, "user", "gone: its family's first is absent")]
    assert rows_of(P.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == {(lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}
    void = spark.createDataFrame([(1,), (2,)], "conv_id long").withColumns({c: F.lit(None) for c in ("turn", "role", "text")})
    assert rows_of(P.prefix_trie(void)) == brute([(1, None, None, None), (2, None, None, None)])


def test_texts_of_nodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    paths = rebuilt(rows)
    for r in P.with_text(P.prefix_trie(df), df).collect():
        assert (r.role, r.text) == (paths[r.conv_id][r.depth - 1] if r.depth else (None, None))
