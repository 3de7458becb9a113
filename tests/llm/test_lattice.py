"""The lattice against the listing of all segmentations, the query against plain counting."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillage.llm import lattice as L
from tillage.llm import queries as Q

SCHEMA = "doc_id long, text string"


def ways(word, weights, least):
    """Every segmentation as (product of weights, pieces)."""
    if not word:
        return [(1.0, ())]
    out = []
    heads = [(word[:n], math.exp(weights[word[:n]]), (word[:n],)) for n in range(1, len(word) + 1) if word[:n] in weights]
    if word[0] not in weights:
        spelled = tuple(f"<0x{b:02X}>" for b in word[0].encode())
        heads.append((word[0], math.exp(sum(weights.get(x, least) for x in spelled)), spelled))
    for head, w, pieces in heads:
        out += [(w * rest, pieces + more) for rest, more in ways(word[len(head):], weights, least)]
    return out


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(12)
    alphabet = [*"abé日", L.SPACE]
    pieces = {*alphabet[:3], L.SPACE, *("".join(rng.choices(alphabet[:3], k=rng.randint(2, 4))) for _ in range(30)), L.SPACE + "ab", L.SPACE * 2, "<0xE6>", "<0x97>"}
    return {p: math.log(rng.random()) for p in sorted(pieces)}


def test_marginals_and_expectations(weights):
    lattice, least, rng = L.Lattice(weights, -1.0), min(weights.values()), random.Random(1)
    words = ["", "a", "日", "ab日ab", L.SPACE, "x"] + ["".join(rng.choices("abé日" + L.SPACE, k=rng.randint(1, 8))) for _ in range(150)]
    for word in words:
        every = ways(L.SPACE + word, weights, least)
        total = sum(w for w, _ in every)
        assert lattice.log_weight(word) == pytest.approx(math.log(total) if word else -1.0, rel=1e-12)
        if word:
            want, got = Counter(), {}
            for w, pieces in every:
                for x in pieces:
                    want[x] += w / total
            lattice.expect(word, 3, got)
            for x in want | got:
                assert got.get(x, 0) / L.PART / 3 == pytest.approx(want[x], abs=1e-5)


def test_long_word(weights):
    lattice = L.Lattice(weights, -1.0)
    assert -1e7 < lattice.log_weight("ab" * 100_000) < -1000
    lattice.expect("ab" * 100_000, 1, found := {})
    assert 100_000 < sum(found.values()) / L.PART < 200_001


def brute(rows, weights, rounds, prior, held):
    words = [((t or "").encode().lower().split() + [b""], held(i)) for i, t in rows]
    counts = Counter(w.decode() for ws, h in words if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    own = {x: prior * len(weights) * math.exp(w) for x, w in weights.items()}
    ends = 1 + (counts[""] if rounds else 0)

    def made(c):
        return {x: math.log(k / (sum(c.values()) + ends)) for x, k in c.items()}

    model, new = made(own), own
    for _ in range(rounds):
        new, least = Counter(own), min(model.values())
        for word, c in counts.items():
            if word:
                every = ways(L.SPACE + word, model, least)
                for w, pieces in every:
                    for x in pieces:
                        if x in own:
                            new[x] += c * w / sum(k for k, _ in every)
        model = made(new)
    end, least, out = math.log(ends / (ends + sum(new.values()))), min(model.values()), []
    for (i, _), (ws, h) in zip(rows, words):
        score = sum(math.log(sum(k for k, _ in ways(L.SPACE + w.decode(), model, least))) if w else end for w in ws)
        out.append((i, h, len(ws), sum(counts[w.decode()] > 0 for w in ws), n, sum(math.log10((counts[w.decode()] + 1) / (n + v + 1)) for w in ws), score / math.log(10)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rounds", "frequent"), [(1, L.FREQUENT), (2, 5), (0, 0)])
def test_score(spark, weights, rounds, frequent):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abé日AB", k=rng.randint(1, 5))) for _ in range(25)] + ["É", "a b", "x"]
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, "another a"), (None, "a B"), (70, None), (71, ""), (72, " \r\f "), (73, "ab " * 300)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "row", "word", "k", "held", "n_tokens", "base", "score", "key")})
    got = sorted([tuple(r) for r in L.score(df, weights, rounds=rounds, frequent=frequent).collect()], key=repr)
    want = brute(rows, weights, rounds, 1.0, held)
    assert [g[:5] for g in sorted(got, key=lambda r: repr(r[:5]))] == [w[:5] for w in sorted(want, key=lambda r: repr(r[:5]))]
    near = lambda rs: sorted((str(r[0]), r[2], round(r[5], 6), round(r[6], 3)) for r in rs)
    for g, w in zip(near(got), near(want)):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-3)


def test_nothing_to_learn_from(spark, weights):
    assert L.score(spark.createDataFrame([], SCHEMA), weights).count() == 0
    df = spark.createDataFrame([(1, "ab ab"), (2, None)], SCHEMA)
    got = {r.id: r for r in L.score(df, weights, held=F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == got[2].base_score == 0 and got[1].n_known == 0 and got[1].score < got[2].score < 0
    void = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.lit(None))
    assert L.score(void, weights).first().n_tokens == 1


def test_registered_vocabulary():
    weights = L.vocabulary(Q.PIECES)
    assert sum(map(math.exp, weights.values())) == pytest.approx(1) and len(weights) > 31_000 and weights["<0x00>"] == weights["<0xFF>"]
    assert weights[L.SPACE + "the"] > weights["q"]
