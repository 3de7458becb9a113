"""The shingle join against all pairs, and near copies that four bits of a fingerprint don't reach."""

import random

import numpy as np
import pytest

from tillage.llm import shingles, simhash


def grams(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def classes(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def made(rng):
    word = lambda: f"w{rng.randrange(900)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randint(3, 160))]
        if k % 4 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 30 if k == 7 else 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, "", "One two", "one  two"]


@pytest.mark.parametrize("small", [2, 64])
def test_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(shingles, "SMALL_BUCKET", small)
    monkeypatch.setattr(shingles, "BLOCK", 8)
    texts = made(random.Random(4))
    sets = [grams(t) for t in texts]
    want = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "key long, t string")
    got = [(r.a, r.b) for r in shingles.similar_texts(df).collect()]
    assert len(want) > 40 and classes(range(len(texts)), got) == classes(range(len(texts)), want)
    assert shingles.similar_texts(df.limit(0)).count() == 0


def test_stage_drops_near_copies(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(9)
    rows, far = [], 0
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        near = [*base]
        for at in (30, 90):
            near[at] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        assert jaccard(grams(rows[-1][1]), grams(rows[-2][1])) >= 0.8
        far += (simhash.fingerprint(rows[-1][1].encode()) ^ simhash.fingerprint(rows[-2][1].encode())).bit_count() > 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert far > 15 and sorted(r.doc_id for r in C.keep_one_of_each(spark, df, str(tmp_path)).collect()) == [2 * k for k in range(30)]


def test_nothing_similar_is_ruled_out():
    """Sketches, sizes and places against whole sets."""
    rng = np.random.default_rng(7)
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        kept = a[rng.random(len(a)) < rng.choice([0.8, 0.9, 0.97])]
        b = np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, int(rng.integers(0, max(1, n // 6))))]))
        if not len(b) or not shingles.similar(a, b, 0.8):
            continue
        assert shingles.may_be_similar(shingles.sketch(a), len(a), shingles.sketch(b), len(b), 0.8)
        x, y = shingles.prefix(a, np.zeros(0, np.int64), 0.8).tolist(), shingles.prefix(b, np.zeros(0, np.int64), 0.8).tolist()
        first = next(g for g in x if g in y)
        assert min(len(a) - x.index(first), len(b) - y.index(first)) >= shingles.needed_both(len(a), len(b), 0.8)
    many = np.arange(100_000, dtype=np.int64) * 256
    assert shingles.may_be_similar(shingles.sketch(many), len(many), shingles.sketch(many[: 90_000]), 90_000, 0.8)
