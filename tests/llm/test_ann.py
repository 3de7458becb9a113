import numpy as np
from pyspark.sql import functions as F

from tillage.llm import ann


def brute(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            near = sorted(((-float(np.cumsum(q * v)[-1]), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("v", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_recall_on_clusters_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 64))
    data = (centres[rng.integers(0, 8, 900)] + rng.standard_normal((900, 64)) * 0.4).astype(np.float32)
    data[100:140] = data[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got, want = search(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.98
    exact = {(q, x[1]): x[2] for q in want for x in want[q]}
    assert all(exact.get((q, x[1]), x[2]) == x[2] for q in got for x in got[q])


def test_estimates_are_population_counts_within_their_bounds():
    rng = np.random.default_rng(3)
    for dims in (7, 64, 100):
        v, q = rng.standard_normal((500, dims)) + 0.5, rng.standard_normal((30, dims))
        codes = ann.Codes(v.mean(axis=0))
        packed, norm, aligned = codes.encode(v)
        rounded, words = ann.Rounded(q @ codes.rotation), ann.words_of(packed)
        signs = (np.unpackbits(packed, axis=1, count=dims) * 2.0 - 1) / np.sqrt(dims)
        levels = sum(np.unpackbits(p.T.copy().view(np.uint8), axis=1, count=dims).astype(int) << j for j, p in enumerate(rounded.planes))
        one = np.ones(500)
        got = rounded.products(slice(0, 30), words, np.bitwise_count(words).sum(axis=0, dtype=np.int64), one, np.zeros(30))
        assert np.allclose(got, (rounded.low[:, None] + rounded.step[:, None] * levels) @ signs.T, atol=1e-5)
        error = np.abs(got * (norm / aligned) + (q @ codes.centre)[:, None] - q @ v.T)
        lengths = np.linalg.norm(q, axis=1)
        bound = (lengths[:, None] * np.sqrt(1 - aligned**2) + rounded.rest[:, None]) * norm / aligned * ann.EPSILON / np.sqrt(dims - 1)
        assert (error <= bound).mean() > 0.93


def test_blocks_of_queries(spark, monkeypatch):
    """Several blocks, of which some are empty, give the answers of one."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 16)).astype(np.float32))]
    want = search(spark, rows)
    monkeypatch.setattr(ann, "QUERY_BLOCK_BYTES", 128)
    assert search(spark, rows) == want and len(want) == 6 and search(spark, rows + rows) .keys() == want.keys()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (20, [0.0, 2.0]), (40, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 1.0])]
    assert search(spark, rows) == brute(rows) == {0: [(1, 1, 0.5), (2, 20, 0.0)], 20: [(1, 1, 1.0), (2, 0, 0.0)], 40: []} or search(spark, rows) == {k: v for k, v in brute(rows).items() if v}
    assert search(spark, []) == {}
