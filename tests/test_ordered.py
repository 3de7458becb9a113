"""Operators along an order, with a group of half of all rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tillage.operators import ordered, relational as R


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(i, "hot" if i % 2 else rng.choice(["a", "b", None, ""]), rng.choice([None, 1, 2, 3, 50]), rng.choice([None, 0.5, 2.0, -1.0])) for i in range(1, 1200)]
    rng.shuffle(made)
    return made


def test_along(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, t int, v double").repartition(5)
    got = {r.id: (r.total, r.n, r.before) for r in ordered.along(df, ["g"], ["t", "id"], sums={"total": F.col("v"), "n": F.lit(1)}, lags={"before": "v"}).collect()}
    groups = {}
    for i, g, t, v in rows:
        groups.setdefault(g, []).append((t is None, t or 0, i, v))
    assert len(got) == len(rows)
    for own in groups.values():
        total, last = None, None
        for n, (_, _, i, v) in enumerate(sorted(own, key=lambda r: r[:3]), 1):
            total = total if v is None else v + (total or 0)
            assert got[i] == (total, n, last)
            last = v
    lagged = R.add_lag(df, "v", ["g"], ["t", "id"], "lagged").select("id", "lagged").collect()
    assert {r.id: r.lagged for r in lagged} == {i: x[2] for i, x in got.items()}
    assert ordered.along(df.limit(0), ["g"], ["t", "id"], sums={"n": F.lit(1)}).count() == 0


def test_a_hot_group_is_spread(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, t int, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so few rows would be one range
    try:
        parts = ordered.ranged(df, ["g", "t", "id"]).where("g = 'hot'").groupBy(ordered.PART).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) >= 2 and max(r["count"] for r in parts) < 0.4 * len(rows)


def test_places(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, t int, v double")
    got = {r.id: r.place for r in ordered.places(df, ["t", "g", "id"]).collect()}
    key = lambda r: (r[2] is None, r[2] or 0, r[1] is None, r[1] or "", r[0])
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    assert ordered.places(df.limit(0), ["id"]).count() == 0


def test_join_validated_in_its_run(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, l string")
    right = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    got = sorted(tuple(r)[1:] for r in R.join_features(left, right, ["k"], validate="in run").collect())
    assert got == [("x", "a"), ("y", "b"), ("z", None)]
    for repeated in ([(1, "a"), (1, "a")], [(None, "a"), (None, "b")]):
        for columns in (["k", "v"], ["k"]):
            bad = spark.createDataFrame(repeated, "k int, v string").select(*columns)
            with pytest.raises(Exception, match="not unique"):
                R.join_features(left, bad, ["k"], validate="in run").collect()
