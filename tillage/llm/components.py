"""Connected components by alternating large-star and small-star steps, all of it on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import cut, drop_cut, lookup


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """large: neighbours greater than u move to the least of u's neighbourhood; else the others do. n: edges at most.
    The edges are a cut, which is dropped.

    Minimums combine on the map side; edges then look theirs up, those of hubs without a shuffle to one task. No
    neighbour list is ever built, so a hub costs no more than its edges. Minimums and star are cut each: every plan
    scans files, where a round in one plan would hold the first star's scans and joins over and over.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    linked = lookup(both, least, ["u"], "n", 2 * n if large else n, F.xxhash64("v"))
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b")
    star = cut(moved.distinct())
    drop_cut(least)
    drop_cut(edges)
    return star


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, root): every node of an edge with the least node it reaches.

    Edges with a null end and loops are ignored; no edges give no rows. The number of rounds is logarithmic.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(rounds):
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not row[0] or tuple(row) == mark:
            break
        mark = tuple(row)
        edges = _star(_star(edges, True, row[0]), False, row[0])
    else:
        raise RuntimeError("components did not settle")
    # settled: stars, each node pointing at its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
