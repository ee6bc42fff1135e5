"""Connected components of a long edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut
from codeloom.operators.joins import hot_join

#: Steps alternate until the edges are stars; the number grows with the logarithm of the longest path.
MOST_STEPS = 60


def _shape(e: DataFrame) -> tuple[int, int, bool]:
    """Ends of the edges (u, v), the most at one node, and whether the edges are stars: each node but the centres has one edge, to a
    centre."""
    down = (F.col("u") > F.col("v")).cast("long")
    ends = e.select(F.inline(F.array(*[F.struct(F.col(n).alias("node"), a.alias("to"), b.alias("by")) for n, a, b in (("u", down, F.lit(0)), ("v", F.lit(0), down))])))
    nodes = ends.groupBy("node").agg(F.sum("to").alias("to"), F.sum("by").alias("by"), F.count(F.lit(1)).alias("times"))
    loose = (F.col("to") > 1) | ((F.col("to") > 0) & (F.col("by") > 0))
    rows, heaviest, some = nodes.agg(F.sum("times"), F.max("times"), F.max(loose)).first()
    return rows or 0, heaviest or 0, not some


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being its least reachable node.

    Each step keeps connectivity and one edge per node pair, until the edges are stars around the least node, which they may be from
    the start. Minima are aggregated before the shuffle, a node with very many neighbours is joined by broadcast, so it is no
    hot key, and each step is cut into the shared folder. Self loops are allowed; nulls are not."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MOST_STEPS):
        rows, heaviest, stars = _shape(e)
        if stars:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        # large star: every larger neighbour of u goes to u's least neighbour
        star = hot_join(both, least, ["u"], "times", rows, heaviest=heaviest).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(star.union(e.where("u = v")).distinct(), "large")
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        rows, heaviest = least.agg(F.sum("times"), F.max("times")).first()
        small = hot_join(large, least, ["u"], "times", rows, heaviest=heaviest).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u > v").union(e.where("u = v")).distinct(), "small")
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", "v").union(e.select("v", "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
