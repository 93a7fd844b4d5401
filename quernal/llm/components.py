"""Connected components by contraction.

Each round every vertex moves to the neighbour (or itself) with the least priority, a hash of its id; edges then join
those parents, loops and doubles go, and so does every vertex without an edge. Random priorities shrink any graph by a
constant factor per round, long paths too, so rounds grow with the logarithm of the size. Each round's tables are
written to the shared folder. The moves are then followed from the last round back to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import materialize, release

#: No graph that fits a cluster needs as many.
MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each vertex of edges (a, b: long); component is the smallest vertex of v's component."""
    live = materialize(_tidy(edges.select("a", "b")), "edges")
    moves: list[DataFrame] = []
    while live.limit(1).count():
        if len(moves) >= MOST_ROUNDS:
            raise RuntimeError("components did not converge")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda x: F.struct(F.xxhash64(x).alias("rank"), F.col(x).alias("v"))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        up = up.select(F.col("a").alias("v"), F.when(F.col("near") < rank("a"), F.col("near.v")).otherwise(F.col("a")).alias("parent"))
        up = materialize(up, "moves")
        moves.append(up)
        moved = live.join(up.toDF("a", "pa"), "a").join(up.toDF("b", "pb"), "b")
        old, live = live, materialize(_tidy(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        release(old)
    release(live)
    if not moves:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("component")).limit(0)
    roots = moves[-1].select("v", F.col("parent").alias("root"))
    for up in reversed(moves[:-1]):
        later = roots.toDF("parent", "later")
        roots = up.join(later, "parent", "left").select("v", F.coalesce("later", "parent").alias("root"))
    roots = materialize(roots, "roots")
    for up in moves:
        release(up)
    least = roots.groupBy("root").agg(F.min("v").alias("component"))
    return roots.join(least, "root").select("v", "component")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
