"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.staging import stage, unstage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (lowest node) of every node of ``edges`` (``a``, ``b`` bigint).

    Large-star and small-star steps alternate until nothing changes, each round
    staged in the shared folder; rounds grow with the logarithm of the longest
    path.  Self loops, repeats and nulls are ignored.
    """
    now = stage(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of v is linked to the least of v and its neighbours
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: v and its smaller neighbours are linked to the least of these
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        nxt = large.join(small_least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("u < v").distinct()
        nxt = stage(nxt, "edges")
        state = nxt.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)).alias("x")).first()
        unstage(now)
        now = nxt
        if last == state:
            break
        last = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
