"""The N highest-scoring items of every group.

Method: descending score bands.  The scores are cut into range-partitioned
bands at common quantiles; bands are worked through from the top, groups that
are filled by the bands above are anti-joined away, and the items collected
for the rest are ranked exactly at the end.  Within a band every task first
cuts each group to its own N best, so a group of any size sends at most N rows
per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.staging import stage, unstage


def top_n(items: DataFrame, n: int, least: int = 1, bands: int = 3) -> DataFrame:
    """``grp``, ``id``, ``score``, ``rank`` (1..n) of the n best items of every group with at least ``least`` items.

    ``items`` has ``grp``, ``id``, ``score`` double; further columns are
    ignored.  Rows with a null group or id or a null or NaN score don't count;
    repeated (grp, id) rows count once, with their highest score.  Equal scores
    rank by id.  An empty table gives no rows.
    """
    usable = items.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    base = stage(usable.groupBy("grp", "id").agg(F.max("score").alias("score")), "items")
    edges = base.agg(F.percentile_approx("score", [1 - (i + 1) / bands for i in range(bands - 1)], 1000).alias("q")).first()["q"] if bands > 1 else []
    edges = sorted(set(edges or []), reverse=True)
    sized = stage(base.groupBy("grp").count().where(F.col("count") >= least).select("grp"), "groups") if least > 1 else None
    best = Window.partitionBy("grp").orderBy(F.desc("score"), "id")

    taken, filled = None, None
    for i in range(len(edges) + 1):
        band = base
        if i:
            band = band.where(F.col("score") < edges[i - 1])
        if i < len(edges):
            band = band.where(F.col("score") >= edges[i])
        # the window's group limit keeps n rows of a group per task before anything is sent
        band = band.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r")
        if sized is not None:
            band = band.join(sized, "grp", "left_semi")
        if filled is not None:
            band = band.join(filled, "grp", "left_anti")
        band = stage(band, "band")
        taken = band if taken is None else taken.unionByName(band)
        if i < len(edges):
            filled = stage(taken.groupBy("grp").count().where(F.col("count") >= n).select("grp"), "filled")
    unstage(sized)
    return taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("grp", "id", "score", "rank")
