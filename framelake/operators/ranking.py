"""Fusing ranked lists, ordered unions, accounting of what went where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def borda(ballots: DataFrame, size: int) -> DataFrame:
    """``item``, ``points``, ``ballots`` from ranked lists (``ballot``, ``picks`` array): the p-th different pick gets size - p points (p from 0), none below 0."""
    picks = ballots.select("ballot", F.posexplode(F.array_distinct("picks")).alias("p", "item"))
    return picks.where(F.col("item").isNotNull()).groupBy("item").agg(F.sum(F.greatest(F.lit(0), F.lit(size) - F.col("p"))).alias("points"), F.count_distinct("ballot").alias("ballots"))


def borda_rows(votes: DataFrame, size: int) -> DataFrame:
    """As ``borda`` for votes as rows (``ballot``, ``item``, ``place`` from 0), for lists too long for an array."""
    firsts = votes.groupBy("ballot", "item").agg(F.min("place").alias("place"))
    return firsts.groupBy("item").agg(F.sum(F.greatest(F.lit(0), F.lit(size) - F.col("place"))).alias("points"), F.count("*").alias("ballots"))


def relative_position(rows: DataFrame, keys: Sequence[str], place: str, name: str = "position") -> DataFrame:
    """``place`` (from 0) as a share of its group: place / max(n - 1, 1)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.col(place) / F.greatest(n - 1, F.lit(1)))


def tiered_union(lists: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """All rows of the lists, each key once, from the first list that has it; ``tier`` is that list's number from 0."""
    out = None
    for i, df in enumerate(lists):
        df = df.withColumn("tier", F.lit(i))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy(key).orderBy("tier", *order)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def accounting(before: DataFrame, kept: DataFrame, now: DataFrame, cut: DataFrame, key: str) -> DataFrame:
    """Keys by fate: ``added`` (now, not before), ``removed`` (before, not now), ``rehomed`` (cut, yet still there), ``unaccounted`` (before or kept, neither now nor cut)."""
    ids = [df.select(key).distinct() for df in (before, kept, now, cut)]
    b, k, n, c = ids
    fate = lambda df, name: df.withColumn("fate", F.lit(name))
    return (
        fate(n.join(b, key, "left_anti"), "added")
        .unionByName(fate(b.join(n, key, "left_anti"), "removed"))
        .unionByName(fate(c.intersect(n), "rehomed"))
        .unionByName(fate(b.union(k).distinct().join(n, key, "left_anti").join(c, key, "left_anti"), "unaccounted"))
    )


def methods(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Each key with the sorted, comma-joined names of the sources that have it."""
    out = None
    for name, df in sources:
        df = df.select(key, F.lit(name).alias("_m"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("_m")), ",").alias("methods"))


def primary_group(members: DataFrame, key: str, group: str, place: str) -> DataFrame:
    """Each key's smallest group, ties by the group's place."""
    size = members.groupBy(group).agg(F.count_distinct(key).alias("_n"))
    return members.join(size, group).groupBy(key).agg(F.min_by(group, F.struct("_n", place, group)).alias(group))


def bijection(rows: DataFrame, rank: str, key: str) -> DataFrame:
    """One row with ``ok``: whether ranks are 1..n and keys unique."""
    s = rows.agg(F.count("*").alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("ranks"), F.count_distinct(key).alias("keys"))
    return s.select("n", ((F.col("n") == 0) | ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("ranks") == F.col("n")) & (F.col("keys") == F.col("n")))).alias("ok"))
