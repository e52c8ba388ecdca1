"""All pairs within groups, for results that ask for them: hot groups are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet in one place; larger groups are cut into chunks and each two chunks meet on their own.
CHUNK = 512


def pairs_within(members: DataFrame, group: str, chunk: int = CHUNK) -> DataFrame:
    """``id_a`` < ``id_b`` for every two different ids of a group.

    ``members``: the group, ``id`` (once in a group) and ``n``, the group's
    size.  A group of n sends n * n / chunk rows, so n * n / chunk^2 / 2 joins of at
    most about chunk^2 pairs share its work.
    """
    k = F.ceil(F.col("n") / chunk).cast("int")
    m = members.select(F.col(group).alias("g"), "id", k.alias("k"), F.pmod(F.xxhash64("id", F.lit(5)), k).cast("int").alias("c"))
    a = m.select("g", F.col("id").alias("ia"), F.col("c").alias("ca"), F.explode(F.sequence("c", F.col("k") - 1)).alias("cb"))
    b = m.select("g", F.col("id").alias("ib"), F.explode(F.sequence(F.lit(0), "c")).alias("ca"), F.col("c").alias("cb"))
    # few bytes make many pairs here, so adaptive execution must not put them into few tasks: the number of parts is fixed
    parts, keys = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["g", "ca", "cb"]
    met = a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).where("ca < cb or ia < ib")
    return met.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
