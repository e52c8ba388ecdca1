"""Physical helpers: size-checked broadcasts and global positions without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.staging import stage

#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes up to which a side with rows of any length is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows.

    The rows are counted (a limit stops the count early), so ``df`` should be
    cheap to evaluate: a scan or a staged table.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def broadcast_if_light(df: DataFrame, size: Column, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``size``, the bytes of a row, sums to at most ``max_bytes``; ``df`` should be a staged table."""
    held = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= max_bytes else df


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Range-partition and sort ``df``; adds ``_part`` and ``_row`` (position in the part).

    The table is staged, since range bounds are sampled and a second
    evaluation could draw other bounds.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    return stage(rows, name)


def part_offsets(sorted_rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Sum of ``value`` in all earlier parts, per part and ``keys``: at most parts x keys-in-a-part rows."""
    sums = sorted_rows.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))


def global_position(sorted_rows: DataFrame) -> DataFrame:
    """Add ``_pos``, the 0-based position in the whole order, to a ``range_sorted`` table."""
    before = part_offsets(sorted_rows, [], F.lit(1).cast("bigint"))
    return sorted_rows.join(F.broadcast(before), "_part").withColumn("_pos", F.col("_before") + F.col("_row")).drop("_before")


def running_sum(sorted_rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of equal ``keys`` up to and with each row of a ``range_sorted`` table.

    Null keys are a key of their own.  A key may span any number of parts; one row per part and key is all that meets elsewhere.
    """
    w = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = sorted_rows.withColumn("_own", F.sum(value).over(w))
    before = part_offsets(sorted_rows, keys, value).withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(["_part", *keys])})
    on = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(["_part", *keys])]
    drop = ["_own", "_before", *[f"_s{i}" for i in range(len(keys) + 1)]]
    return own.join(before, on).withColumn(name, F.col("_own") + F.col("_before")).drop(*drop)


def group_position(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``_pos``, the 0-based position among the rows of equal ``keys``, without bringing a key to one task."""
    data = range_sorted(rows, [*map(F.col, keys), *order], name)
    return running_sum(data, keys, F.lit(1).cast("bigint"), "_pos").withColumn("_pos", F.col("_pos") - 1).drop("_part", "_row")
