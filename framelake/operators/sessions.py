"""Sessions of activity parted by inactivity gaps.

Method: occupancy bitmaps.  Every entity's time line is cut into buckets of
2^15 seconds.  The JVM counts the events of each occupied second, combining
before the shuffle, so a lone event costs a row and not a bucket.  A task sets a
bucket's seconds in a bitmap, which is closed morphologically by
OR-ing it with copies of itself shifted by 1, 2, 4, ... up to the gap; the runs
of the closed bitmap are the bucket's sessions, whose ends are trimmed by the
gap.  Runs are then stitched across buckets: within chunks of buckets first,
after which only the first and last session of a chunk can still grow.  No
group's size depends on the number of events, so an entity that holds a third
of them, or one that never pauses, is no special case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.staging import stage

BITS = 15
SECONDS = 1 << BITS
#: Bitmaps closed at once; bounds a worker's memory.
SLICE = 256


def _shifted(m: np.ndarray, by: int) -> np.ndarray:
    """Every row's bits moved to later positions (bit i of word w is position 64 w + i)."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(m)
    width = m.shape[1]
    if words < width:
        out[:, words:] = m[:, : width - words] << np.uint64(bits)
        if bits and words + 1 < width:
            out[:, words + 1 :] |= m[:, : width - words - 1] >> np.uint64(64 - bits)
    return out


def closed_runs(bitmaps: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last set position of every run of the bitmaps closed by ``gap``.

    ``bitmaps`` is a uint64 matrix, one row per bitmap.  Set positions at most
    ``gap`` apart fall into one run.
    """
    reach = min(gap, SECONDS)
    pad = -(-reach // 64) + 1
    m = np.pad(bitmaps, ((0, 0), (0, pad)))
    covered = 1
    while covered < reach:
        step = min(covered, reach - covered)
        m |= _shifted(m, step)
        covered += step
    first = m & ~_shifted(m, 1)
    before = m >> np.uint64(1)
    before[:, :-1] |= m[:, 1:] << np.uint64(63)
    last = m & ~before
    unpack = lambda x: np.nonzero(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"))
    row, start = unpack(first)
    _, end = unpack(last)
    return row, start, end - (reach - 1)


def _bucket_runs(buckets: DataFrame, gap: int) -> DataFrame:
    """Runs of the closed bitmaps and their events; ``buckets``: ``entity``, ``bucket`` and its occupied ``seconds`` (``at`` in the bucket, ``n`` events)."""
    entity = buckets.schema["entity"].dataType

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, SLICE):
                part = b.slice(first, SLICE)
                flat = part.column(2).flatten()
                place = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy()) * SECONDS + flat.field("at").to_numpy()
                bitmaps = np.zeros(part.num_rows * (SECONDS // 64), dtype=np.uint64)
                np.bitwise_or.at(bitmaps, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
                row, start, end = closed_runs(bitmaps.reshape(part.num_rows, -1), gap)
                # runs come in order and every second is in one: join the counts by place
                of = np.searchsorted(row * SECONDS + start, place, side="right") - 1
                n = np.zeros(len(row), dtype=np.int64)
                np.add.at(n, of, flat.field("n").to_numpy())
                bucket = part.column(1).to_numpy(zero_copy_only=False)[row]
                zero = bucket << BITS
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(bucket), pa.array(zero + start), pa.array(zero + end), pa.array(n)], names=["entity", "bucket", "start", "end", "events"])

    schema = T.StructType([T.StructField("entity", entity), *[T.StructField(c, T.LongType()) for c in ("bucket", "start", "end", "events")]])
    return buckets.mapInArrow(run, schema)


def _stitch(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge neighbouring runs within ``keys``; ``edge`` marks the first and last of each key."""
    w = Window.partitionBy(*keys).orderBy("start")
    opens = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", opens).withColumn("_no", F.sum("_new").over(w))
    merged = numbered.groupBy(*keys, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"), F.min("bucket").alias("bucket"))
    return merged.withColumn("edge", (F.col("_no") == 1) | (F.col("_no") == F.max("_no").over(Window.partitionBy(*keys)))).drop("_no")


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """``entity``, ``start``, ``end``, ``duration``, ``events`` of every session (seconds, bigint).

    ``events``: ``entity``, ``t`` bigint seconds, ``id``; further columns are
    ignored.  A session ends where the entity's next event is more than ``gap``
    (at least 1) seconds later.  Rows with a null entity or time don't count; an
    id counts once at each time (a null id never, but its time does).  An empty
    table gives no rows.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    usable = events.where("entity is not null and t is not null").select("entity", "t", "id").distinct()
    counted = usable.groupBy("entity", "t").agg(F.count("id").alias("n"))
    buckets = counted.groupBy("entity", F.shiftright("t", BITS).alias("bucket")).agg(F.collect_list(F.struct(F.col("t").bitwiseAND(SECONDS - 1).cast("int").alias("at"), "n")).alias("seconds"))
    runs = _bucket_runs(buckets, gap)

    # chunks of 2^shift buckets: at most about 2^16 runs each, then two sessions for each part
    shift = max(0, min(10, (2 * (gap + 1)).bit_length() - 1))
    done, level = None, runs
    for s in [shift, *([shift + 10] if shift < 10 else [])]:
        level = level.withColumn("chunk", F.shiftright("bucket", s))
        level = stage(_stitch(level, ["entity", "chunk"], gap).drop("chunk"), "stitched")
        inner = level.where("not edge").drop("edge")
        done = inner if done is None else done.unionByName(inner)
        level = level.where("edge").drop("edge")
    out = _stitch(level, ["entity"], gap).drop("edge")
    return out.unionByName(done).select("entity", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "events")
