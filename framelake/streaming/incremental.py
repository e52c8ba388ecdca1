"""Resumable stages and streams: pending work, idempotent upserts, stateful sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.changes import upsert


def pending(work: DataFrame, done: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Work not done yet; with ``retry_failed``, rows of ``done`` with an ``error`` are due again."""
    d = done.where("error is null or error = ''") if retry_failed else done
    return work.join(d.select(key).distinct(), key, "left_anti")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], newest: Sequence[str], buckets: int = 16, mode: str = "append"):
    """Start a query that keeps the newest row of each key in ``table``; returns it.

    Keys are spread over ``buckets``.  A batch rewrites the buckets that its keys
    fall into, in a folder named by batch id; the others stay where they are.
    So a repeated batch overwrites its own work only, and the result is the same
    (exactly once by key).  Buckets that were replaced before the last batch are
    deleted.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, no: int) -> None:
        spread = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in spread.select("_bucket").distinct().collect())  # at most ``buckets``
        where = _bucket_paths(spark, table, before=no)
        old = _read_buckets(spark, [where[b] for b in touched if b in where], batch.schema)
        merged = upsert(old, batch, keys, newest).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/version={no:010d}")
        _drop_replaced(spark, table, no)

    return stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str, before: int | None = None) -> list[tuple[int, dict[int, str]]]:
    """Complete versions, oldest first, each with the paths of the buckets that it wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = path(table)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(path(f"{table}/{name}/_SUCCESS")):
            no = int(name.partition("=")[2])
            if before is None or no < before:
                inside = [x.getPath().getName() for x in fs.listStatus(s.getPath())]
                found.append((no, {int(x.partition("=")[2]): f"{table}/{name}/{x}" for x in inside if x.startswith("_bucket=")}))
    return sorted(found)


def _bucket_paths(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    return {b: at for _, written in _versions(spark, table, before) for b, at in written.items()}


def _read_buckets(spark: SparkSession, at: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def _drop_replaced(spark: SparkSession, table: str, no: int) -> None:
    """Delete what batches before ``no`` have replaced; what ``no`` itself replaces stays, in case it is run again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    keep = set(_bucket_paths(spark, table, before=no).values())
    for version, written in _versions(spark, table, before=no):
        for at in written.values():
            if at not in keep:
                p = path(at)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """The rows of a table written by ``upsert_stream`` or ``feedback``, as of its last complete batch (or the last before one)."""
    return _read_buckets(spark, sorted(_bucket_paths(spark, table, before).values()), schema)


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, keys: Sequence[str], slide: str | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window and keys, rows later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"))


def files_lateness(rows: DataFrame, time: str) -> int:
    """Seconds that a watermark must lag for no row of a folder's files to be late, if the files are read in order of modification.

    ``rows`` is a batch read of the files.  One row per file comes to the
    driver.  Files of one modification time may be read in any order; a row at
    the watermark itself would be late, so it lags by a second more.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    files = rows.where(F.col(time).isNotNull()).groupBy(F.col("_metadata.file_modification_time").alias("m")).agg(F.min(us).alias("a"), F.max(us).alias("b"), F.count_distinct("_metadata.file_path").alias("n"))
    most, seen = 0, None
    for r in sorted(files.collect(), key=lambda r: r["m"]):
        if r["n"] > 1:
            most = max(most, r["b"] - r["a"])
        if seen is not None:
            most = max(most, seen - r["a"])
        seen = r["b"] if seen is None else max(seen, r["b"])
    return -(-most // 1_000_000) + 1


def session_stream(stream: DataFrame, entity: str, time: str, gap_s: float, late: str) -> DataFrame:
    """``entity``, ``start``, ``end``, ``events`` of sessions that the watermark has closed.

    A step of exactly ``gap_s`` stays within a session (Spark's own session
    windows would close it).  State per entity is its open sessions, which the
    watermark bounds.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[entity].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for f in frames:
            spans += [(t, t, 1) for t in f["_t"]]
        merged: list[list] = []
        for a, b, n in sorted(spans):
            if merged and a - merged[-1][1] <= gap_s:
                merged[-1][1] = max(b, merged[-1][1])
                merged[-1][2] += n
            else:
                merged.append([a, b, n])
        mark = state.getCurrentWatermarkMs() / 1000
        closed = [m for m in merged if m[1] + gap_s < mark]
        still = [m for m in merged if m[1] + gap_s >= mark]
        if still:
            state.update(tuple(list(c) for c in zip(*still)))
            state.setTimeoutTimestamp(int((min(m[1] for m in still) + gap_s) * 1000) + 1 if (min(m[1] for m in still) + gap_s) * 1000 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({entity: [key[0]] * len(closed), "start": [m[0] for m in closed], "end": [m[1] for m in closed], "events": [m[2] for m in closed]})

    marked = stream.withWatermark(time, late).withColumn("_t", F.unix_micros(time) / 1_000_000)
    return marked.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, start double, end double, events bigint", "a array<double>, b array<double>, n array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def burst_stream(stream: DataFrame, entity: str, time: str, tie: str, gap_s: float, late: str, bits: str, most_bits: int = 20) -> DataFrame:
    """As ``session_stream``, with the second rule of ``windows.bursts``: rows in order of (time, tie) also part where their ``bits`` differ from the previous row's in more than ``most_bits``.

    ``tie`` and ``bits`` are bigint; null bits count as no difference.  State
    per entity is the times, ties and bits of the rows of open bursts, since a
    row that comes later may stand between them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[entity].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for f in frames:
            rows += zip(f["_t"].tolist(), f["_i"].tolist(), f["_h"].tolist())
        groups: list[list] = []
        for row in sorted(rows):
            if groups:
                t, _, h = groups[-1][-1]
                parted = row[2] != "" and h != "" and ((int(row[2]) ^ int(h)) & (1 << 64) - 1).bit_count() > most_bits
            if groups and row[0] - t <= gap_s and not parted:
                groups[-1].append(row)
            else:
                groups.append([row])
        mark = state.getCurrentWatermarkMs() / 1000
        closed = [g for g in groups if g[-1][0] + gap_s < mark]
        still = [g for g in groups if g[-1][0] + gap_s >= mark]
        if still:
            state.update(tuple(list(c) for c in zip(*[r for g in still for r in g])))
            state.setTimeoutTimestamp(max(int((still[0][-1][0] + gap_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({entity: [key[0]] * len(closed), "start": [g[0][0] for g in closed], "end": [g[-1][0] for g in closed], "events": [len(g) for g in closed]})

    # bits as text: pandas would make floats of a column with nulls
    marked = stream.withWatermark(time, late).withColumns({"_t": F.unix_micros(time) / 1_000_000, "_i": F.col(tie).cast("bigint"), "_h": F.coalesce(F.col(bits).cast("string"), F.lit(""))})
    return marked.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, start double, end double, events bigint", "t array<double>, i array<bigint>, h array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def feedback(stream: DataFrame, table: str, checkpoint: str, key: str, rebuild: Callable[[DataFrame], None], buckets: int = 16):
    """Add the ids of every batch to an override set and rebuild what depends on it; only the buckets of new ids are written."""
    spark = stream.sparkSession

    def add(batch: DataFrame, no: int) -> None:
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        ids = batch.select(key).where(f"{key} is not null").distinct()
        touched = sorted(r[0] for r in ids.select(place).distinct().collect())  # at most ``buckets``
        where = _bucket_paths(spark, table, before=no)
        old = _read_buckets(spark, [where[b] for b in touched if b in where], ids.schema)
        both = old.union(ids).distinct().withColumn("_bucket", place)
        both.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/version={no:010d}")
        _drop_replaced(spark, table, no)
        rebuild(current(spark, table, ids.schema))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
