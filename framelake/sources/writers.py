"""Writers: fixed column order, upserts, scoped replacement."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.plans.changes import upsert


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV with a header in a fixed column order; an empty result still has a header (Spark writes it for one empty part)."""
    rows = df.select(*order)
    (rows.coalesce(1) if rows.isEmpty() else rows).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row result as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def rebuild(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace a table, partitioned by ``by``; within partitions rows are clustered so that each holds few files."""
    rows = df.repartition(*by) if by else df
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_scope(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str]) -> None:
    """Merge rows into the table at ``path`` by key.

    The new version is written beside the old one, which is moved aside, not
    deleted, until the new one is in its place; a run that was cut off in
    between is made good by the next.
    """
    at = path.rstrip("/")
    fs, p = _fs(spark, at)
    (_, following), (_, aside) = _fs(spark, at + ".next"), _fs(spark, at + ".old")
    if not fs.exists(p):
        if fs.exists(_fs(spark, at + ".next/_SUCCESS")[1]):
            fs.rename(following, p)
        elif fs.exists(aside):
            fs.rename(aside, p)
    merged = upsert(spark.read.parquet(at), new, keys, newest) if fs.exists(p) else upsert(new.limit(0), new, keys, newest)
    merged.write.mode("overwrite").parquet(at + ".next")
    fs.delete(aside, True)
    if fs.exists(p):
        fs.rename(p, aside)
    fs.rename(following, p)
    fs.delete(aside, True)


def backfill(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``values`` where it has one."""
    old = F.col(column) if column in rows.columns else F.lit(None)
    j = rows.join(values.select(key, F.col(column).alias("_new")), key, "left")
    return j.withColumn(column, F.coalesce("_new", old)).drop("_new")


def create_once(df: DataFrame, path: str) -> None:
    """Write a checkpoint; fails if it exists."""
    df.write.mode("errorifexists").parquet(path)


@F.pandas_udf(T.BinaryType())
def to_half(v: pd.Series) -> pd.Series:
    """Vectors as 16-bit floats, packed; ``readers.from_half`` reads them."""
    return v.map(lambda x: np.asarray(x, dtype="<f2").tobytes(), na_action="ignore")


def vector_files(df: DataFrame, path: str, rows_per_file: int = 20_000, half: str | None = None) -> None:
    """Shards of a fixed number of rows; the vector column ``half`` is packed to 16-bit floats."""
    df = df.withColumn(half, to_half(half)) if half else df
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def stale(listing: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """Outputs that nothing live refers to."""
    return listing.join(live.select(key).distinct(), key, "left_anti")


def append_log(df: DataFrame, path: str) -> dict:
    """Append levelled messages (``level``, ``message``) as tab-separated lines; returns ``lines``, ``warnings``, ``errors`` and ``write_error`` (the first, else None)."""
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("lines"), F.count_if(F.upper("level").startswith("WARN")).alias("warnings"), F.count_if(F.upper("level") == "ERROR").alias("errors"))
    try:
        counted.select(F.concat_ws("\t", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "level", "message").alias("value")).write.mode("append").text(path)
    except Exception as e:  # noqa: BLE001 - a log that can't be written must not stop the work
        return {"lines": 0, "warnings": 0, "errors": 0, "write_error": str(e)[:500]}
    return {**seen.get, "write_error": None}


class Contention(Exception):
    """What a sink raises when another writer is in its way."""


def gated(df: DataFrame, write_batch, size: int, tries: int = 3, rollback=None) -> DataFrame:
    """Hand rows to an external sink in batches; ``batch``, ``rows``, ``tries``, ``error`` come back.

    ``write_batch`` gets a list of dicts and must be idempotent by key, since a
    lost task is run again.  A batch that meets ``Contention`` is tried again, up
    to ``tries`` times; any other error, or the last try, hands its rows to
    ``rollback`` and goes on with the next batch.
    """

    def run(parts):
        n = 0
        for b in parts:
            for at in range(0, len(b), size):
                rows = b.iloc[at : at + size].to_dict("records")
                error, attempt, again = None, 0, True
                while again:
                    attempt += 1
                    try:
                        write_batch(rows)
                        error, again = None, False
                    except Contention as e:
                        error, again = str(e)[:500] or "contention", attempt < tries
                    except Exception as e:  # noqa: BLE001
                        error, again = str(e)[:500] or type(e).__name__, False
                if error is not None and rollback is not None:
                    rollback(rows)
                yield pd.DataFrame({"batch": [n], "rows": [len(rows)], "tries": [attempt], "error": [error]}).astype({"error": object})
                n += 1

    return df.mapInPandas(run, "batch bigint, rows bigint, tries bigint, error string")


def copy_files(files: DataFrame) -> DataFrame:
    """Copy each file (``src`` to ``dest``, paths all executors have mounted); ``src``, ``dest``, ``size``, ``state`` come back.

    A copy is written beside its place, checked against the size of its source
    and then moved there, so no other run sees half a file.  What is there in
    the right size already is ``present`` (a run that was cut off goes on), a
    different one is ``other`` and left alone; further states are ``copied``,
    ``missing`` (no source) and ``failed``.  Nothing is ever deleted.
    """

    def one(src: str, dest: str) -> tuple[int | None, str]:
        try:
            size = os.stat(src).st_size
        except OSError:
            return None, "missing"
        try:
            if os.path.exists(dest):
                return size, "present" if os.stat(dest).st_size == size else "other"
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            part = f"{dest}.{uuid.uuid4().hex[:8]}.part"
            shutil.copyfile(src, part)
            if os.stat(part).st_size != size:
                os.remove(part)
                return size, "failed"
            os.replace(part, dest)
            return size, "copied"
        except OSError:
            return size, "failed"

    def run(batches):
        for b in batches:
            got = [one(s.removeprefix("file:"), d.removeprefix("file:")) for s, d in zip(b["src"], b["dest"])]
            yield b.assign(size=pd.array([g[0] for g in got], dtype="Int64"), state=[g[1] for g in got])

    todo = files.where("src is not null and dest is not null").select("src", "dest").distinct()
    return todo.mapInPandas(run, "src string, dest string, size bigint, state string")


def first_success(rows: DataFrame, attempts: Sequence[tuple[str, Callable[[dict], str | None]]]) -> DataFrame:
    """``rows`` with ``made``, ``made_by``, ``made_error``: what the first attempt gave that neither raised nor gave None, and the last error of those before it.

    A failed row does not fail its task; without any success ``made_by`` is
    null.  Columns of these names in ``rows`` are seen by the attempts and
    replaced in the result.
    """
    new = ("made", "made_by", "made_error")
    kept = [f for f in rows.schema if f.name not in new]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                made = by = error = None
                for name, attempt in attempts:
                    try:
                        made = attempt(row)
                    except Exception as e:  # noqa: BLE001
                        error = f"{name}: {e}"[:500]
                    if made is not None:
                        by = name
                        break
                out.append((made, by, error))
            yield b[names].assign(**{c: pd.Series([o[i] for o in out], dtype=object, index=b.index) for i, c in enumerate(new)})

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInPandas(run, f"{head}made string, made_by string, made_error string")


def replace_where(old: DataFrame, new: DataFrame, scope) -> DataFrame:
    """``old`` without the rows in ``scope`` (a condition; null: not in it), and ``new``."""
    return old.where(~F.coalesce(scope, F.lit(False))).unionByName(new, allowMissingColumns=True)
