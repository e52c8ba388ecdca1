"""Readers with declared schemas."""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.vectors import unit
from framelake.staging import stage

#: Files that a task lists before it sends them on.
LISTED_ROWS = 10_000


def csv_rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred, malformed fields are null."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="PERMISSIVE", escape='"', multiLine=True)


def flag(text: str):
    """A CSV boolean: the text ``True`` in any case."""
    return F.lower(F.trim(F.col(text))) == "true"


def json_documents(spark: SparkSession, path: str | list[str], schema: str, key: str | None = None) -> DataFrame:
    """JSON files, an envelope ``result`` taken off; with ``key``, the record of the last file (by path) wins.

    Files may hold one object, an array or an object with the records under
    ``result``; ``_file`` names the file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value"))
    kind = T._parse_datatype_string(schema).simpleString()
    many = F.coalesce(
        F.from_json("value", f"struct<result:array<{kind}>>").result,
        F.array_compact(F.array(F.from_json("value", f"struct<result:{kind}>").result)),
    )
    body = F.when(F.size(many) > 0, many).otherwise(F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]"))), f"array<{kind}>"))
    rows = raw.select("_file", F.posexplode(body).alias("_at", "r")).select("_file", "_at", "r.*")
    if key is None:
        return rows.drop("_at")
    w = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_at"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_at")


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one of that schema if there is nothing."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


_LISTED = "path string, name string, size bigint, modified bigint, _raw binary, _folder boolean"


def file_listing(spark: SparkSession, path: str, skip: Sequence[str] = (), content: bool = False) -> DataFrame:
    """``path``, ``name``, ``size``, ``modified`` of all files below; names that begin with a dot and folders in ``skip`` are left out.

    Only what is below ``path`` (which may be a glob) is left out, not ``path``
    itself.  Links to folders are not followed; a link that leads nowhere has
    null ``size`` and ``modified``.  A folder that can't be read is an error.

    Spark's file sources leave out names that begin with ``_`` and empty files,
    so folders are rows here, and tasks list one level of them after the other;
    the folder is the same for all executors.  Where it is no mounted folder
    (another scheme than ``file``), the driver lists, and there is no ``content``.
    """
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    roots = [fs.getFileStatus(root)] if fs.exists(root) else list(fs.globStatus(root) or [])
    if not roots:
        raise FileNotFoundError(path)
    if fs.getUri().getScheme() != "file":
        if content:
            raise ValueError(f"content can only be read from a mounted folder, not from {path}")
        return _listed_by_driver(spark, fs, roots, skip)

    def entry(at: bytes, folder: bool) -> tuple:
        try:
            st = os.stat(at)
            size, modified = st.st_size, st.st_mtime_ns // 1000
        except OSError:
            size, modified = None, None
        text = at.decode("utf-8", "replace")
        return "file:" + text, text.rsplit("/", 1)[-1], size, modified, at, folder

    def table(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["path", "name", "size", "modified", "_raw", "_folder"])
        return df.astype({"size": "Int64", "modified": "Int64", "_folder": bool})

    def scan(batches):
        for batch in batches:
            rows = []
            for folder in batch["_raw"]:
                with os.scandir(bytes(folder)) as entries:
                    for e in entries:
                        into = e.is_dir(follow_symlinks=False)
                        if e.name.startswith(b".") or (into and e.name.decode("utf-8", "replace") in skip) or (not into and e.is_dir()):
                            continue
                        rows.append(entry(e.path, into))
                        if len(rows) >= LISTED_ROWS:
                            yield table(rows)
                            rows = []
            yield table(rows)

    def read(batches):
        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[k : k + 1]
                try:
                    with open(bytes(one["_raw"].iloc[0]), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield one.assign(content=[data])

    local = [(bytearray(r.getPath().toUri().getPath().encode()), r.isDirectory()) for r in roots]
    files = spark.createDataFrame([(at,) for at, folder in local if not folder], "_raw binary").mapInPandas(lambda bs: (table([entry(bytes(x), False) for x in b["_raw"]]) for b in bs), _LISTED)
    folders = spark.createDataFrame([(at,) for at, folder in local if folder], "_raw binary")
    while n := folders.count():
        level = stage(folders.repartition(min(n, 4 * sc.defaultParallelism)).mapInPandas(scan, _LISTED), "listing")
        files = files.unionByName(level.where("not _folder"))
        folders = level.where("_folder").select("_raw")
    files = files.drop("_folder")
    if content:
        files = files.mapInPandas(read, _LISTED.replace("_folder boolean", "content binary"))
    return files.withColumn("modified", F.timestamp_micros("modified")).drop("_raw")


def _listed_by_driver(spark: SparkSession, fs, roots: list, skip: Sequence[str]) -> DataFrame:
    rows, todo = [], []

    def take(s):
        at = s.getPath()
        rows.append((at.toString(), at.getName(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc)))

    for s in roots:
        todo.append(s.getPath()) if s.isDirectory() else take(s)
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if name.startswith(".") or (s.isDirectory() and name in skip) or (s.isSymlink() and fs.getFileStatus(s.getPath()).isDirectory()):
                continue
            todo.append(s.getPath()) if s.isDirectory() else take(s)
    return spark.createDataFrame(rows, "path string, name string, size bigint, modified timestamp")


def list_folders(folders: DataFrame) -> DataFrame:
    """``folder``, ``name``, ``failure``: the entries of each folder (one level), listed where the row is.

    A folder without entries is a row with a null name, one that can't be listed
    a row with its failure: ``absent``, ``not_a_folder`` or ``unreadable``.  The
    folders are paths of a file system that all executors have mounted.
    """

    def run(batches):
        for batch in batches:
            for folder in batch["folder"]:
                names, failure = [None], None
                try:
                    with os.scandir(folder.removeprefix("file:")) as entries:
                        names = sorted(e.name for e in entries) or [None]
                except FileNotFoundError:
                    failure = "absent"
                except NotADirectoryError:
                    failure = "not_a_folder"
                except (OSError, ValueError):
                    failure = "unreadable"
                yield pd.DataFrame({"folder": folder, "name": names, "failure": failure}).astype({"failure": object})

    return folders.where("folder is not null").select("folder").distinct().mapInPandas(run, "folder string, name string, failure string")


def folder_states(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """``folder``, ``state``, ``files``: ``listed``, or the failure that the listing table recorded (``absent``, ``not_a_folder``, ``unreadable``)."""
    n = listing.groupBy("folder").agg(F.count("name").alias("files"), F.max("failure").alias("failure"))
    j = folders.select("folder").distinct().join(n, "folder", "left")
    return j.select("folder", F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("files").isNull(), "absent").otherwise("listed").alias("state"), F.coalesce("files", F.lit(0).cast("bigint")).alias("files"))


def log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line``, ``file`` and ``at``, which orders the lines within a file and files by path."""
    t = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return t.select("line", "file", F.struct("file", "_b", "_i").alias("at"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(packed: pd.Series) -> pd.Series:
    """Vectors of ``writers.to_half``."""
    return packed.map(lambda b: np.frombuffer(bytes(b), dtype="<f2").astype(np.float32), na_action="ignore")


def by_pointer(pointers: DataFrame, shards: DataFrame) -> DataFrame:
    """Each pointer (``shard``, ``row``, further columns) with what the shard tables have in that row; pointers that lead nowhere are left out."""
    return pointers.join(shards, ["shard", "row"])


def vector_shards(shards: DataFrame, normalise: bool = True) -> DataFrame:
    """``id``, ``v`` of shard rows (``id``, ``v``, ``shard``): the later shard wins, vectors are scaled to length 1."""
    one = shards.groupBy("id").agg(F.max_by("v", "shard").alias("v"))
    return one.select("id", unit(F.col("v")).alias("v")) if normalise else one


def merged_sidecars(records: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """Maps of one key merged, entry by entry; later records override."""
    e = records.select(key, order, F.explode(values).alias("_k", "_v")).groupBy(key, "_k").agg(F.max_by("_v", order).alias("_v"))
    return e.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(values))
