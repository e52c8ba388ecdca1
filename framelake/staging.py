"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_COUNTER = itertools.count()
#: Folders that are deleted when their application ends.
_LEAVING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests), a temporary folder is
    set; on a cluster that would not be shared, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framelake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; deleted when its driver ends."""
    sc = spark.sparkContext
    home = f"{shared_dir(spark)}/framelake/{sc.applicationId}"
    if home not in _LEAVING:
        p = sc._jvm.org.apache.hadoop.fs.Path(home)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _LEAVING.add(home)
    return home


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage, survives lost executors and keeps column
    pruning and filter pushdown for later readers.  What no step has deleted
    before goes when the application ends.
    """
    spark = df.sparkSession
    home = application_dir(spark)
    path = f"{home}/{name}-{next(_COUNTER)}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete everything that this application has staged; results not yet read are lost."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
