import os

import pytest
from pyspark.sql import functions as F

from framelake.streaming import incremental as inc


def test_pending(spark):
    w = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    d = spark.createDataFrame([(1, None), (2, "broken")], "id int, error string")
    assert {r["id"] for r in inc.pending(w, d, "id").collect()} == {3}
    assert {r["id"] for r in inc.pending(w, d, "id", retry_failed=True).collect()} == {2, 3}


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return inc.file_stream(spark, folder, schema_of(spark, schema))


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_upsert_stream_is_idempotent(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    s = feed(spark, src, [[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(2, 0, "late")]], "id int, v int, x string")
    inc.upsert_stream(s, table, str(tmp_path / "cp"), ["id"], ["v"]).awaitTermination()
    want = {(1, 2, "c"), (2, 1, "b")}
    now = lambda: {tuple(r) for r in inc.current(spark, table, s.schema).collect()}
    assert now() == want
    inc.upsert_stream(s, table, str(tmp_path / "cp"), ["id"], ["v"]).awaitTermination()  # nothing new
    assert now() == want
    inc.upsert_stream(s, table, str(tmp_path / "cp2"), ["id"], ["v"]).awaitTermination()  # all of it again
    assert now() == want


def test_session_stream_keeps_the_gap_boundary(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 1000), (1, 1010), (1, 1021), (2, 1005), (1, 1500), (2, 1500)]
    schema = "u bigint, t bigint"
    s = feed(spark, src, [[r] for r in rows], schema).select("u", F.timestamp_seconds("t").alias("ts"))
    q = inc.session_stream(s, "u", "ts", 10, "30 seconds")
    q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["u"], r["start"], r["end"], r["events"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1000.0, 1010.0, 2), (1, 1021.0, 1021.0, 1), (2, 1005.0, 1005.0, 1)}


def test_burst_stream_equals_bursts(spark, tmp_path):
    from framelake.operators import windows as wn

    far = (1 << 21) - 1  # 21 bits
    rows = [[(1, 1000, 1, 0), (1, 1004, 3, far), (2, 1000, 1, -1)], [(1, 1002, 2, 1), (1, 1004, 2, 0), (2, 1009, 2, None), (2, 1010, 3, 0)], [(1, 1014, 5, far), (1, 1016, 6, far >> 1), (2, 1011, 4, -1)], [(1, 9000, 7, 0), (2, 9000, 7, 0)], [(1, 9900, 8, 0), (2, 9900, 8, 0)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = feed(spark, src, rows, "u bigint, t bigint, i bigint, h bigint").withColumn("ts", F.timestamp_seconds("t"))
    q = inc.burst_stream(s, "u", "ts", "i", 10, "30 seconds", "h")
    q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("u", "start", "end", "events").collect() if r["end"] < 9000)
    batch = wn.bursts(spark.createDataFrame([r for b in rows for r in b if r[1] < 9000], "u bigint, t bigint, i bigint, h bigint"), ["u"], "t", "i", 10, "h")
    want = sorted(tuple(r) for r in batch.groupBy("u", "burst").agg(F.min("t").cast("double").alias("a"), F.max("t").cast("double").alias("b"), F.count("*").alias("n")).select("u", "a", "b", "n").collect())
    assert got == want and len(want) == 4


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (1, 1, 1, 1)])
def test_stream_sessions_of_files_that_overlap_in_time(spark, tmp_path, order):
    from framelake.plans.catalog import QUERIES

    files = [[(1, 0), (1, 3000), (2, 100)], [(1, 6000), (1, 90000), (2, 90000)], [(1, 5999), (2, 3700), (1, 93601), (3, -50)], [(1, 250000), (2, 250000), (1, 97202)]]
    folder = tmp_path / "events.parquet"
    for k, rows in enumerate(files):
        spark.createDataFrame([(u, t, 1000 * k + i) for i, (u, t) in enumerate(rows)], "user_id bigint, t bigint, event_id bigint").select("user_id", F.timestamp_seconds("t").alias("ts"), "event_id").coalesce(1).write.parquet(str(tmp_path / str(k)))
        folder.mkdir(exist_ok=True)
        for p in (tmp_path / str(k)).glob("*.parquet"):
            os.utime(p, (1_700_000_000 + 10 * order[k],) * 2)
            p.rename(folder / f"{k}.parquet")
    want, last = [], {}
    for u, t in sorted(r for rows in files for r in rows):
        if u in last and t - last[u][2] <= 3600:
            last[u][2:] = [t, last[u][3] + 1]
        else:
            last[u] = [u, t, t, 1]
            want.append(last[u])
    got = {tuple(r) for r in QUERIES["stream_sessions"](spark, str(tmp_path)).collect()}
    assert got == {tuple(x) for x in want}


def test_feedback_adds_and_rebuilds(spark, tmp_path):
    src, built = str(tmp_path / "in"), []
    s = feed(spark, src, [[(1,), (None,)], [(2,), (1,)]], "id bigint")
    inc.feedback(s, str(tmp_path / "set"), str(tmp_path / "cp"), "id", lambda df: built.append(sorted(r["id"] for r in df.collect()))).awaitTermination()
    assert built[-1] == [1, 2] and len(built) == 2


def test_windows(spark, tmp_path):
    s = feed(spark, str(tmp_path / "in"), [[("a", 0), ("a", 59), ("b", 61)]], "k string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    w = inc.windowed_counts(s, "ts", "0 seconds", "1 minute", ["k"])
    w.writeStream.format("memory").queryName("w_test").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("w_test").collect()} == {("a", 2), ("b", 1)}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    import os

    from framelake.streaming import incremental as inc

    src, table = f"{tmp_path}/in", f"{tmp_path}/table"
    schema = "k bigint, v bigint, t bigint"
    for no, rows in enumerate([[(k, 0, 0) for k in range(200)], [(5, 1, 1), (5, 0, -1)], [(5, 2, 2)], [(900, 3, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        inc.upsert_stream(inc.file_stream(spark, src, spark.createDataFrame([], schema).schema), table, table + "-log", ["k"], ["t"]).awaitTermination()
    got = {r["k"]: r["v"] for r in inc.current(spark, table, spark.createDataFrame([], schema).schema).collect()}
    assert got == {k: 0 for k in range(200)} | {5: 2, 900: 3}
    folders = {v: sum(x.startswith("_bucket=") for x in os.listdir(f"{table}/{v}")) for v in sorted(os.listdir(table)) if v.startswith("version=")}
    assert list(folders.values())[1:] in ([0, 1, 1], [1, 1, 1]) and 14 <= list(folders.values())[0] <= 16
