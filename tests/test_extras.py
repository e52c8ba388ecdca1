import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import pixels
from framelake.operators import model, relational, similarity
from framelake.operators import windows as wn
from framelake.sources import sqlite, writers


def test_sqlite_snapshot_and_scan(spark, tmp_path):
    live, copy = str(tmp_path / "live.db"), str(tmp_path / "copy.db")
    db = sqlite3.connect(live)
    db.execute("pragma journal_mode=wal")
    db.execute("create table t (id integer primary key, x real, s text)")
    db.executemany("insert into t values (?, ?, ?)", [(i, i / 2, None if i % 5 == 0 else f"s{i}") for i in range(1, 1001)])
    db.execute("create table empty (id integer)")
    db.commit()
    with pytest.raises(Exception, match="snapshot"):
        sqlite.sqlite_table(spark, live, "t", "id bigint").count()
    sqlite.snapshot(live, copy, pages=3)
    with pytest.raises(FileExistsError):
        sqlite.snapshot(live, copy)
    db.close()
    t = sqlite.sqlite_table(spark, copy, "t", "s string, id bigint, x double", partitions=3)
    assert t.agg(F.count("*"), F.sum("id"), F.sum("x"), F.count("s"), F.count_distinct("id")).first() == (1000, 500500, 250250.0, 800, 1000)
    assert sqlite.sqlite_table(spark, copy, "empty", "id bigint").count() == 0


def test_pixels(spark):
    rng = np.random.default_rng(0)
    flat, noise = np.full((40, 60, 3), 250, np.uint8), rng.integers(0, 256, (60, 40, 3), np.uint8)
    rows = [(1, bytearray(flat.tobytes()), 60, 40), (2, bytearray(noise.tobytes()), 40, 60), (3, None, 1, 1), (4, bytearray(b"abc"), 9, 9), (5, bytearray(b"abc"), None, 1)]
    got = {r["id"]: r["m"] for r in spark.createDataFrame(rows, "id int, p binary, w int, h int").select("id", pixels.image_measures(F.col("p"), F.col("w"), F.col("h")).alias("m")).collect()}
    assert got[1]["lap_var"] < 1e-9 and got[1]["luma"] == pytest.approx(250) and got[1]["clip_bright"] == 1 and got[1]["contrast"] < 1e-9
    assert got[2]["sharp_max"] >= got[2]["sharp_top3"] >= got[2]["sharp_median"] > 0 and len(got[2]["phash"]) == 16
    assert all(got[i]["luma"] is None and got[i]["phash"] is None for i in (3, 4, 5))
    brighter = np.clip(noise.astype(int) // 2 + 60, 0, 255)
    a, b = pixels.perceptual_hash(noise[..., 0].astype(float)), pixels.perceptual_hash(brighter[..., 0].astype(float))
    assert bin(a ^ b).count("1") <= 6
    codes = spark.createDataFrame([(6, "BC"), (None, None), (9, "??")], "n int, c string").select(pixels.exif_code(F.col("n")), pixels.turn(F.col("c"))).collect()
    assert [tuple(r) for r in codes] == [("BC", "clockwise"), ("AB", "none"), ("AB", "none")]


def test_demote_near_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, "ab"[i % 2], int(rng.integers(0, 400)), float(rng.integers(0, 5)), bool(rng.random() < 0.1), [float(x) for x in v[i]]) for i in range(120)]

    def brute(width, cutoff):
        out = set()
        for g in "ab":
            order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
            gone = set()
            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    if a[0] in gone or b[2] - a[2] > width:
                        break
                    if b[0] not in gone and np.dot(a[5], b[5]) >= cutoff:
                        lose, win = (a, b) if b[3] > a[3] else (b, a)
                        if not lose[4]:
                            gone.add(lose[0])
                            out.add((lose[0], win[0]))
        return out

    df = spark.createDataFrame(rows + [(900, "a", None, 1.0, False, [1.0, 0.0, 0.0]), (901, "a", 5, None, None, None)], "id bigint, k string, t bigint, s double, star boolean, v array<double>").repartition(5)
    for width, cutoff in ((30, 0.8), (100, 0.5), (0, -1.0)):
        assert {tuple(r) for r in similarity.demote_near(df, ["k"], "t", width, cutoff, "s", "star").collect()} == brute(width, cutoff)


def _demoted(rows, width, cutoff):
    """Brute force over rows (id, t, score, star, v)."""
    order, gone, out = sorted(rows, key=lambda r: (r[1], r[0])), set(), set()
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[0] in gone or b[1] - a[1] > width:
                break
            if b[0] not in gone and np.dot(a[4], b[4]) >= cutoff:
                lose, win = (a, b) if b[2] > a[2] else (b, a)
                if not lose[3]:
                    gone.add(lose[0])
                    out.add((lose[0], win[0]))
    return out


def test_near_demotions_over_the_whole_table(spark, tmp_path):
    from framelake.plans.catalog import QUERIES

    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 24))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    labels = [int(x) for x in rng.integers(0, 10, 400)]
    spark.createDataFrame([(i, labels[i], [float(x) for x in v[i]]) for i in range(400)], "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = _demoted([(i, i, float(labels[i]), labels[i] == 9, v[i].astype(float)) for i in range(400)], 20, 0.2)
    got = [tuple(r) for r in QUERIES["near_demotions"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(a // 50 != b // 50 for a, b in got)


def test_demote_near_across_batches_and_stretches(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, float(rng.integers(-300, 300)) / 4, float(rng.integers(0, 5)), bool(rng.random() < 0.1), [float(x) for x in v[i]]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, t double, s double, star boolean, v array<double>").repartition(5)
    size, span = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), similarity.STRETCH
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        for stretch, width, cutoff in ((1, 2.0, 0.7), (3, 1.0, 0.9), (50, 0.25, 0.5), (2, 0, -1.0), (1, 40.0, 0.97)):
            similarity.STRETCH = stretch
            got = [tuple(r) for r in similarity.demote_near(df, [], "t", width, cutoff, "s", "star").collect()]
            assert len(got) == len(set(got)) and set(got) == _demoted(rows, width, cutoff)
    finally:
        similarity.STRETCH = span
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert similarity.demote_near(df.limit(0), [], "t", 1, 0.5, "s", "star").count() == 0


def test_small_relational_helpers(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, None)], "k int, p int, good boolean")
    assert {(r["k"], r["p"]) for r in relational.first_where(df, ["k"], F.col("good"), "p").collect()} == {(1, 2), (2, 1)}
    v = spark.createDataFrame([(1, "keep"), (2, "skip"), (3, "x")], "id int, verdict string")
    assert {r["id"]: r["verdict"] for r in relational.override(v, v.where("id < 3"), "id", "verdict", "in", "out", ["skip"]).collect()} == {1: "in", 2: "skip", 3: "out"}
    n = relational.normalised(spark.createDataFrame([(" a ", 3.7, "RED"), (" ", 9.0, "puce"), (None, None, None)], "t string, r double, c string"), ["t"], {"r": (1, 5)}, {"c": ["red"]})
    assert [(r["t"], r["r"], r["c"], r["warnings"]) for r in n.collect()] == [("a", 3, "red", []), (None, None, None, ["r", "c"]), (None, None, None, [])]
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert {r["id"] for r in writers.replace_where(old, spark.createDataFrame([(9, "n")], old.schema), F.col("s") == "a").collect()} == {2, 9}


def test_pages_and_slots(spark):
    df = spark.range(23)
    assert [r["id"] for r in wn.page(df, [F.col("id")], 2, 10).collect()] == [20, 21, 22]
    s = {r["id"]: (r["sheet"], r["slot"]) for r in wn.slots(df, [F.col("id")]).collect()}
    assert s[0] == (0, "A") and s[8] == (0, "I") and s[9] == (1, "A") and s[22] == (2, "E")
    r = wn.ranked(df, [F.col("id")])
    assert sorted(x["rank"] for x in wn.around_rank(r, "rank", 99, 3).collect()) == [23]
    assert [x["deferred"] for x in wn.limited(df, [F.col("id")], 20).orderBy("id").collect()].count(True) == 3
    m = spark.createDataFrame([("b", 3), ("a", 1), ("b", 5), ("c", 0), ("a", 9)], "k string, at int")
    assert [(x["k"], x["n"]) for x in wn.most_common(m, "k", "at", 2).collect()] == [("a", 2), ("b", 2)]


def test_mlp(spark):
    w = [([[1.0, 2.0], [0.0, 1.0]], [0.5, 0.0]), ([[1.0, -1.0]], [0.25])]
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(model.mlp(w)("v")).collect()] == [pytest.approx(1 + 4 + 0.5 - 2 + 0.25), None]
