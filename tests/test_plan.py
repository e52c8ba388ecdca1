from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.plans import changes as ch

RULES = {"rating": "raise", "pick": "if_zero", "label": "fill_blank", "title": "set"}


def plan(want, now):
    return ch.plan(want, now, "id", RULES, protected=F.col("pick") == -1, still_allowed=["title"], unreadable="failed")


def states(spark):
    now = spark.createDataFrame([(1, 5, 0, "", "t", []), (2, None, 1, None, None, []), (3, 0, -1, "", "", []), (4, 0, 0, "red", "t", ["title", "rating"]), (5, 1, 0, "", "x", None)], "id int, rating int, pick int, label string, title string, failed array<string>")
    want = spark.createDataFrame([(1, 3, 1, "blue", "t"), (2, 3, 1, "blue", "n"), (3, 5, 1, "blue", "n"), (4, 4, 1, "blue", "n"), (9, 5, 1, "b", "n")], "id int, rating int, pick int, label string, title string")
    return want, now


def test_rules_and_convergence(spark):
    want, now = states(spark)
    p = plan(want, now)
    assert {(r["id"], r["field"], r["new"]) for r in p.collect()} == {(1, "pick", "1"), (1, "label", "blue"), (2, "rating", "3"), (2, "label", "blue"), (2, "title", "n"), (3, "title", "n"), (4, "pick", "1")}
    after = ch.apply(now, p, "id", list(RULES))
    assert after.count() == 5 and plan(want, after).count() == 0


def test_compare_and_set_skips_what_changed_meanwhile(spark):
    want, now = states(spark)
    p = plan(want, now)
    moved = now.withColumn("title", F.when(F.col("id") == 2, "mine").otherwise(F.col("title")))
    assert ch.apply(moved, p, "id", list(RULES)).where("id = 2").first()["title"] == "mine"
    assert ch.apply(moved, p, "id", list(RULES), expect_old=False).where("id = 2").first()["title"] == "n"


def test_hierarchy(spark):
    df = spark.createDataFrame([("A|B|C",), ("A|B",), ("D",), (None,), ("",)], "p string")
    got = {r["node"]: (r["parent"], r["depth"], r["is_leaf"], r["below"]) for r in ch.hierarchy(df, "p", "|").collect()}
    assert got == {"A": (None, 1, False, 2), "A|B": ("A", 2, True, 2), "A|B|C": ("A|B", 3, True, 1), "D": (None, 1, True, 1)}
    nodes = spark.createDataFrame([("a", 1), ("a/b", 2), ("c", 1), ("c/d", 2)], "node string, depth int")
    have, failed = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("c",)], "node string")
    assert {r["node"]: r["state"] for r in ch.creation_order(nodes, have, failed).collect()} == {"a/b": "create", "c": "blocked", "c/d": "blocked"}


def test_additions_ignore_case(spark):
    d = spark.createDataFrame([(1, "Sea"), (1, "sea"), (1, "Sky"), (2, None)], "id int, m string")
    c = spark.createDataFrame([(1, "SKY")], "id int, m string")
    assert [tuple(r) for r in ch.additions(d, c, "id", "m").collect()] == [(1, "Sea")]


def test_upsert_rounds_and_corrections(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, None, "e")], "id int, v int, x string")
    assert {tuple(r) for r in ch.upsert(old, new, ["id"], ["v"]).collect()} == {(1, 1, "c"), (2, 5, "b"), (3, None, "e")}
    r = spark.createDataFrame([(1, 1, "a", ["x"]), (1, 2, "b", []), (2, 1, None, None)], "id int, round int, rec string, l array<string>")
    assert {(x["id"], x["rec"], tuple(x["l"] or ())) for x in ch.merge_rounds(r, "id", "round", ["rec"], ["l"]).collect()} == {(1, "b", ("x",)), (2, None, ())}
    rows = spark.createDataFrame([(1, "keep", None), (2, "keep", None), (3, "keep", 4)], "id int, verdict string, duplicate_of int")
    c = spark.createDataFrame([(1, "duplicate_of", "7", 1), (2, "verdict", "a", 1), (2, "verdict", "b", 2), (3, "duplicate_of", None, 1)], "id int, field string, value string, at int")
    got = {tuple(x) for x in ch.correct(rows, c, "id", ["verdict", "duplicate_of"], "at", {"duplicate_of": ("verdict", "skip")}).collect()}
    assert got == {(1, "skip", 7), (2, "b", None), (3, "keep", None)}


def test_replay(spark):
    lines = ["x\tATTEMPT\tr\tf1", "x\tOK\tr\tf1\t10", "x\tATTEMPT\tr\tf2", "x\tATTEMPT\tother\tf3", "noise", "", "x\tOK\tr"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(lines)], "line string, at int")
    assert {tuple(r) for r in ch.replay(df, "r").collect()} == {("f1", "done", "10"), ("f2", "uncertain", None)}


def test_settings_are_clamped(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    b = {"x": (-100.0, 100.0), "y": (0.0, 1.0)}
    one = spark.range(1).select(vectors.merge_settings(m(x=90.0), m(x=20.0, z=1.0), b, True).alias("a"), vectors.merge_settings(m(x=90.0), m(y=7.0), b, False).alias("b"), vectors.valid_crop(*[F.lit(v) for v in (0.1, 0.1, 0.5, 0.14)]).alias("c")).first()
    assert one["a"] == {"x": 100.0} and one["b"] == {"y": 1.0} and one["c"] is False


def test_created_and_finish(spark):
    c = spark.createDataFrame([("/a", 10), ("/b", 1), ("/c", 11), ("/d", 11), ("/e", 12)], "path string, item_id int")
    before, after = spark.createDataFrame([(1,)], "item_id int"), spark.createDataFrame([("/a", 10), ("/c", 11), ("/x", 12)], "path string, item_id int")
    assert {r["path"] for r in ch.verify_created(c, before, after).where("ok").collect()} == {"/a"}
    f = spark.createDataFrame([(1, "t", True), (2, None, True), (3, "t", None)], "id int, tag string, member boolean")
    assert {(r["id"], r["need_tag"], r["need_member"]) for r in ch.finish_list(f, "tag", F.lit("t"), "member").collect()} == {(2, True, False), (3, False, True)}
    s = spark.createDataFrame([(1, True, True, False, True), (2, True, False, False, True), (3, False, None, True, True), (4, None, None, None, True), (5, True, True, True, None)], "id int, t boolean, c boolean, n boolean, r boolean")
    assert {r["id"]: r["action"] for r in ch.copy_state(s, "t", "c", "n", "r").collect()} == {1: "done", 2: "complete", 3: "skip_untagged", 4: "create", 5: "skip_unreadable"}
