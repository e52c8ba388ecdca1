from pyspark.sql import functions as F

from framelake.functions import paths, text
from framelake.operators import ranking as rk
from framelake.operators import relational as rel


def test_reconcile_folded_names(spark):
    declared = spark.createDataFrame([("d", 1, "A.JPG"), ("d", 2, "b.jpg"), ("d", 3, "c.jpg"), ("e", 4, "A.JPG"), ("d", 5, None)], "folder string, key int, name string")
    observed = spark.createDataFrame([("d", "a.jpg"), ("d", "b.jpg"), ("d", "B.jpg"), ("d", "x.jpg"), ("e", "a.jpg"), ("e", "A.jpg"), ("e", None), ("d", "x.jpg")], "folder string, name string")
    got = {(r["folder"], r["key"], r["name"]): r["state"] for r in rel.reconcile(declared, observed, ["folder"]).collect()}
    assert got == {("d", 1, "A.JPG"): "spelling_equivalent", ("d", 2, "b.jpg"): "present", ("d", 3, "c.jpg"): "absent", ("e", 4, "A.JPG"): "absent", ("d", 5, None): "absent", ("d", None, "B.jpg"): "extra", ("d", None, "x.jpg"): "extra", ("e", None, "a.jpg"): "extra", ("e", None, "A.jpg"): "extra"}
    t = rel.tally(rel.reconcile(declared, observed, ["folder"]), ["folder"], "state", ["present", "spelling_equivalent", "absent", "extra"]).collect()
    assert all(r["complete"] for r in t)
    assert rel.reconcile(declared.limit(0), observed.limit(0), ["folder"]).count() == 0


def test_reconcile_parts_companions_from_extras(spark):
    declared = spark.createDataFrame([("d", 1, "A.NEF"), ("d", 2, "b.xmp"), ("e", 3, "A.NEF")], "folder string, key int, name string")
    observed = spark.createDataFrame([("d", "a.nef"), ("d", "a.XMP"), ("d", "b.xmp"), ("d", "a.jpg"), ("e", "a.xmp"), ("f", "a.xmp")], "folder string, name string")
    sidecars = spark.createDataFrame([("d", "A.xmp"), ("d", "A.xmp"), ("d", "b.xmp"), ("e", "A.jpg"), ("e", None)], "folder string, name string")
    got = {(r["folder"], r["key"], r["name"]): r["state"] for r in rel.reconcile(declared, observed, ["folder"], sidecars).collect()}
    assert got == {("d", 1, "A.NEF"): "spelling_equivalent", ("d", 2, "b.xmp"): "present", ("e", 3, "A.NEF"): "absent", ("d", None, "a.XMP"): "companion", ("d", None, "a.jpg"): "extra", ("e", None, "a.xmp"): "extra", ("f", None, "a.xmp"): "extra"}


def test_verdicts(spark):
    c = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (1, 99), (2, 10), (3, 14)], "key int, candidate int")
    m = spark.createDataFrame([(1, "t", 5), (3, None, None)], "key int, time string, size int")
    k = spark.createDataFrame([(10, "t", 5), (11, "t", 6), (12, "u", 5), (13, "u", 6), (14, None, None)], "candidate int, time string, size int")
    v = rel.verify_candidates(c, m, k)
    assert {(r["key"], r["candidate"]): r["verdict"] for r in v.collect()} == {(1, 10): "same", (1, 11): "same_time", (1, 12): "same_size", (1, 13): "different", (1, 99): "not_known", (2, 10): "unknown_key", (3, 14): "different"}
    assert {r["key"]: (r["candidate"], r["verdict"]) for r in rel.best_verdict(v).collect()} == {1: (10, "same"), 2: (10, "unknown_key"), 3: (14, "different")}
    tie = spark.createDataFrame([(1, 7, "same"), (1, 6, "same")], "key int, candidate int, verdict string")
    assert rel.best_verdict(tie).first()["candidate"] == 6


def test_tail_int(spark):
    s = spark.createDataFrame([("a:12",), ("12",), ("a:x",), (None,)], "s string").select(text.tail_int(F.col("s")).alias("a"), text.tail_int(F.col("s"), need_sep=False).alias("b"))
    assert [tuple(r) for r in s.collect()] == [(12, 12), (None, 12), (None, None), (None, None)]


def test_paths(spark):
    df = spark.createDataFrame([("/a/2019/x.Y.JPG",), ("name",), (".hidden",), (None,), ("/2150/1850/f",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.basename(p), paths.dirname(p), paths.extension(p), paths.stem(p), paths.segment_year(p)).collect()]
    assert got == [("x.Y.JPG", "/a/2019", "jpg", "x.Y", "2019"), ("name", "", "", "name", None), (".hidden", "", "", ".hidden", None), (None, None, None, None, None), ("f", "/2150/1850", "", "f", None)]
    pre = [r[0] for r in df.select(paths.prefixes(p)).collect()]
    assert pre[0] == ["/a", "/a/2019", "/a/2019/x.Y.JPG"] and pre[1] == ["name"]
    assert spark.range(1).select(paths.shard_path(F.lit(12345), ".jpg")).first()[0] == "0012/12345.jpg"


def test_folds_and_labels(spark):
    df = spark.createDataFrame([("Straße",), ("Ét",), ("Ét",), (None,)], "s string")
    assert [r[0] for r in df.select(text.fold_name("s")).collect()] == ["strasse", "ét", "ét", None]
    assert [r[0] for r in df.select(text.loose_fold(F.col("s"))).collect()] == ["stra?e", "?t", "?t", None]
    one = spark.createDataFrame([("", "a"), (None, "a"), ("x", "a")], "l string, n string")
    assert [r[0] for r in one.select(text.append_label(F.col("l"), F.col("n"))).collect()] == ["a", "a", "x,a"]
    assert spark.range(1).select(text.slug(F.lit("  Hello, Wörld! "))).first()[0] == "hello-w-rld"
    assert spark.range(1).select(text.json_for_page(F.struct(F.lit("</script>").alias("a")))).first()[0] == '{"a":"<\\/script>"}'


def test_identity_and_classification(spark):
    items = spark.createDataFrame([(1, "u1", "/a"), (2, "u2", "/b"), (3, "u3", "/c"), (4, "u4", "/c")], "item_id int, uuid string, path string")
    e = spark.createDataFrame([(1, "u1", None, None), (2, None, "/a", None), (3, None, "/b", 1), (4, None, "/c", None), (5, None, None, 4), (6, None, None, 9)], "entry int, uuid string, path string, item_id int")
    got = {r["entry"]: (r["resolved"], r["how"]) for r in rel.resolve_identity(e, items).collect()}
    assert got == {1: (1, "uuid"), 2: (1, "repeat"), 3: (None, "conflict"), 4: (None, "ambiguous"), 5: (4, "id"), 6: (None, "not_found")}
    cat = spark.createDataFrame([("/x/A.raw", 5)], "path string, size int")
    f = spark.createDataFrame([("/x/a.RAW", 1), ("/x/a.jpg", 1), ("/y/a.raw", 5), ("/y/n.jpg", 3), ("/z/N.jpg", 3), ("/z/m.jpg", None), ("/w/m.jpg", None)], "path string, size int")
    assert {r["path"]: r["state"] for r in rel.classify_files(f, cat).collect()} == {"/x/a.RAW": "cataloged", "/x/a.jpg": "sibling", "/y/a.raw": "copy", "/y/n.jpg": "new", "/z/N.jpg": "repeat", "/z/m.jpg": "new", "/w/m.jpg": "new"}


NFC, NFD = "/x/\u00c9t\u00e9 Stra\u00dfe.NEF", "/y/E\u0301te\u0301 STRASSE.nef"  # the same name, composed and decomposed, sharp s and SS


def test_names_match_composed_and_case_folded(spark):
    a, b = NFC.split("/")[-1], NFD.split("/")[-1]
    declared = spark.createDataFrame([(1, a), (2, "plain.JPG"), (3, None)], "key int, name string")
    observed = spark.createDataFrame([(b,), ("PLAIN.jpg",), ("\u00e9.nef",), (None,)], "name string")
    got = {(r["key"], r["match"]): r["state"] for r in rel.reconcile(declared, observed).collect()}
    assert got == {(1, b): "spelling_equivalent", (2, "PLAIN.jpg"): "spelling_equivalent", (3, None): "absent", (None, "\u00e9.nef"): "extra"}
    both = spark.createDataFrame([(b,), (a.upper(),)], "name string")
    assert rel.reconcile(declared.where("key = 1"), both).where("key = 1").first()["state"] == "absent"
    hits = rel.name_and_size_hits(spark.createDataFrame([(1, a, 5), (2, "q", 5)], "key int, name string, size int"), spark.createDataFrame([(NFD, b, 5), (NFD, b, None)], "path string, name string, size int"))
    assert sorted(tuple(r) for r in hits.select("key", "path", "size_match").collect()) == [(1, NFD, False), (1, NFD, True)]
    catalog = spark.createDataFrame([(NFC, 5)], "path string, size int")
    listing = [(NFD.replace("/y/", "/x/"), 1), (NFD.replace("/y/", "/X/").replace("nef", "xmp"), 1), (NFD, 5), (NFD, 6), (NFC.replace("/x/", "/z/"), 6)]
    got = {tuple(r)[:2]: r["state"] for r in rel.classify_files(spark.createDataFrame(listing, "path string, size int"), catalog).collect()}
    assert [got[x] for x in listing] == ["cataloged", "sibling", "copy", "new", "repeat"]


def test_file_queries_match_decomposed_names(spark, tmp_path):
    from framelake.plans.catalog import QUERIES

    rows = [(1, NFC, "missing", "t", 5), (2, NFD, "found", "t", 5), (3, "/q/a.jpg", "missing", "u", 6), (4, "/r/A.JPG", "found", "u", 7)]
    spark.createDataFrame(rows, "image_id bigint, path string, path_state string, capture_time string, file_size bigint").write.parquet(str(tmp_path / "images.parquet"))
    got = lambda name, *c: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*c).collect()}
    assert got("candidate_verdict", "key", "candidate", "verdict") == {(1, 2, "same"), (3, 4, "same_time")}
    assert got("name_size_hits", "key", "path", "size_match") == {(1, NFD, True), (3, "/r/A.JPG", False)}
    assert got("classify_cascade", "path", "state") == {(NFC, "copy"), ("/q/a.jpg", "new")}


def test_longest_prefix_mirrors_rejects(spark):
    rows = spark.createDataFrame([("/a/b/c.jpg",), ("/a/x.jpg",), ("/q",), (None,)], "p string")
    roots = spark.createDataFrame([("/A",), ("/a/b",), (None,)], "root string")
    assert {r["p"]: r["root"] for r in rel.longest_prefix(rows, "p", roots).collect()} == {"/a/b/c.jpg": "/a/b", "/a/x.jpg": "/A", "/q": None, None: None}
    files, mirrors = spark.createDataFrame([(1, 5), (2, 5)], "key int, size int"), spark.createDataFrame([(1, 0, "s", 4), (1, 1, "m", 5), (1, 2, "n", 5)], "key int, rank int, path string, size int")
    assert {r["key"]: r["mirror"] for r in rel.pick_mirror(files, mirrors).collect()} == {1: "m", 2: None}
    c = spark.createDataFrame([(1, "a", "v", "r"), (2, "z", "v", "r"), (3, "a", "v", " "), (4, "a", "v", "r"), (4, "a", "w", "r")], "id int, field string, value string, reason string")
    assert sorted((r["id"], r["why"]) for r in rel.rejects(c, ["a"]).collect()) == [(2, "field"), (3, "reason"), (4, "repeated"), (4, "repeated")]


def test_borda_and_unions(spark):
    b = spark.createDataFrame([("x", [5, 5, 7]), ("y", [7, None])], "ballot string, picks array<int>")
    assert {r["item"]: (r["points"], r["ballots"]) for r in rk.borda(b, 3).collect()} == {5: (3, 1), 7: (5, 2)}
    a, c = spark.createDataFrame([(1, 0), (2, 1)], "id int, o int"), spark.createDataFrame([(2, 0), (3, 1)], "id int, o int")
    assert {(r["id"], r["tier"]) for r in rk.tiered_union([a, c], "id", ["o"]).collect()} == {(1, 0), (2, 0), (3, 1)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert {(r["id"], r["fate"]) for r in rk.accounting(ids(1, 2, 3), ids(4, 2), ids(2, 5), ids(3, 5), "id").collect()} == {(5, "added"), (1, "removed"), (3, "removed"), (5, "rehomed"), (1, "unaccounted"), (4, "unaccounted")}
    assert {r["id"]: r["methods"] for r in rk.methods([("m", ids(1, 2)), ("b", ids(2, 2))], "id").collect()} == {1: "m", 2: "b,m"}
    m = spark.createDataFrame([(1, "big"), (2, "big"), (1, "small")], "k int, g string").withColumn("place", F.lit(0))
    assert {r["k"]: r["g"] for r in rk.primary_group(m, "k", "g", "place").collect()} == {1: "small", 2: "big"}
    bad = spark.createDataFrame([(1, 1), (1, 2)], "rank int, id int")
    assert not rk.bijection(bad, "rank", "id").first()["ok"] and rk.bijection(bad.limit(0), "rank", "id").first()["ok"]
