import json
import struct

import pytest
from pyspark.sql import functions as F

from framelake.sources import binary, readers, writers


def test_csv_round_trip_and_empty_header(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", 1, True), ("", None, False), ("ü", 3, None)], "s string, n int, b boolean")
    writers.write_csv(df.select("s", "n", F.initcap(F.col("b").cast("string")).alias("b")), str(tmp_path / "t"), ["n", "s", "b"])
    back = readers.csv_rows(spark, str(tmp_path / "t"), "n int, s string, b string").select("n", "s", readers.flag("b").alias("b"))
    assert {(r["n"], r["s"] or "", r["b"]) for r in back.collect()} == {(1, "a,\"b\"\nc", True), (None, "", False), (3, "ü", None)}
    writers.write_csv(df.limit(0), str(tmp_path / "e"), ["n", "s"])
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert text.strip() == "n,s"
    assert readers.csv_rows(spark, str(tmp_path / "e"), "n int, s string").count() == 0


def test_json_documents_last_file_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": [{"id": 1, "v": "old"}, {"id": 2, "v": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "v": "new"}, {"id": 3}]))
    (tmp_path / "c.json").write_text(json.dumps({"id": 4, "v": "one"}))
    (tmp_path / "d.json").write_text(json.dumps({"result": {"id": 5, "v": "wrapped"}}))
    got = readers.json_documents(spark, str(tmp_path), "id bigint, v string", key="id")
    assert {(r["id"], r["v"]) for r in got.collect()} == {(1, "new"), (2, "x"), (3, None), (4, "one"), (5, "wrapped")}


def test_optional_listing_and_logs(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none"), "id bigint").count() == 0
    for name in ("a/x.JPG", "a/.hidden/y.jpg", "skip/z.jpg", "b/.dot.jpg"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12345")
    got = readers.file_listing(spark, str(tmp_path / "tree"), skip=["skip"]).collect()
    assert [(r["name"], r["size"]) for r in got] == [("x.JPG", 5)]
    (tmp_path / "log.txt").write_text("one\ntwo\n")
    assert [r["line"] for r in readers.log_lines(spark, str(tmp_path / "log.txt")).orderBy("at").collect()] == ["one", "two"]
    ls = spark.createDataFrame([("/a", "x", None), ("/b", None, "unreadable")], "folder string, name string, failure string")
    f = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "folder string")
    assert {r["folder"]: (r["state"], r["files"]) for r in readers.folder_states(ls, f).collect()} == {"/a": ("listed", 1), "/b": ("unreadable", 0), "/c": ("absent", 0)}


def test_listing_is_whole(spark, tmp_path):
    root = tmp_path / ".trash" / "skip" / "tree"  # only what is below the root is left out
    sizes = {"a/x.NEF": 5, "a/_DSC1.NEF": 5, "_sub/y.NEF": 3, "a/zero.NEF": 0, "a/b/c/_MG_2.CR2": 1, "a/skip": 2, "top é.jpg": 4, "#1 %20.jpg": 1}
    for name, n in (sizes | {"skip/z.jpg": 9, "a/skip2/.h/q.jpg": 9}).items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1" * n)
    (root / "a" / "up").symlink_to(root, target_is_directory=True)
    (root / "lost.jpg").symlink_to(root / "nowhere")
    got = readers.file_listing(spark, str(root), skip=["skip"], content=True).collect()
    paths = {f"file:{root}/{n}": n for n in [*sizes, "lost.jpg"]}
    assert sorted(r["path"] for r in got) == sorted(paths)
    for r in got:
        n = paths[r["path"]]
        assert r["name"] == n.split("/")[-1] and r["size"] == sizes.get(n)
        assert (r["content"] is None and r["modified"] is None) if n == "lost.jpg" else (bytes(r["content"]) == b"1" * sizes[n] and abs(r["modified"].timestamp() - (root / n).stat().st_mtime) < 0.01)
    assert readers.file_listing(spark, f"{root}/a/*.NEF").count() == 3
    assert [r["name"] for r in readers.file_listing(spark, f"{root}/a/_DSC1.NEF").collect()] == ["_DSC1.NEF"]
    with pytest.raises(FileNotFoundError):
        readers.file_listing(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert readers.file_listing(spark, str(tmp_path / "empty")).count() == 0
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(str(root))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (root / "lost.jpg").unlink()
    (root / "a" / "up").unlink()
    by_driver = readers._listed_by_driver(spark, fs, [fs.getFileStatus(at)], ["skip"]).collect()
    assert {(r["path"], r["size"]) for r in by_driver} == {(r["path"], r["size"]) for r in got if r["name"] != "lost.jpg"}


def test_vectors_and_sidecars(spark):
    s = spark.createDataFrame([(1, [3.0, 4.0], 0), (1, [0.0, 2.0], 1), (2, [0.0, 0.0], 0)], "id int, v array<float>, shard int")
    assert {r["id"]: r["v"] for r in readers.vector_shards(s).collect()} == {1: [0.0, 1.0], 2: None}
    m = spark.createDataFrame([("f", {"a": "1", "b": "1"}, 0), ("f", {"b": "2"}, 1)], "k string, m map<string,string>, o int")
    assert readers.merged_sidecars(m, "k", "m", "o").first()["m"] == {"a": "1", "b": "2"}


def test_tables(spark, tmp_path):
    t = str(tmp_path / "t")
    a = spark.createDataFrame([(1, 2019, "a"), (2, 2020, "b")], "id int, year int, x string")
    writers.rebuild(a, t, ["year"])
    writers.replace_scope(spark.createDataFrame([(3, 2020, "c")], a.schema), t, ["year"])
    assert {(r["id"], r["year"]) for r in spark.read.parquet(t).collect()} == {(1, 2019), (3, 2020)}
    u = str(tmp_path / "u")
    for rows in ([(1, 1, "a")], [(1, 2, "b"), (2, 1, "c")], [(1, 1, "late")]):
        writers.upsert_table(spark, spark.createDataFrame(rows, "id int, v int, x string"), u, ["id"], ["v"])
    assert {tuple(r) for r in spark.read.parquet(u).collect()} == {(1, 2, "b"), (2, 1, "c")}
    writers.create_once(a, str(tmp_path / "c"))
    with pytest.raises(Exception):
        writers.create_once(a, str(tmp_path / "c"))
    b = writers.backfill(a, spark.createDataFrame([(1, "z")], "id int, x string"), "id", "x")
    assert {(r["id"], r["x"]) for r in b.collect()} == {(1, "z"), (2, "b")}
    assert {r["id"] for r in writers.stale(a, a.where("id = 1"), "id").collect()} == {2}
    writers.append_log(spark.createDataFrame([("INFO", "x")], "level string, message string"), str(tmp_path / "l"))
    writers.write_json_lines(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_summary(a.groupBy().count(), str(tmp_path / "s"))
    writers.vector_files(a, str(tmp_path / "v"), 1)


def test_gates_retry(spark, tmp_path):
    seen = str(tmp_path / "fail-once")

    def write(rows):
        import os

        if not os.path.exists(seen):
            open(seen, "w").close()
            raise writers.Contention("busy")
        if any(r["id"] == 7 for r in rows):
            raise ValueError("never")

    out = writers.gated(spark.range(10).coalesce(1), write, 4, 3).collect()
    assert [(r["rows"], r["tries"], r["error"]) for r in out] == [(4, 2, None), (4, 1, "never"), (2, 1, None)]


def jpeg(w, h, size=1200, marker=0xC0):
    body = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + bytes([0xFF, marker]) + struct.pack(">HBHH", 8, 8, h, w) + b"\0"
    return body + b"\0" * max(0, size - len(body))


def tiff(order, jpegs):
    """A file whose first folder points to sub folders, one JPEG each, and back to itself."""
    e = {"<": b"II", ">": b"MM"}[order]
    n = len(jpegs)
    at = 8 + 2 + 12 * 2 + 4
    subs_at, folders = at, []
    at += 4 * max(2, n)
    data_at = at + n * (2 + 24 + 4)
    blob = b""
    for j in jpegs:
        folders.append(struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x0201, 4, 1, data_at + len(blob)) + struct.pack(order + "HHII", 0x0202, 4, 1, len(j)) + struct.pack(order + "I", 0))
        blob += j
    subs = [at + i * 30 for i in range(n)]
    subs_value = subs[0] if n == 1 else subs_at
    first = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x014A, 4, n, subs_value) + struct.pack(order + "HHII", 0x0100, 4, 1, 5) + struct.pack(order + "I", 8)
    pad = b"".join(struct.pack(order + "I", s) for s in subs).ljust(4 * max(2, n), b"\0")
    return e + struct.pack(order + "HI", 42, 8) + first + pad + b"".join(folders) + blob


@pytest.mark.parametrize("order", "<>")
def test_binary_structures(spark, order):
    name = b"level_1\0"
    head = lambda n, d: b"AgHg" + struct.pack(">HBBQQ", 24 + len(n), 1, 0, len(d), 4) + n + d + b"\0" * 4
    box = head(b"header\0", b"xy") + head(name, jpeg(640, 480)) + b"rest"
    raw = tiff(order, [jpeg(160, 120, 1100), jpeg(1024, 683, 5000), jpeg(9, 9, 9000, 0xC3), jpeg(5, 5, 500)])
    rows = [(1, box), (2, jpeg(1024, 683)), (3, raw), (4, b""), (5, None), (6, b"II*\0\xff\xff\xff\xff"), (7, raw[:60])]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, content binary")
    got = {r["id"]: r for r in df.select("id", binary.container_chunks("content").alias("c"), binary.jpeg_size("content").alias("s"), binary.largest_embedded_jpeg("content").alias("j")).collect()}
    assert [(c["name"], c["length"]) for c in got[1]["c"]] == [("header", 2), ("level_1", 1200)]
    o = got[1]["c"][1]["offset"]
    assert binary.jpeg_frame(box[o : o + 1200])[:2] == (640, 480)
    assert tuple(got[2]["s"]) == (1024, 683)
    assert bytes(got[3]["j"]) == jpeg(1024, 683, 5000)
    assert got[4]["c"] == [] and got[5]["c"] is None and got[4]["j"] is None and got[6]["j"] is None and got[7]["j"] is None
    levels = spark.createDataFrame([([(90, "a"), (360, "b"), (720, "c")],)], "l array<struct<edge:int,n:string>>")
    assert [tuple(levels.select(binary.best_level(F.col("l"), s)).first()[0]) for s in (100, 720, 5000)] == [(360, "b"), (720, "c"), (720, "c")]


def test_folders_with_typed_failures(spark, tmp_path):
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "_a").write_text("x")
    (tmp_path / "empty").mkdir()
    (tmp_path / "file").write_text("x")
    asked = [f"{tmp_path}/full", f"file:{tmp_path}/full", f"{tmp_path}/empty", f"{tmp_path}/file", f"{tmp_path}/none", "bad\0name", None]
    df = spark.createDataFrame([(a,) for a in asked], "folder string")
    got = {(r["folder"], r["name"], r["failure"]) for r in readers.list_folders(df).collect()}
    assert got == {(asked[0], "_a", None), (asked[1], "_a", None), (asked[2], None, None), (asked[3], None, "not_a_folder"), (asked[4], None, "absent"), (asked[5], None, "unreadable")}
    states = {r["folder"]: (r["state"], r["files"]) for r in readers.folder_states(readers.list_folders(df), df.where("folder is not null")).collect()}
    assert states[asked[2]] == ("listed", 0) and states[asked[0]] == ("listed", 1) and states[asked[4]] == ("absent", 0)
    assert readers.list_folders(df.limit(0)).count() == 0


def test_copies_resume_and_never_overwrite(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n * 100)
    (tmp_path / "to").mkdir()
    (tmp_path / "to" / "b").write_text("b" * 100)
    (tmp_path / "to" / "c").write_text("else")
    rows = [(f"{tmp_path}/{n}", f"{tmp_path}/to/{n}") for n in "abcx"] + [(None, "y"), (f"{tmp_path}/a", f"{tmp_path}/to/a")]
    df = spark.createDataFrame(rows, "src string, dest string").withColumns({"size": F.lit(1), "state": F.lit("x")})
    run = lambda: {r["src"][-1]: (r["size"], r["state"]) for r in writers.copy_files(df).collect()}
    assert run() == {"a": (100, "copied"), "b": (100, "present"), "c": (100, "other"), "x": (None, "missing")}
    assert run()["a"] == (100, "present") and (tmp_path / "to" / "c").read_text() == "else"
    assert sorted(p.name for p in (tmp_path / "to").iterdir()) == ["a", "b", "c"]


def test_first_success(spark):
    def first(r):
        if r["k"] == 2:
            raise ValueError("broken")
        return "one" if r["k"] == 1 else None

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "d")], "k int, made string")
    got = {r["k"]: (r["made"], r["made_by"], r["made_error"]) for r in writers.first_success(df, [("x", first), ("y", lambda r: r["made"] if r["k"] == 3 else None)]).collect()}
    assert got == {1: ("one", "x", None), 2: (None, None, "x: broken"), 3: ("c", "y", None), None: (None, None, None)}
    assert writers.first_success(df.limit(0), []).count() == 0


def test_failed_batches_are_rolled_back(spark, tmp_path):
    def write(rows):
        raise writers.Contention("busy") if rows[0]["id"] == 0 else KeyError("gone")

    def back(rows):
        open(f"{tmp_path}/{rows[0]['id']}", "w").close()

    out = writers.gated(spark.range(2).coalesce(1), write, 1, 3, back).collect()
    assert [(r["tries"], r["error"]) for r in out] == [(3, "busy"), (1, "'gone'")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1"]


def test_log_counts_and_first_write_error(spark, tmp_path):
    rows = spark.createDataFrame([("INFO", "a"), ("warning", "b"), ("ERROR", "c"), (None, "d")], "level string, message string")
    assert writers.append_log(rows, f"{tmp_path}/log") == {"lines": 4, "warnings": 1, "errors": 1, "write_error": None}
    (tmp_path / "file").write_text("x")
    assert writers.append_log(rows, f"{tmp_path}/file/log")["write_error"]


def test_upsert_table_recovers(spark, tmp_path):
    import os

    at = f"{tmp_path}/t"
    one = spark.createDataFrame([(1, 1), (2, 1)], "id int, v int")
    writers.upsert_table(spark, one, at, ["id"], ["v"])
    os.rename(at, at + ".old")  # cut off after the old version was moved aside
    writers.upsert_table(spark, spark.createDataFrame([(2, 5)], "id int, v int"), at, ["id"], ["v"])
    assert {tuple(r) for r in spark.read.parquet(at).collect()} == {(1, 1), (2, 5)}
    assert not os.path.exists(at + ".old") and not os.path.exists(at + ".next")


def test_many_folders_and_long_chains():
    from framelake.sources.binary import MOST_HOPS, SUB_IFD, embedded_jpegs

    # one folder with 40 sub folders, the largest JPEG in the last; then a chain of 40 folders, where only so many hops count
    pic = [jpeg(8, 8, 1100 + i) for i in range(40)]
    head, n = b"II*\0" + struct.pack("<I", 8), len(pic)
    first = struct.pack("<HHHII", 1, SUB_IFD, 4, n, 26) + struct.pack("<I", 0)
    subs_at = 26 + 4 * n
    folder = lambda at, size, following: struct.pack("<HHHIIHHII", 2, 0x0201, 4, 1, at, 0x0202, 4, 1, size)[:26] + struct.pack("<I", following)
    pics_at = subs_at + 30 * n
    starts = [pics_at + sum(map(len, pic[:i])) for i in range(n)]
    wide = head + first + struct.pack(f"<{n}I", *[subs_at + 30 * i for i in range(n)]) + b"".join(folder(starts[i], len(pic[i]), 0) for i in range(n)) + b"".join(pic)
    assert len(embedded_jpegs(wide)) == n and embedded_jpegs(wide)[0] == (starts[-1], len(pic[-1]))
    at = [8 + 30 * i for i in range(n)]
    starts = [8 + 30 * n + sum(map(len, pic[:i])) for i in range(n)]
    chain = head + b"".join(folder(starts[i], len(pic[i]), at[i + 1] if i + 1 < n else 8) for i in range(n)) + b"".join(pic)
    assert len(embedded_jpegs(chain)) == MOST_HOPS
