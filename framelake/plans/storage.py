"""Queries: sources and sinks, as round trips through the shared folder, binary structure, and the last small operators."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import paths, pixels, text, vectors
from framelake.operators import model, similarity
from framelake.plans import changes as ch
from framelake.plans.audit import query as _query
from framelake.plans.audit import read
from framelake.sources import binary, readers, sqlite, writers
from framelake.staging import application_dir, stage
from framelake.streaming import incremental as inc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql=None):
    return _query(sql, (QUERIES, ORACLE_SQL))


def _place(spark, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# Tables and text files


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def sqlite_round_trip(spark, d):
    """A snapshot of a SQLite file that a writer holds open, read in ranges of its row ids."""
    import os

    at = _local(_place(spark, "sqlite"))
    os.makedirs(at)
    con = sqlite3.connect(f"{at}/live.db")
    con.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()
    con.executemany("insert into nation values (?, ?, ?)", (tuple(r) for r in rows))
    con.commit()
    sqlite.snapshot(f"{at}/live.db", f"{at}/copy.db")
    con.close()
    return sqlite.sqlite_table(spark, f"{at}/copy.db", "nation", "n_nationkey bigint, n_name string, n_regionkey bigint", 3)


@query("select p_partkey, p_name, p_retailprice, p_size > 25 as large from part")
def csv_round_trip(spark, d):
    at = _place(spark, "csv")
    large = F.initcap((F.col("p_size") > 25).cast("string"))
    writers.write_csv(read(spark, d, "part").select("p_retailprice", "p_partkey", "p_name", large.alias("large")), at, ["p_partkey", "p_name", "large", "p_retailprice"])
    return readers.csv_rows(spark, at, "p_partkey bigint, p_name string, large string, p_retailprice double").withColumn("large", readers.flag("large"))


@query("select doc_id, source, n_chars from documents")
def json_lines_round_trip(spark, d):
    at = _place(spark, "lines")
    writers.write_json_lines(read(spark, d, "documents").select("doc_id", "source", "n_chars"), at)
    return spark.read.schema("doc_id bigint, source string, n_chars bigint").json(at)


@query("""
select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderstatus desc, o_orderkey desc) r from orders) where r = 1""")
def json_envelopes(spark, d):
    """One file for each order status, its records under ``result``; of a customer's records that of the last file wins."""
    at = _place(spark, "envelopes")
    rec = F.struct("o_orderkey", "o_custkey", "o_totalprice")
    files = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.sort_array(F.collect_list(rec)).alias("result"))
    whole = files.select("o_orderstatus", F.to_json(F.struct("result")).alias("value"))
    whole.repartition("o_orderstatus").write.partitionBy("o_orderstatus").text(at)
    return readers.json_documents(spark, f"{at}/*/*", "o_orderkey bigint, o_custkey bigint, o_totalprice double", "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select count(*) as n_images, count(distinct format) as formats, sum(case when path_state = 'found' then 1 else 0 end)::bigint as found from images")
def summary_file(spark, d):
    at = _place(spark, "summary")
    i = read(spark, d, "images")
    writers.write_summary(i.agg(F.count("*").alias("n_images"), F.count_distinct("format").alias("formats"), F.count_if(F.col("path_state") == "found").alias("found")), at)
    return spark.read.schema("n_images bigint, formats bigint, found bigint").json(at)


@query("select region, customers, 0::bigint as other from (select r_name as region, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1)")
def optional_sources(spark, d):
    """A table that is there and one that is not."""
    at = _place(spark, "optional")
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"), "c_custkey")
    c.write.parquet(at)
    there, gone = readers.optional(spark, at, "region string, c_custkey bigint"), readers.optional(spark, at + "-none", "region string, c_custkey bigint")
    return there.withColumn("o", F.lit(0)).unionByName(gone.withColumn("o", F.lit(1))).groupBy("region").agg(F.count_if(F.col("o") == 0).alias("customers"), F.sum("o").alias("other"))


@query("select event_type, count(*) as n, round(sum(value), 2) as qty from events where event_type not in ('error', 'signup') group by 1 union all select event_type, count(*), 0.0 from events where event_type in ('error', 'signup') group by 1")
def partition_rebuild(spark, d):
    """A table rebuilt by event type, then only two of its partitions replaced."""
    at = _place(spark, "modes")
    li = read(spark, d, "events").select("event_type", "value")
    writers.rebuild(li, at, ["event_type"])
    writers.replace_scope(li.where("event_type in ('error', 'signup')").withColumn("value", F.lit(0.0)), at, ["event_type"])
    t = spark.read.schema(li.schema).parquet(at)
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("qty"))


@query("select distinct i.image_id, coalesce(t.burst, -1) as burst from images i left join (select image_id, max(burst) burst from technical group by 1) t using (image_id)")
def backfilled_bursts(spark, d):
    i = read(spark, d, "images").select("image_id").distinct().withColumn("burst", F.lit(-1).cast("bigint"))
    return writers.backfill(i, read(spark, d, "technical").groupBy("image_id").agg(F.max("burst").alias("burst")), "image_id", "burst")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier")
def upserted_table(spark, d):
    """Two upserts into a table on disk, the second over a third of its rows."""
    at = _place(spark, "upserts")
    s = read(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(1).alias("v"))
    writers.upsert_table(spark, s, at, ["s_suppkey"], ["v"])
    writers.upsert_table(spark, s.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(2).alias("v")), at, ["s_suppkey"], ["v"])
    return spark.read.schema(s.schema).parquet(at).select("s_suppkey", "s_acctbal")


@query("select r_regionkey, r_name, true as refused from region")
def exclusive_checkpoint(spark, d):
    """A checkpoint that a second writer may not touch."""
    at, r = _place(spark, "checkpoint"), read(spark, d, "region").select("r_regionkey", "r_name")
    writers.create_once(r, at)
    try:
        writers.create_once(r.limit(0), at)
        refused = False
    except Exception:  # noqa: BLE001
        refused = True
    return spark.read.schema(r.schema).parquet(at).withColumn("refused", F.lit(refused))


@query("select count(*) as lines, count(*) filter (where event_type = 'signup') as warnings, count(*) filter (where event_type = 'error') as errors, count(*) as stored from events")
def levelled_log(spark, d):
    at = _place(spark, "log")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    counts = writers.append_log(read(spark, d, "events").select(level.alias("level"), F.concat(F.lit("event "), F.col("event_id")).alias("message")), at)
    stored = readers.log_lines(spark, at).where(F.size(F.split("line", "\t")) == 3)
    return stored.agg(*[F.lit(counts[c]).cast("bigint").alias(c) for c in ("lines", "warnings", "errors")], F.count("*").alias("stored"))


@query("select case when r_regionkey = 1 then 'rolled back' else 'stored' end as outcome, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1")
def write_gates(spark, d):
    """Rows handed to an outside sink: a batch that meets contention is tried again, one that fails is rolled back."""
    at = _local(_place(spark, "gates"))

    def write(rows):
        import os

        os.makedirs(at, exist_ok=True)
        for r in rows:
            first = f"{at}/{r['k']}.seen"
            if not os.path.exists(first):
                open(first, "w").close()
                raise writers.Contention("busy")
            if r["scope"] == 1:
                raise ValueError("no such place")
            open(f"{at}/{r['k']}.stored", "w").close()

    def rollback(rows):
        for r in rows:
            open(f"{at}/{r['k']}.rolled back", "w").close()

    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("scope"))
    stage(writers.gated(n, write, 1, 3, rollback), "gates")
    kinds = readers.list_folders(spark.createDataFrame([(at,)], "folder string")).select(F.element_at(F.split("name", "\\."), -1).alias("outcome"))
    return kinds.where("outcome != 'seen'").groupBy("outcome").agg(F.count("*").alias("n"))


# Folders and files


def _shelf(spark, d, name: str) -> str:
    """A folder with one text file for each event type, in a folder of its own."""
    at = _place(spark, name)
    li = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("string").alias("value"))
    li.repartition("event_type").write.partitionBy("event_type").text(at)
    return at


@query("select event_type as mode, 1::bigint as files, length(count(*)::varchar)::bigint + 1 as bytes from events group by 1")
def listed_files(spark, d):
    """Files below a folder (names with a dot in front, such as check sums, left out)."""
    f = readers.file_listing(spark, _shelf(spark, d, "shelf")).where("name like 'part-%'")
    return f.groupBy(F.regexp_replace(F.regexp_extract("path", "event_type=([^/]*)", 1), "%20", " ").alias("mode")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("select event_type as mode, 'listed' as state from events group by 1 union all values ('none', 'absent'), ('file', 'not_a_folder')")
def folder_failures(spark, d):
    """One level of folders, and what can't be listed."""
    at = _local(_shelf(spark, d, "folders"))
    modes = read(spark, d, "events").select(F.col("event_type").alias("mode")).distinct()
    asked = modes.select("mode", F.concat(F.lit(f"{at}/event_type="), "mode").alias("folder")).unionByName(spark.createDataFrame([("none", f"{at}/none"), ("file", f"{at}/_SUCCESS")], "mode string, folder string"))
    states = readers.folder_states(readers.list_folders(asked), asked)
    return states.join(asked, "folder").select("mode", "state")


@query("select event_type as mode, case when event_type = 'error' then 'other' when event_type = 'signup' then 'present' else 'copied' end as first, case when event_type = 'error' then 'other' else 'present' end as again from events group by 1 union all values ('none', 'missing', 'missing')")
def resumed_copy(spark, d):
    """A copy that finds one file there already, another one in its way, and is run twice."""
    import os

    at = _local(_shelf(spark, d, "copies"))
    files = readers.file_listing(spark, at).where("name like 'part-%'").select(F.regexp_replace(F.regexp_extract("path", "event_type=([^/]*)", 1), "%20", " ").alias("mode"), F.regexp_replace("path", "%20", " ").alias("src"))
    files = stage(files.unionByName(spark.createDataFrame([("none", f"{at}/none")], "mode string, src string")).withColumn("dest", F.concat(F.lit(f"{at}-copy/"), "mode", F.lit("/counted"))), "copies")
    for r in files.where("mode in ('error', 'signup')").collect():  # two files
        os.makedirs(os.path.dirname(r["dest"]))
        with open(r["src"].removeprefix("file:")) as a, open(r["dest"], "w") as b:
            b.write(a.read() + ("more" if r["mode"] == "error" else ""))
    first, again = (stage(writers.copy_files(files), "copied").select("src", F.col("state").alias(name)) for name in ("first", "again"))
    return files.join(first, "src").join(again, "src").select("mode", "first", "again")


@query("select 'event_type=' || event_type as name from events where event_type not in ('error', 'click', 'view') group by 1")
def stale_outputs(spark, d):
    at = _local(_shelf(spark, d, "stale"))
    have = readers.list_folders(spark.createDataFrame([(at,)], "folder string")).where("name like 'event_type=%'")
    live = spark.createDataFrame([("event_type=error",), ("event_type=click",), ("event_type=view",)], "name string")
    return writers.stale(have, live, "name").select("name")


@query("select image_id, w, case when error is not null then null when w >= 400 then 'preview' when source = 'video' then null else 'small' end as made_by from (select image_id, min(source) source, min(w) w, min(error) error from thumbs group by 1)")
def fallback_chain(spark, d):
    """A worker with fallbacks: the preview if it is large enough, else a small one; failures are noted and stop nothing."""

    def preview(r):
        if r["error"] is not None:
            raise OSError(r["error"])
        return f"p{r['image_id']}" if r["w"] == r["w"] and r["w"] is not None and r["w"] >= 400 else None

    def small(r):
        return f"s{r['image_id']}" if r["error"] is None and r["source"] != "video" else None

    t = read(spark, d, "thumbs").groupBy("image_id").agg(F.min("source").alias("source"), F.min("w").alias("w"), F.min("error").alias("error"))
    return writers.first_success(t, [("preview", preview), ("small", small)]).select("image_id", "w", "made_by")


# Binary structure


def _be(number, digits: int):
    return F.lpad(F.hex(number), digits, "0")


def _jpeg(w, h, size: int):
    """Hex of a JPEG header with that frame, filled up with zeros."""
    return F.rpad(F.concat(F.lit("FFD8FFE000046162FFC0001108"), _be(h, 4), _be(w, 4), F.lit("00")), 2 * size, "0")


@query("select distinct image_id, w as width, h as height from thumbs where w is not null and h is not null")
def jpeg_sizes(spark, d):
    t = read(spark, d, "thumbs").where("w is not null and h is not null").select("image_id", "w", "h").distinct()
    size = binary.jpeg_size(F.unhex(_jpeg(F.col("w"), F.col("h"), 40)))
    return t.select("image_id", size.alias("s")).select("image_id", "s.width", "s.height")


@query("select distinct image_id, w as width, 1024 + w % 100 as bytes from thumbs where w is not null and h is not null")
def embedded_previews(spark, d):
    """TIFF-like files whose first folder points to two JPEGs in further folders, the later one larger."""
    t = read(spark, d, "thumbs").where("w is not null and h is not null").select("image_id", "w", "h").distinct().withColumn("n", 1024 + F.col("w") % 100)
    entry = lambda tag, value: F.concat(F.lit(f"{tag:04X}000400000001"), _be(value, 8))
    folder = lambda first, n, at, following: F.concat(F.lit("0002"), entry(binary.JPEG_OFFSET, at), entry(binary.JPEG_LENGTH, n), _be(following, 8))
    # header 8, folder of 2 + 2 * 12 + 4 = 30 bytes at 8 and at 38, the JPEGs at 68 and 68 + 1024
    small = _jpeg(F.lit(16), F.lit(16), 1024)
    large = F.concat(F.lit("FFD8FFE000046162FFC0001108"), _be(F.col("h"), 4), _be(F.col("w"), 4), F.lit("00"))
    large = F.rpad(large, 2 * 1200, "0").substr(F.lit(1), 2 * F.col("n"))
    data = F.concat(F.lit("4D4D002A00000008"), folder(0, F.lit(1024), F.lit(68), F.lit(38)), folder(1, F.col("n"), F.lit(68 + 1024), F.lit(0)), small, large)
    jpeg = binary.largest_embedded_jpeg(F.unhex(data))
    return t.select("image_id", jpeg.alias("j")).select("image_id", binary.jpeg_size("j")["width"].alias("width"), F.length("j").alias("bytes"))


@query("select distinct image_id, 'level_' || k as name, w * k as bytes from thumbs, (values (1), (2)) v(k) where w is not null")
def container_levels(spark, d):
    """Preview containers of two chunks."""
    t = read(spark, d, "thumbs").where("w is not null").select("image_id", "w").distinct()

    def chunk(k):
        head = F.concat(F.lit("41674867"), F.lit("0020"), F.lit("0000"), _be(F.col("w") * k, 16), _be(F.lit(3), 16), F.hex(F.lit(f"level_{k}")), F.lit("00"))
        return F.concat(head, F.repeat(F.lit("AB"), F.col("w") * k + 3))

    chunks = binary.container_chunks(F.unhex(F.concat(chunk(1), chunk(2))))
    return t.select("image_id", F.explode(chunks).alias("c")).select("image_id", "c.name", F.col("c.length").cast("int").alias("bytes"))


@query("select image_id, coalesce(min(w) filter (where w >= 400), max(w)) as edge from thumbs where w is not null group by 1")
def preview_levels(spark, d):
    t = read(spark, d, "thumbs").where("w is not null").groupBy("image_id").agg(F.collect_set(F.struct(F.col("w").alias("edge"), "source")).alias("levels"))
    return t.select("image_id", binary.best_level(F.col("levels"), 400)["edge"].alias("edge"))


@query("""
with c as (select n_nationkey k, n_nationkey * 10 r, 255 - n_nationkey * 5 g, (n_nationkey * 37) % 256 b from nation)
select k, 0.0::double as lap_var, round(0.299 * r + 0.587 * g + 0.114 * b, 6)::double as luma, 0.0::double as contrast, round(0.3 * sqrt((r - g) ** 2 + ((r + g) / 2 - b) ** 2), 6) as colorfulness from c""")
def flat_image_measures(spark, d):
    """Measures of images of one colour, 12 by 9."""
    k = F.col("n_nationkey")
    rgb = F.concat(_be(k * 10, 2), _be(255 - k * 5, 2), _be(F.pmod(k * 37, F.lit(256)), 2))
    m = pixels.image_measures(F.unhex(F.repeat(rgb, 108)), F.lit(12), F.lit(9))
    return read(spark, d, "nation").select(k.alias("k"), m.alias("m")).select("k", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("lap_var", "luma", "contrast", "colorfulness")])


# Vectors


@query("select vec_id as id, 64::bigint as dims, true as close from embeddings")
def half_precision(spark, d):
    """Vector shards of 16-bit floats, read back: relative error below one in a thousand."""
    at, e = _place(spark, "half"), read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    writers.vector_files(e, at, 500, half="v")
    back = spark.read.schema("id bigint, v binary").parquet(at).select("id", readers.from_half("v").alias("h"))
    off = lambda a, b: F.abs(a - b) <= F.abs(a) * 0.001 + 1e-6
    return back.join(e, "id").select("id", F.size("h").cast("bigint").alias("dims"), F.forall(F.zip_with("v", "h", off), lambda x: x).alias("close"))


_NORM = "sqrt(list_dot_product(embedding::double[], embedding::double[]))"


@query(f"select vec_id as id, round(case when vec_id % 5 = 0 then -1.0 else 1.0 end * embedding[1]::double / {_NORM}, 5) as first, 1.0::double as length from embeddings")
def later_shard_wins(spark, d):
    """Two shards of vectors, the later one with a fifth of the ids turned around; scaled to length 1."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    turned = e.where("id % 5 = 0").withColumn("v", F.transform("v", lambda x: -x))
    v = readers.vector_shards(e.withColumn("shard", F.lit(1)).unionByName(turned.withColumn("shard", F.lit(2))))
    return v.select("id", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 4).alias("length"))


@query("select doc_id, vec_id, label from documents join embeddings on vec_id = doc_id * 7 % 4096")
def pointer_lookup(spark, d):
    """Vectors by (shard, row) pointers."""
    at = F.col("doc_id") * 7 % 4096
    p = read(spark, d, "documents").select("doc_id", F.expr("(doc_id * 7 % 4096) div 100").alias("shard"), (at % 100).alias("row"))
    shards = read(spark, d, "embeddings").select(F.expr("vec_id div 100").alias("shard"), (F.col("vec_id") % 100).alias("row"), "vec_id", "label")
    return readers.by_pointer(p, shards).select("doc_id", "vec_id", "label")


@query("""
with w as (select [((i * 7 + 3) % 11 - 5) / 10 for i in range(64)] a, [((i * 5 + 1) % 13 - 6) / 10 for i in range(64)] b)
select vec_id as id, round(2 * (list_dot_product(embedding::double[], a) + 0.5) - 3 * (list_dot_product(embedding::double[], b) - 0.25) + 1, 5) as score from embeddings, w""")
def regression_head(spark, d):
    a, b = [((i * 7 + 3) % 11 - 5) / 10 for i in range(64)], [((i * 5 + 1) % 13 - 6) / 10 for i in range(64)]
    head = model.mlp([([a, b], [0.5, -0.25]), ([[2.0, -3.0]], [1.0])])
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(head("embedding"), 5).alias("score"))


@query("""
with g as (select vec_id // 10 grp, bool_or(label >= 5) pos from embeddings group by 1)
select count(*) as scored, count(*) filter (where pos) as training, true as learned from embeddings join g on grp = vec_id // 10""")
def taste_check(spark, d):
    """What must hold of ``taste_model``: all vectors scored, training rows held out, positives above the others on average by the final model."""
    t = _taste(spark, d)
    mean = lambda cond: F.avg(F.when(cond, F.col("score")))
    return t.agg(F.count("score").alias("scored"), F.count("p").alias("training"), (mean(F.col("label")) > mean(~F.col("label"))).alias("learned"))


def _taste(spark, d):
    from framelake.plans.further import taste_model

    return taste_model(spark, d)


@query("select count(*) as vectors, 0::bigint as wrong, 0::bigint as standing_twins from embeddings")
def demotions_check(spark, d):
    """What must hold of ``near_demotions``: whoever demotes is a better or earlier twin, and no two twins in reach stand unguarded."""
    from framelake.plans.further import near_demotions

    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("s"), (F.col("label") == 9).alias("g"))
    gone = stage(near_demotions(spark, d), "demoted")
    twins = stage(similarity.band_pairs(v, "id", 20).where(vectors.dot(F.col("v_a"), F.col("v_b")) >= 0.2).select("id_a", "id_b", "s_a", "s_b", "g_a", "g_b"), "twins")
    lost = F.when(F.col("s_b") > F.col("s_a"), F.col("id_a")).otherwise(F.col("id_b"))
    fair = twins.select(lost.alias("id"), F.when(lost == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a")).alias("by"), F.when(lost == F.col("id_a"), F.col("g_a")).otherwise(F.col("g_b")).alias("g")).where("not g").select("id", "by")
    wrong = gone.join(fair, ["id", "by"], "left_anti").agg(F.count("*").alias("wrong"))
    up = v.select("id").join(gone.select("id"), "id", "left_anti")
    both = twins.join(up.withColumnRenamed("id", "id_a"), "id_a").join(up.withColumnRenamed("id", "id_b"), "id_b")
    held = F.when(F.col("s_b") > F.col("s_a"), F.col("g_a")).otherwise(F.col("g_b"))
    standing = both.where(~held).agg(F.count("*").alias("standing_twins"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(v.agg(F.count("*").alias("vectors"))).join(one(wrong), "_k").join(one(standing), "_k").drop("_k")


# Records


@query("select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2")
def merged_side_files(spark, d):
    e = read(spark, d, "events").select("user_id", F.create_map("event_type", "value").alias("props"), "event_id")
    m = readers.merged_sidecars(e, "user_id", "props", "event_id")
    return m.select("user_id", F.explode("props").alias("event_type", "value"))


@query("""
select distinct image_id, printf('%04d', image_id // 1000) || '/' || image_id || '.jpg' as place from images""")
def shard_paths(spark, d):
    return read(spark, d, "images").select("image_id", paths.shard_path(F.col("image_id"), ".jpg").alias("place")).distinct()


@query("""select doc_id, '{"s":"' || lower(trim(source)) || '<\\/b>"}' as page from documents where source is not null""")
def page_json(spark, d):
    s = F.struct(F.concat(F.lower(F.trim("source")), F.lit("</b>")).alias("s"))
    return read(spark, d, "documents").where("source is not null").select("doc_id", text.json_for_page(s).alias("page"))


@query(r"""
select distinct image_id, case when regexp_matches(path, '(?i)/(img|dsc|mvi|gopr)_?\d+') then 'camera' when regexp_matches(path, '(?i)(screenshot|download|whatsapp)') then 'web' else 'other' end as origin from images where path is not null""")
def name_origins(spark, d):
    i = read(spark, d, "images").where("path is not null").select("image_id", "path").distinct()
    return i.select("image_id", text.first_match(F.col("path"), [("camera", r"/(img|dsc|mvi|gopr)_?\d+"), ("web", r"(screenshot|download|whatsapp)")], "other").alias("origin")).distinct()


@query("""
select distinct image_id from selection where tier in ('hero', 'select') and private = 0 and list_contains([trim(x) for x in string_split(coalesce(reasons, ''), ',')], (select min(trim(r)) from (select unnest(string_split(reasons, ',')) r from selection) where trim(r) != ''))""")
def offered(spark, d):
    """Rows whose labels hold the first label there is, of two tiers, not private."""
    s = read(spark, d, "selection")
    labels = text.split_trim(F.col("reasons"), ",")
    first = s.select(F.explode(labels).alias("l")).agg(F.min("l").alias("l"))
    return s.where(F.col("tier").isin("hero", "select") & (F.col("private") == 0)).select("image_id", labels.alias("ls")).join(F.broadcast(first), F.array_contains("ls", F.col("l"))).select("image_id").distinct()


@query("select distinct s.image_id, s.score from selection s join images i using (image_id) where s.tier in ('hero', 'select') and i.pick != -1 and s.score < 0.99")
def client_filters(spark, d):
    i = read(spark, d, "images").where("pick != -1").select("image_id").distinct()
    return read(spark, d, "selection").where("tier in ('hero', 'select') and score < 0.99").select("image_id", "score").distinct().join(i, "image_id", "left_semi")


@query("select least(100, count(*)) as n, least(100, count(*)) as different, true as repeats from documents")
def random_rows(spark, d):
    """A sample of a hundred rows, the same at each run."""
    from framelake.operators.windows import sample_rows

    docs = read(spark, d, "documents").select("doc_id")
    one, two = (stage(sample_rows(docs, "doc_id", 100, seed=5), "sample") for _ in range(2))
    return one.join(two.withColumn("again", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("different"), (F.count("again") == F.count("*")).alias("repeats"))


@query("select distinct image_id as id from images where rating >= 4")
def feedback_ids(spark, d):
    """Ids that come in as files, each file a batch, join an override set."""
    at, table = _place(spark, "posted"), _place(spark, "overrides")
    i = read(spark, d, "images").where("rating >= 4").select(F.col("image_id").alias("id"))
    i.repartition(3).write.parquet(at)
    inc.feedback(inc.file_stream(spark, at, i.schema), table, table + "-log", "id", lambda ids: None).awaitTermination()
    return inc.current(spark, table, T.StructType([T.StructField("id", T.LongType())]))


@query("""
with s as (select image_id, min(tier) tier, min(burst) burst from selection group by 1), i as (select image_id, max(rating) rating from images group by 1)
select image_id, tier is distinct from case when rating >= 3 then 'select' else 'keep' end as need_tag, burst is null as need_member from s join i using (image_id) where need_tag or need_member""")
def finish_rows(spark, d):
    s = read(spark, d, "selection").groupBy("image_id").agg(F.min("tier").alias("tier"), F.min("burst").isNotNull().alias("member"))
    i = read(spark, d, "images").groupBy("image_id").agg(F.max("rating").alias("rating"))
    return ch.finish_list(s.join(i, "image_id"), "tier", F.when(F.col("rating") >= 3, "select").otherwise("keep"), "member").select("image_id", "need_tag", "need_member")


@query("""
with c as (select distinct path, image_id id from images where path is not null and image_id % 3 != 0), n as (select id, count(*) n from c group by 1), a as (select distinct path, image_id id from images where path_state = 'found'), b as (select distinct file_id id from images where format = 'VIDEO')
select path, c.id as item_id, n = 1 and (path, c.id) in (select (path, id) from a) and c.id not in (select id from b where id is not null) as ok from c join n using (id)""")
def created_items(spark, d):
    i = read(spark, d, "images")
    claims = i.where("path is not null and image_id % 3 != 0").select("path", F.col("image_id").alias("item_id")).distinct()
    before = i.where("format = 'VIDEO'").select(F.col("file_id").alias("item_id"))
    return ch.verify_created(claims, before, i.where("path_state = 'found'").select("path", F.col("image_id").alias("item_id")))
