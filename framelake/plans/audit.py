"""Queries: rollups, reconciliation, verification, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import paths, text
from framelake.operators import relational as rel
from framelake.operators.windows import group_size

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def query(sql: str | None = None, into=(QUERIES, ORACLE_SQL)):
    """Register a function under its name, with the SQL it is held against."""

    def add(f):
        into[0][f.__name__] = f
        if sql is not None:
            into[1][f.__name__] = sql
        return f

    return add


def one_image(images: DataFrame, *cols: str) -> DataFrame:
    """One row per image for columns that don't differ between its rows (differing ones: the least)."""
    return images.groupBy("image_id").agg(*[F.min(c).alias(c) for c in cols])


@query("""
select count(*) as n_rows, count(distinct i.image_id) as n_images, count(distinct file_id) as n_files, count(distinct t.image_id) as n_measured, count(distinct i.image_id) - count(distinct t.image_id) as n_unmeasured,
  count(*) filter (where format = 'RAW') as n_raw from images i left join (select distinct image_id from technical) t using (image_id)""")
def audit_counts(spark, d):
    done = read(spark, d, "technical").select(F.col("image_id").alias("t_id")).distinct()
    i = read(spark, d, "images").join(done, F.col("image_id") == F.col("t_id"), "left")
    n, m = F.count_distinct("image_id"), F.count_distinct("t_id")
    return i.agg(F.count("*").alias("n_rows"), n.alias("n_images"), F.count_distinct("file_id").alias("n_files"), m.alias("n_measured"), (n - m).alias("n_unmeasured"), F.count_if(F.col("format") == "RAW").alias("n_raw"))


@query("select format, count(*) as n from images group by 1")
def formats_by_count(spark, d):
    return read(spark, d, "images").groupBy("format").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "format")


@query("select substr(capture_time, 1, 4) as year, count(*) as n from images group by 1")
def years_by_count(spark, d):
    return read(spark, d, "images").groupBy(F.substring("capture_time", 1, 4).alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@query("select p_partkey, p_name, count(l_partkey) as uses from part left join lineitem on p_partkey = l_partkey group by all")
def keyword_usage(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("uses", F.lit(0).cast("bigint")).alias("uses"))


@query("""
select lower(camera) as camera, capture_time, count(distinct image_id) as n, min(path) as example from images where capture_time != '' and camera is not null group by 1, 2 having count(distinct image_id) > 1""")
def duplicate_candidates(spark, d):
    i = read(spark, d, "images").where("capture_time != '' and camera is not null")
    g = i.groupBy(F.lower("camera").alias("camera"), "capture_time").agg(F.count_distinct("image_id").alias("n"), F.min("path").alias("example"))
    return g.where("n > 1")


@query("""
with o as (select distinct source as name, lower(source) as fold from documents where source is not null),
f as (select fold, count(*) n, min(name) one from o group by 1),
m as (select distinct source as key, source as name from mix_targets),
h as (select key, m.name, case when o.name is not null then 'present' when f.n = 1 then 'spelling_equivalent' else 'absent' end as state, case when o.name is not null then m.name when f.n = 1 then f.one end as match
      from m left join o using (name) left join f on f.fold = lower(m.name))
select * from h union all select null, name, 'extra', name from o where name not in (select match from h where match is not null)""")
def reconcile_names(spark, d):
    wanted = read(spark, d, "mix_targets").select(F.col("source").alias("key"), F.col("source").alias("name")).distinct()
    return rel.reconcile(wanted, read(spark, d, "documents").select(F.col("source").alias("name")))


@query("""
with o as (select distinct 'customer#' || lpad(o_custkey::varchar, 9, '0') as name from orders),
s as (select c_nationkey, case when o.name is not null then 1 else 0 end hit from customer left join o on lower(c_name) = o.name)
select c_nationkey::bigint as c_nationkey, count(*) as total, sum(hit)::bigint as spelling_equivalent, (count(*) - sum(hit))::bigint as absent, 0::bigint as present, true as complete from s group by 1""")
def reconcile_state(spark, d):
    names = read(spark, d, "orders").select(F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    declared = read(spark, d, "customer").select(F.struct("c_custkey", "c_nationkey").alias("key"), F.col("c_name").alias("name"))
    states = rel.reconcile(declared, names).where("state != 'extra'").select(F.col("key.c_nationkey").cast("bigint").alias("c_nationkey"), "state")
    return rel.tally(states, ["c_nationkey"], "state", ["present", "spelling_equivalent", "absent"])


def _files(spark, d):
    i = one_image(read(spark, d, "images"), "path", "path_state", "capture_time", "file_size")
    return i.withColumn("name", text.folded(paths.basename(F.col("path"))))


_FILES = "f as (select distinct image_id, path, path_state, capture_time, file_size, lower(regexp_extract(path, '[^/]*$')) as name from images)"


@query(f"""
with {_FILES}, c as (select m.image_id key, k.image_id candidate, coalesce(m.capture_time = k.capture_time, false) t, coalesce(m.file_size = k.file_size, false) s from f m join f k using (name) where m.path_state = 'missing' and k.path_state != 'missing'),
v as (select key, candidate, case when t and s then 1 when t then 2 when s then 3 else 4 end r from c),
b as (select *, row_number() over (partition by key order by r, candidate) n from v)
select f.image_id as key, b.candidate, case r when 1 then 'same' when 2 then 'same_time' when 3 then 'same_size' when 4 then 'different' else 'no_candidate' end as verdict from f left join b on f.image_id = b.key and n = 1 where f.path_state = 'missing'""")
def candidate_verdict(spark, d):
    f = _files(spark, d)
    lost, there = f.where("path_state = 'missing'"), f.where("path_state != 'missing'")
    c = lost.select("name", F.col("image_id").alias("key")).join(there.select("name", F.col("image_id").alias("candidate")), "name").select("key", "candidate")
    v = rel.verify_candidates(c, lost.select(F.col("image_id").alias("key"), F.col("capture_time").alias("time"), F.col("file_size").alias("size")), there.select(F.col("image_id").alias("candidate"), F.col("capture_time").alias("time"), F.col("file_size").alias("size")))
    best = rel.best_verdict(v)
    return lost.select(F.col("image_id").alias("key")).join(best, "key", "left").select("key", "candidate", F.coalesce("verdict", F.lit("no_candidate")).alias("verdict"))


@query(f"""
with {_FILES}, h as (select m.image_id key, k.path, m.file_size wanted_size, k.file_size found_size, coalesce(m.file_size = k.file_size, false) size_match from f m join f k using (name) where m.path_state = 'missing' and k.path_state != 'missing'),
b as (select *, row_number() over (partition by key order by not size_match, path) n from h) select key, path, found_size, size_match from b where n = 1""")
def name_size_hits(spark, d):
    f = _files(spark, d)
    fold = F.col("name").alias("fold")
    hits = rel.name_and_size_hits(f.where("path_state = 'missing'").select(F.col("image_id").alias("key"), fold, F.col("file_size").alias("size")), f.where("path_state != 'missing'").select("path", fold, F.col("file_size").alias("size")))
    return rel.best_hit(hits)


@query(f"""
with {_FILES}, k as (select path, file_size as size, lower(path) p, name n, lower(regexp_replace(path, '\\.[^./]+$', '')) ds, path_state from f where path is not null),
l as (select k.*, p in (select p from k where path_state = 'found') a, ds in (select ds from k where path_state = 'found') b, coalesce(exists (select 1 from k c where c.path_state = 'found' and c.n = k.n and c.size = k.size), false) c from k where path_state != 'found'),
r as (select *, row_number() over (partition by n, size, (a or b or c) order by path) rn from l)
select path, size, case when a then 'cataloged' when b then 'sibling' when c then 'copy' when size is not null and rn > 1 then 'repeat' else 'new' end as state from r""")
def classify_cascade(spark, d):
    f = _files(spark, d).withColumnRenamed("file_size", "size")
    return rel.classify_files(f.where("path_state != 'found'").select("path", "size"), f.where("path_state = 'found'").select("path", "size"))


_VOLUMES = [("/Volumes/Lumen", "lumen"), ("/Volumes/Field", "field"), ("/Volumes/Vault", "vault")]


@query("""
select case when starts_with(path, '/Volumes/Lumen') then 'lumen' when starts_with(path, '/Volumes/Field') then 'field' when starts_with(path, '/Volumes/Vault') then 'vault' else 'other' end as bucket, path_state, count(*) as n from images group by 1, 2""")
def bucket_prefix(spark, d):
    return read(spark, d, "images").groupBy(paths.in_bucket(F.col("path"), _VOLUMES).alias("bucket"), "path_state").agg(F.count("*").alias("n"))


@query("""
with p as (select s_nationkey src, c_nationkey dst, count(*) n from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)
select src, arg_min(dst, (-n, dst)) as dst, max(n) as n from p group by 1""")
def folder_destination(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    o = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    pairs = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return rel.first_by_key(pairs, ["src"], F.struct((-F.col("n")).alias("a"), F.col("dst").alias("b")), "dst", "n")


@query("""
with i as (select image_id, min(format) format, min(camera) camera, max(rating) rating from images group by 1),
t as (select image_id, min(lap_var) lap_var from technical group by 1), s as (select image_id, min(tier) tier from selection group by 1),
h as (select image_id, arg_min(source, (case source when 'fail' then 2 when 'skip_video' then 1 else 0 end, source)) thumb from thumbs group by 1)
select i.image_id, format, coalesce(camera, '') as camera, rating, coalesce(lap_var, -1) as lap_var, coalesce(tier, 'none') as tier, coalesce(thumb, 'none') as thumb from i left join t using (image_id) left join s using (image_id) left join h using (image_id)""")
def inventory_fact(spark, d):
    i = read(spark, d, "images").groupBy("image_id").agg(F.min("format").alias("format"), F.coalesce(F.min("camera"), F.lit("")).alias("camera"), F.max("rating").alias("rating"))
    rank = F.when(F.col("source") == "fail", 2).when(F.col("source") == "skip_video", 1).otherwise(0)
    thumbs = rel.first_by_key(read(spark, d, "thumbs"), ["image_id"], F.struct(rank.alias("a"), F.col("source").alias("b")), "source").withColumnRenamed("source", "thumb")
    return rel.with_dimensions(i, [(one_image(read(spark, d, "technical"), "lap_var"), ["image_id"], {"lap_var": -1.0}), (one_image(read(spark, d, "selection"), "tier"), ["image_id"], {"tier": "none"}), (thumbs, ["image_id"], {"thumb": "none"})])


@query("""
select s_suppkey, case when contains(s_name, '#') then try_cast(split_part(s_name, '#', 2) as bigint) end as strict_tail, try_cast(list_last(string_split(s_phone, '#')) as bigint) as loose_tail from (select *, s_nationkey::varchar s_phone from supplier)""")
def tail_int(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", text.tail_int(F.col("s_name"), "#").alias("strict_tail"), text.tail_int(F.col("s_nationkey").cast("string"), "#", need_sep=False).alias("loose_tail"))


@query(r"""
select distinct path, regexp_extract(path, '[^/]*$') as name, regexp_replace(path, '/[^/]*$', '') as dir, lower(regexp_extract(path, '[^/]+\.([^./]+)$', 1)) as ext, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '') as stem,
  regexp_replace(path, '\.[^./]+$', '') || '.xmp' as sidecar, nullif(regexp_extract(path, '/((?:19|20)\d\d)/', 1), '') as folder_year from images where path is not null""")
def path_parts(spark, d):
    p = F.col("path")
    i = read(spark, d, "images").where("path is not null").select("path").distinct()
    return i.select(p, paths.basename(p).alias("name"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"), paths.with_extension(p, "xmp").alias("sidecar"), paths.segment_year(p).alias("folder_year"))


@query(r"""
with d as (select doc_id, created_at, path from documents d left join (select image_id, min(path) path from images group by 1) i using (image_id)),
y as (select doc_id, nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '(?:^|\D)((?:19|20)\d\d)[-_]?(?:0[1-9]|1[0-2])', 1), '') a, nullif(regexp_extract(path, '/((?:19[0-9]|20\d)\d)/', 1), '') b, strftime(created_at, '%Y') c from d)
select doc_id, coalesce(a, b, c) as year, case when a is not null then 'name' when b is not null then 'folder' when c is not null then 'time' end as year_source from y""")
def year_cascade(spark, d):
    i = one_image(read(spark, d, "images"), "path")
    j = read(spark, d, "documents").select("doc_id", "image_id", "created_at").join(i, "image_id", "left").withColumn("y", paths.year_cascade(F.col("path"), F.col("created_at")))
    return j.select("doc_id", F.col("y.year").alias("year"), F.col("y.source").alias("year_source"))


@query(r"""
select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as total, count(*) filter (where path_state = 'found') as found, count(*) filter (where path_state = 'missing') as missing, count(*) filter (where path_state = 'relinked') as relinked, count(*) filter (where path_state = 'unknown') as unknown, true as complete from images group by 1""")
def folder_rollup(spark, d):
    return rel.tally(read(spark, d, "images").select(paths.dirname(F.col("path")).alias("folder"), "path_state"), ["folder"], "path_state", ["found", "missing", "relinked", "unknown"])


@query("select image_id, burst, count(*) over (partition by burst) as burst_rows from selection")
def session_sizes(spark, d):
    return group_size(read(spark, d, "selection").select("image_id", "burst"), ["burst"], "burst_rows")


@query("""
select doc_id, case when source is not null then concat_ws(',', case when n_chars != length(text) then 'stale_size' end, case when length(text) < 20 then 'short' end, case when text is null then 'no_text' end, case when lang is null or length(lang) != 2 then 'odd_lang' end) end as flags,
 case when n_chars != length(text) then 1 else 0 end as stale from documents""")
def flag_reasons(spark, d):
    doc = read(spark, d, "documents")
    rules = [(F.col("n_chars") != F.char_length("text"), "stale_size"), (F.char_length("text") < 20, "short"), (F.col("text").isNull(), "no_text"), (F.col("lang").isNull() | (F.char_length("lang") != 2), "odd_lang")]
    return doc.select("doc_id", F.when(F.col("source").isNotNull(), text.joined_labels(*rules)).alias("flags"), text.holds(F.col("n_chars") != F.char_length("text")).alias("stale"))


@query("select image_id, case when t.reasons = '' then 'rechecked' else t.reasons || ',rechecked' end as reasons from (select distinct image_id, reasons from selection) t where image_id in (select image_id from thumbs where source = 'fail')")
def append_reason(spark, d):
    failed = read(spark, d, "thumbs").where("source = 'fail'").select("image_id").distinct()
    return read(spark, d, "selection").select("image_id", "reasons").distinct().join(failed, "image_id", "left_semi").select("image_id", text.append_label(F.col("reasons"), F.lit("rechecked")).alias("reasons"))


@query("select distinct image_id from images where image_id not in (select image_id from thumbs where error is null or error = '')")
def pending_work(spark, d):
    from framelake.streaming.incremental import pending

    return pending(read(spark, d, "images").select("image_id").distinct(), read(spark, d, "thumbs").select("image_id", "error"), "image_id", retry_failed=True)


@query("select regexp_replace(coalesce(error, ''), '[0-9]+', '#', 'g') as kind, source, count(*) as n from thumbs where source in ('fail', 'skip_video') group by 1, 2")
def error_kinds(spark, d):
    t = read(spark, d, "thumbs").where(F.col("source").isin("fail", "skip_video"))
    return t.groupBy(text.canonical_error(F.coalesce("error", F.lit(""))).alias("kind"), "source").agg(F.count("*").alias("n"))


@query("select source, coalesce(error, '') != '' as failed, count(*) as n from thumbs group by 1, 2")
def status_by_source(spark, d):
    return read(spark, d, "thumbs").groupBy("source", (F.coalesce("error", F.lit("")) != "").alias("failed")).agg(F.count("*").alias("n"))


@query(r"""
select distinct lens, lower(nfc_normalize(lens)) as folded, regexp_replace(regexp_replace(lower(lens), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from images where lens is not null""")
def folded_names(spark, d):
    i = read(spark, d, "images").where("lens is not null").select("lens").distinct()
    return i.select("lens", text.fold_name("lens").alias("folded"), text.slug(F.col("lens")).alias("slug"))


@query(r"""
with f as (select distinct path from images where path_state != 'found' and path is not null), r as (select distinct regexp_replace(path, '/[^/]*$', '') root from images where path_state = 'found')
select f.path, arg_max(r.root, length(r.root)) as root from f left join r on starts_with(lower(f.path), lower(r.root) || '/') group by 1""")
def longest_prefix(spark, d):
    i = read(spark, d, "images")
    rows = i.where("path_state != 'found' and path is not null").select("path").distinct()
    return rel.longest_prefix(rows, "path", i.where("path_state = 'found'").select(paths.dirname(F.col("path")).alias("root")))


@query("""
select o_orderkey as key, n as size, min(l_linenumber) filter (where l_linenumber = n + 1) as rank from (select o_orderkey, (o_custkey % 7)::int as n from orders) left join (select distinct l_orderkey, l_linenumber from lineitem) on l_orderkey = o_orderkey group by all""")
def mirror_choice(spark, d):
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 7).cast("int").alias("size"))
    mirrors = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("path"), (F.col("l_linenumber") - 1).alias("size")).distinct()
    return rel.pick_mirror(files, mirrors).withColumnRenamed("mirror", "rank")


@query("""
with e as (select event_id entry, case when event_type = 'view' then (user_id * 7)::varchar end uuid, 'p' || (event_id // 3) path, user_id item_id from events),
i as (select c_custkey item_id, (c_custkey * 7)::varchar uuid, 'p' || (c_custkey // 2) path from customer),
p as (select path, min(item_id) p, count(distinct item_id) pn from i group by 1),
j as (select entry, u.item_id u, p.p, p.pn, e.item_id e_id, k.item_id k from e left join i u on u.uuid = e.uuid left join p on p.path = e.path left join i k on k.item_id = e.item_id),
h as (select entry, case when u is not null then 'uuid' when pn > 1 then 'ambiguous' when p is not null and p != e_id then 'conflict' when p is not null then 'path' when k is not null then 'id' else 'not_found' end how, u, p, k from j),
r as (select entry, how, case how when 'uuid' then u when 'path' then p when 'id' then k end resolved from h)
select entry, resolved, case when resolved is not null and row_number() over (partition by resolved order by entry) > 1 then 'repeat' else how end as how from r""")
def identity_cascade(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("entry"), F.when(F.col("event_type") == "view", (F.col("user_id") * 7).cast("string")).alias("uuid"), F.concat(F.lit("p"), F.expr("event_id div 3")).alias("path"), F.col("user_id").alias("item_id"))
    i = read(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") * 7).cast("string").alias("uuid"), F.concat(F.lit("p"), F.expr("c_custkey div 2")).alias("path"))
    return rel.resolve_identity(e, i)


@query("""
with c as (select doc_id id, lower(trim(source)) field, text value, lang reason, count(*) over (partition by doc_id, lower(trim(source))) n from documents)
select id, field, case when not coalesce(field in ('captions', 'audit-log', 'curation'), false) then 'field' when reason is null or trim(reason) = '' then 'reason' when n > 1 then 'repeated' end as why from c where why is not null""")
def rejected_corrections(spark, d):
    c = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("field"), F.col("text").alias("value"), F.col("lang").alias("reason"))
    return rel.rejects(c, ["captions", "audit-log", "curation"]).select("id", "field", "why")
