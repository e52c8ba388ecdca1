"""Queries: similarity, text and JSON, plan/apply, streaming, and features of Spark offered beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import paths, vectors
from framelake.operators import model, similarity
from framelake.plans import changes as ch
from framelake.plans.audit import query as _query
from framelake.plans.audit import read
from framelake.staging import application_dir
from framelake.streaming import incremental as inc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql=None):
    return _query(sql, (QUERIES, ORACLE_SQL))


# Similarity; queries of a search are the rows whose id is divisible by 100, against all rows


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(spark, d):
    return _vectors(spark, d).where("id % 100 = 0")


_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"
_KNN = f"""
s as (select a.vec_id qid, b.vec_id id, {_DOT} sim, a.label ql, b.label from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id != b.vec_id),
n as (select *, row_number() over (partition by qid order by round(sim, 12) desc, id) as rank from s)"""


@query(f"with {_KNN} select qid, id, round(sim, 6) as sim, rank::int as rank from n where rank <= 12 and sim >= 0.3 and ql != label")
def knn_lookalike(spark, d):
    q = _asked(spark, d)
    near = similarity.top_k(q, _vectors(spark, d), 12, drop_self=True).where("sim >= 0.3")
    a, b = q.select(F.col("id").alias("qid"), F.col("label").alias("ql")), _vectors(spark, d).select("id", "label")
    return near.join(a, "qid").join(b, "id").where("ql != label").select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"with {_KNN}, v as (select qid, label, round(sum(sim), 9) w from n where rank <= 7 group by 1, 2) select qid, arg_min(label, (-w, label)) as label, round(max(w), 6) as weight from v group by 1")
def knn_vote(spark, d):
    near = similarity.top_k(_asked(spark, d), _vectors(spark, d), 7, drop_self=True)
    return similarity.vote(near, _vectors(spark, d).select("id", "label")).withColumn("weight", F.round("weight", 6))


def _centroids(spark, d):
    each = _vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("v")).select(F.col("label").cast("bigint").alias("id"), "v")


_CENTROIDS = "c as (select label, list(m order by i) v from (select label, i, avg(embedding[i]::double) m from embeddings, generate_series(1, 64) g(i) group by 1, 2) group by 1)"


@query(f"""with {_CENTROIDS}, s as (select c.label::bigint qid, vec_id id, list_dot_product(c.v, embedding::double[]) sim from c, embeddings),
n as (select *, row_number() over (partition by qid order by round(sim, 12) desc, id) as rank from s) select qid, id, round(sim, 6) as sim, rank::int as rank from n where rank <= 220""")
def prompt_topk(spark, d):
    return similarity.top_k(_centroids(spark, d), _vectors(spark, d), 220).select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"""with {_CENTROIDS}, s as (select vec_id, c.label, 8 * list_dot_product(c.v, embedding::double[]) s from c, embeddings), e as (select *, exp(s - max(s) over (partition by vec_id)) e from s),
p as (select vec_id, label, e / sum(e) over (partition by vec_id) p from e), r as (select *, row_number() over (partition by vec_id order by round(p, 12) desc, label) r from p)
select vec_id, string_agg('t' || label, ',' order by r) as tags from r where r <= 3 and p > 0.08 group by 1""")
def tags_topk(spark, d):
    # the vocabulary is one row of at most a few hundred prompts
    vocab = _centroids(spark, d).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("c")).withColumn("_key", F.lit(1))
    j = _vectors(spark, d).withColumn("_key", F.lit(1)).join(F.broadcast(vocab), "_key")
    probs = vectors.softmax(F.transform("c", lambda c: vectors.dot(c.v, F.col("v"))), 8.0)
    names = F.transform("c", lambda c: F.concat(F.lit("t"), c.id.cast("string")))
    top = vectors.top_labels(names, F.transform(probs, lambda p: F.round(p, 12)), 3, 0.08)
    return j.select(F.col("id").alias("vec_id"), F.array_join(F.transform(top, lambda s: s["name"]), ",").alias("tags")).where("tags != ''")


@query(f"select a.vec_id as id_a, b.vec_id as id_b, round({_DOT}, 6) as sim from embeddings a join embeddings b on b.vec_id - a.vec_id between 1 and 20 and a.label = b.label where {_DOT} >= 0.2")
def near_pairs(spark, d):
    p = similarity.band_pairs(_vectors(spark, d), "id", 20, ["label"]).withColumn("sim", vectors.dot(F.col("v_a"), F.col("v_b")))
    return p.where("sim >= 0.2").select("id_a", "id_b", F.round("sim", 6).alias("sim"))


@query("""
with recursive o as (select label, vec_id, embedding::double[] v, row_number() over (partition by label order by vec_id) r from embeddings),
g as (select label, r, [v] kept, [vec_id] ids from o where r = 1 union all
 select g.label, o.r, case when list_max(list_transform(g.kept, lambda k: list_dot_product(k, o.v))) < 0.3 then list_append(g.kept, o.v) else g.kept end, case when list_max(list_transform(g.kept, lambda k: list_dot_product(k, o.v))) < 0.3 then list_append(g.ids, o.vec_id) else g.ids end
 from g join o on o.label = g.label and o.r = g.r + 1),
l as (select label, arg_max(ids, r) ids from g group by 1) select label, unnest(ids) as id from l""")
def greedy_suppress(spark, d):
    return similarity.suppress(_vectors(spark, d), ["label"], ["id"], 0.3)


@query(f"with s as (select a.vec_id id, b.vec_id other, round({_DOT}, 9) sim from embeddings a join embeddings b on a.label = b.label and b.vec_id < a.vec_id where a.vec_id % 100 = 0) select id, arg_max(other, (sim, -other)) as other, round(max(sim), 6) as sim from s group by 1")
def max_sim_same_group(spark, d):
    s = similarity.most_similar(_asked(spark, d), _vectors(spark, d), ["label"], earlier=True)
    return s.withColumn("sim", F.round("sim", 6))


@query(f"select a.vec_id as id from embeddings a where a.vec_id % 100 = 0 and not exists (select 1 from embeddings b where a.label = b.label and b.vec_id < a.vec_id and {_DOT} >= 0.2)")
def none_similar(spark, d):
    q = _asked(spark, d)
    near = similarity.most_similar(q, _vectors(spark, d), ["label"], earlier=True).where("sim >= 0.2")
    return q.select("id").join(near.select("id"), "id", "left_anti")


@query()
def taste_model(spark, d):
    """``score`` of the final model for all vectors, and ``p``, the held-out score of training rows (else null).

    Iterative, so without SQL (held against an independent solver in the tests).
    """
    rows = _vectors(spark, d).select("id", F.expr("cast(id div 10 as bigint)").alias("grp"), "v", (F.col("label") >= 5).alias("label"))
    fit = model.fit_preference(rows)
    none = F.lit(None).cast("double")
    if fit is None:
        return rows.select("id", "label", none.alias("p"), none.alias("score")).limit(0)
    scores = fit.score(rows.where("v is not null")).select("id", "label", F.col("p").alias("score"))
    return scores.join(fit.held_out.select("id", "p"), "id", "left").select("id", "label", "p", "score")


# Text and JSON


@query("""
select doc_id from documents where contains(lower(concat_ws(' ', text, source)), 'ferry') order by lower(trim(source)) != 'captions', doc_id""")
def search_docs(spark, d):
    hay = F.lower(F.concat_ws(" ", "text", "source"))
    return read(spark, d, "documents").where(hay.contains("ferry")).orderBy(F.lower(F.trim("source")) != "captions", "doc_id").select("doc_id")


@query("select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as k, max((props->>'k')::bigint) as top from events group by 1")
def json_props(spark, d):
    e = read(spark, d, "events").withColumn("k", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"}).k)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.max("k").alias("top"))


@query("""
with s as (select image_id, unnest(string_split(reasons, ',')) r from (select distinct image_id, reasons from selection)) select trim(r) as reason, count(*) as n from s where trim(r) != '' group by 1""")
def reason_counts(spark, d):
    from framelake.functions.text import split_trim

    s = read(spark, d, "selection").select("image_id", "reasons").distinct().select(F.explode(split_trim(F.col("reasons"), ",")).alias("reason"))
    return s.groupBy("reason").agg(F.count("*").alias("n"))


@query("""
select event_id, greatest(-50.0, least(50.0, value + k - 60)) as contrast, greatest(0.0, least(100.0, k * 1.5)) as vibrance from (select event_id, value, (props->>'k')::double k from events)""")
def delta_clamp(spark, d):
    k = F.from_json("props", "k double").k
    bounds = {"contrast": (-50.0, 50.0)}
    e = read(spark, d, "events").withColumn("k", k)
    delta = vectors.merge_settings(F.create_map(F.lit("contrast"), F.col("value")), F.create_map(F.lit("contrast"), F.col("k") - 60, F.lit("unknown"), F.col("k")), bounds, True)
    fixed = vectors.merge_settings(F.create_map(F.lit("vibrance"), F.col("value")), F.create_map(F.lit("vibrance"), F.col("k") * 1.5), {"vibrance": (0.0, 100.0)}, False)
    return e.select("event_id", F.try_element_at(delta, F.lit("contrast")).alias("contrast"), F.try_element_at(fixed, F.lit("vibrance")).alias("vibrance"))


@query("""
select distinct image_id, coalesce(clip_dark between 0 and 1 and clip_bright between 0 and 1 and clip_dark + contrast / 100 between 0 and 1 and clip_bright + 0.5 between 0 and 1 and clip_dark + contrast / 100 - clip_dark >= 0.05, false) as ok from technical""")
def crop_valid(spark, d):
    left, top = F.col("clip_dark"), F.col("clip_bright")
    ok = vectors.valid_crop(left, top, left + F.col("contrast") / 100, top + 0.5)
    return read(spark, d, "technical").select("image_id", ok.alias("ok")).distinct()


@query(r"""
with p as (select distinct path from images where path is not null), s as (select path, string_split(substr(path, 2), '/') a from p), n as (select '/' || array_to_string(a[1:i], '/') node, i, i = len(a) leaf from s, generate_series(1, 12) g(i) where i <= len(a))
select node, case when min(i) > 1 then regexp_replace(node, '/[^/]*$', '') end as parent, min(i)::int as depth, bool_or(leaf) as is_leaf, count(*) as below from n group by node""")
def hierarchy_expand(spark, d):
    return ch.hierarchy(read(spark, d, "images").select("path").where("path is not null").distinct(), "path")


# Plan, diff, apply


def _states(spark, d):
    i = read(spark, d, "images").groupBy("image_id").agg(F.max("rating").alias("rating"), F.max("pick").alias("pick"), F.min("lens").alias("title"), F.min("camera").alias("caption"))
    s = read(spark, d, "selection").groupBy("image_id").agg(F.min("tier").alias("tier"))
    rank = F.when(F.col("tier") == "hero", 5).when(F.col("tier") == "select", 4).otherwise(2)
    wanted = s.select("image_id", rank.alias("rating"), F.when(F.col("tier") == "hero", 1).otherwise(0).alias("pick"), F.col("tier").alias("title"), F.concat(F.lit("as "), "tier").alias("caption"))
    return wanted, i


_RULES = {"rating": "raise", "pick": "if_zero", "title": "fill_blank", "caption": "set"}
_STATE = """
c as (select image_id, max(rating) rating, max(pick) pick, min(lens) title, min(camera) caption from images group by 1),
w as (select image_id, case tier when 'hero' then 5 when 'select' then 4 else 2 end wr, case tier when 'hero' then 1 else 0 end wp, tier wt, 'as ' || tier wc from (select image_id, min(tier) tier from selection group by 1)),
j as (select *, c.pick = -1 guarded from c join w using (image_id)),
p as (select image_id, 'rating' field, rating::varchar as old, wr::varchar as new from j where wr > rating and not guarded
 union all select image_id, 'pick', pick::varchar, wp::varchar from j where pick = 0 and wp != 0 and not guarded
 union all select image_id, 'title', title, wt from j where (title is null or trim(title) = '') and trim(wt) != ''
 union all select image_id, 'caption', caption, wc from j where caption is distinct from wc)"""


def _plan(spark, d):
    wanted, now = _states(spark, d)
    return ch.plan(wanted, now, "image_id", _RULES, protected=F.col("pick") == -1, still_allowed=["title", "caption"]), wanted, now


@query(f"with {_STATE} select image_id, field, old, new from p")
def plan_diff(spark, d):
    return _plan(spark, d)[0]


@query("select image_id, 'x' as field, 'x' as old, 'x' as new from images where false")
def plan_converges(spark, d):
    """The plan against the applied state: no rows."""
    changes, wanted, now = _plan(spark, d)
    after = ch.apply(now, changes, "image_id", list(_RULES))
    return ch.plan(wanted, after, "image_id", _RULES, protected=F.col("pick") == -1, still_allowed=["title", "caption"])


@query(f"with {_STATE} select field, count(*) as changes, count(distinct image_id) as images from p group by 1")
def plan_summary(spark, d):
    return _plan(spark, d)[0].groupBy("field").agg(F.count("*").alias("changes"), F.count_distinct("image_id").alias("images"))


@query("""
with have as (select distinct image_id, lower(reasons) f from selection where reasons != ''), want as (select doc_id, image_id, lower(trim(source)) f from documents where image_id is not null and source is not null)
select distinct image_id, f as member from want where (image_id, f) not in (select (image_id, f) from have)""")
def membership_adds(spark, d):
    want = read(spark, d, "documents").where("image_id is not null").select("image_id", F.lower(F.trim("source")).alias("member"))
    return ch.additions(want, read(spark, d, "selection").where("reasons != ''").select("image_id", F.col("reasons").alias("member")), "image_id", "member")


@query(r"""
with i as (select distinct image_id, path, path_state, format from images), raw as (select distinct lower(regexp_replace(path, '\.[^./]+$', '')) s from i where format = 'RAW'), n as (select lower(path) p, count(*) n from i group by 1)
select image_id, case when path is null or path not like '/%' then 'bad_path' when path_state = 'found' then 'already_there' when format = 'VIDEO' then 'skipped' when format != 'RAW' and lower(regexp_replace(path, '\.[^./]+$', '')) in (select s from raw) then 'raw_sibling' when n.n > 1 then 'listed_twice' else 'import' end as outcome from i left join n on n.p = lower(path)""")
def import_buckets(spark, d):
    i = read(spark, d, "images").select("image_id", "path", "path_state", "format").distinct()
    stem = F.lower(F.concat(paths.dirname(F.col("path")), F.lit("/"), paths.stem(F.col("path"))))
    raw = i.where("format = 'RAW'").select(stem.alias("_s")).distinct().withColumn("_raw", F.lit(True))
    twice = i.groupBy(F.lower("path").alias("_p")).agg(F.count("*").alias("_n"))
    j = i.withColumn("_s", stem).withColumn("_p", F.lower("path")).join(raw, "_s", "left").join(twice, "_p", "left")
    rules = [("bad_path", F.col("path").isNull() | ~F.col("path").startswith("/")), ("already_there", F.col("path_state") == "found"), ("skipped", F.col("format") == "VIDEO"), ("raw_sibling", (F.col("format") != "RAW") & F.col("_raw")), ("listed_twice", F.col("_n") > 1)]
    return ch.first_match(j, rules, "import").select("image_id", "outcome")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def merge_upsert(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return ch.upsert(e.where(half), e.where(~half), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
select user_id, arg_max(value, event_id) as value, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) filter (where event_type = 'purchase') as bought from events group by 1""")
def merge_rounds(spark, d):
    e = read(spark, d, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.array("value")).otherwise(F.array().cast("array<double>")))
    return ch.merge_rounds(e, "user_id", "event_id", ["value", "event_type"], ["bought"]).withColumn("bought", F.try_element_at("bought", F.lit(1)))


@query("""
with c as (select c_custkey k, arg_max(o_orderpriority, o_orderkey) filter (where o_orderstatus = 'F') seg, arg_max(o_totalprice, o_orderkey) filter (where o_orderstatus = 'O') bal from orders join customer on o_custkey = c_custkey group by 1)
select c_custkey, case when seg is not null then 'fixed' else c_name end as c_name, coalesce(seg, c_mktsegment) as c_mktsegment, coalesce(bal, c_acctbal) as c_acctbal from customer left join c on k = c_custkey""")
def apply_corrections(spark, d):
    o = read(spark, d, "orders")
    fix = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("c_mktsegment").alias("field"), F.col("o_orderpriority").alias("value"), "o_orderkey").unionByName(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit("c_acctbal").alias("field"), F.col("o_totalprice").cast("string").alias("value"), "o_orderkey"))
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return ch.correct(rows, fix, "c_custkey", ["c_mktsegment", "c_acctbal"], "o_orderkey", implied={"c_mktsegment": ("c_name", "fixed")})


@query("""
with e as (select event_id, user_id::varchar item, event_type, 'r' || (case when event_type = 'error' then 1 else 2 end) run from events where event_type in ('view', 'purchase', 'error'))
select item, case when bool_or(event_type = 'purchase') then 'done' else 'uncertain' end as state, arg_max(event_id::varchar, event_id) filter (where event_type = 'purchase') as result from e where run = 'r2' group by 1""")
def log_replay(spark, d):
    e = read(spark, d, "events").where(F.col("event_type").isin("view", "purchase", "error"))
    run = F.when(F.col("event_type") == "error", "r1").otherwise("r2")
    line = F.concat_ws("\t", F.lit("2024 INFO"), F.when(F.col("event_type") == "purchase", "OK").otherwise("ATTEMPT"), run, F.col("user_id").cast("string"), F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")))
    return ch.replay(e.select(line.alias("line"), F.col("event_id").alias("at")), "r2")


@query("""
select event_id, case when not (value >= 1) then 'skip_unreadable' when event_type = 'purchase' and value > 10 then 'done' when event_type = 'purchase' then 'complete' when event_type = 'signup' then 'skip_untagged' else 'create' end as action from events""")
def copy_states(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_type") == "purchase").alias("t"), (F.col("value") > 10).alias("c"), (F.col("event_type") == "signup").alias("n"), (F.col("value") >= 1).alias("r"))
    return ch.copy_state(e, "t", "c", "n", "r").select("event_id", "action")


# Streaming, run to its end over the table as a file source


def _event_stream(spark, d):
    # the file source takes a folder or a pattern
    return inc.file_stream(spark, f"{d}/[e]vents.parquet", read(spark, d, "events").schema)


def _sink(spark, name):
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query(ORACLE_SQL["merge_upsert"])
def stream_upsert(spark, d):
    """Three files, out of order, one a batch: each later one is merged into what the earlier ones left."""
    files, table = _sink(spark, "events"), _sink(spark, "upsert")
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    e.repartition(3, F.pmod("event_id", F.lit(3))).write.parquet(files)
    inc.upsert_stream(inc.file_stream(spark, files, e.schema), table, table + "-log", ["user_id", "event_type"], ["ts", "event_id"]).awaitTermination()
    return inc.current(spark, table, e.schema).select("user_id", "event_type", "event_id", "value")


_STREAM_SESSIONS = """
with g as (select user_id, epoch_us(ts) / 1e6 t, case when epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over w <= 3600 then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) no from g), r as (select user_id, min(t) a, max(t) b, count(*) n from s group by user_id, no)
select user_id, round(a, 3) as start, round(b, 3) as "end", n as events from r"""


@query(_STREAM_SESSIONS)
def stream_sessions(spark, d):
    """Sessions closed by the stateful stream, and those that its last watermark leaves open, closed in batch.

    The watermark lags by what the files overlap in time, so no session is closed before all its rows are read;
    as it begins at 1970, earlier times are moved beyond it meanwhile.
    """
    events, out = read(spark, d, "events"), _sink(spark, "sessions")
    late = inc.files_lateness(events, "ts")
    least = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    shift = 1 - least // 1_000_000 if least is not None and least <= 0 else 0
    moved = lambda df: df.select("user_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + shift * 1_000_000).alias("ts"))
    q = inc.session_stream(moved(_event_stream(spark, d)), "user_id", "ts", 3600, f"{late} seconds")
    return _run_sessions(spark, q, out, moved(events), shift)


def _run_sessions(spark, stream, out, events, shift):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema("user_id bigint, start double, end double, events bigint").parquet(out)
    # what the last watermark leaves open is closed by the batch operator over the rows after each user's last closed session
    last = closed.groupBy("user_id").agg(F.max("end").alias("_last"))
    rest = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t")).join(last, "user_id", "left").where("_last is null or t > _last")
    w = Window.partitionBy("user_id").orderBy("t")
    g = rest.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) > 3600).cast("int"), F.lit(1))).withColumn("_no", F.sum("_new").over(w)).groupBy("user_id", "_no").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("events")).drop("_no")
    return closed.unionByName(g).select("user_id", F.round(F.col("start") - shift, 3).alias("start"), F.round(F.col("end") - shift, 3).alias("end"), "events")


@query("select event_type, time_bucket(interval '1 day', ts)::date::varchar as day, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    """Counts per day and type; every batch's changed windows are merged into a table by their key."""
    s = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    table = _sink(spark, "windows")
    w = inc.windowed_counts(s, "ts", "0 seconds", "1 day", ["event_type"]).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    inc.upsert_stream(w, table, table + "-log", ["event_type", "day"], ["n"], mode="update").awaitTermination()
    return inc.current(spark, table, w.schema)


# Features of Spark that the reference has no counterpart for


@query("""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as level, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)""")
def native_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select n_regionkey, c_nationkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_nationkey)")
def native_rollup(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"))


@query("(select s_nationkey as k from supplier where s_acctbal > 0 intersect select c_nationkey from customer) except select n_nationkey from nation where n_regionkey = 0")
def native_set_operations(spark, d):
    s = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return s.intersect(read(spark, d, "customer").select("c_nationkey")).subtract(read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("""
select o_orderkey, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, first_value(o_totalprice) over w as first, nth_value(o_totalprice, 2) over (w rows between unbounded preceding and unbounded following) as second, ntile(4) over w::int as quarter from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def native_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.first(p).over(w).alias("first"), F.nth_value(p, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"), F.ntile(4).over(w).alias("quarter"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) as last_hour from events")
def native_range_frame(spark, d):
    e = read(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("last_hour"))


@query("select l_returnflag, count(distinct l_partkey) as parts, true as close from lineitem group by 1")
def native_approx_distinct(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("a"))
    return g.select("l_returnflag", "parts", (F.abs(F.col("a") / F.col("parts") - 1) < 0.1).alias("close"))


@query("""
select distinct image_id, case when rating between 1 and 5 then floor(rating)::bigint end as rating, case when lower(trim(format)) in ('raw', 'dng', 'jpg') then lower(trim(format)) end as format, nullif(trim(lens), '') as lens,
  concat_ws(',', case when rating is not null and not rating between 1 and 5 then 'rating' end, case when format is not null and lower(trim(format)) not in ('raw', 'dng', 'jpg') then 'format' end) as warnings from images""")
def normalised_entries(spark, d):
    from framelake.operators.relational import normalised

    n = normalised(read(spark, d, "images"), ["lens"], {"rating": (1, 5)}, {"format": ["raw", "dng", "jpg"]})
    return n.select("image_id", "rating", "format", "lens", F.array_join("warnings", ",").alias("warnings")).distinct()


@query("""
select image_id, case when tier = 'reject' then 'reject' when image_id in (select image_id from images where rating >= 4) then 'portfolio' else 'keep' end as verdict from (select distinct image_id, tier from selection)""")
def verdict_override(spark, d):
    from framelake.operators.relational import override

    s = read(spark, d, "selection").select("image_id", F.col("tier").alias("verdict")).distinct()
    return override(s, read(spark, d, "images").where("rating >= 4"), "image_id", "verdict", "portfolio", "keep", ["reject"])


@query("""
select distinct image_id, case orientation when 'BC' then 'clockwise' when 'CD' then 'half_turn' when 'DA' then 'counterclockwise' when 'BA' then 'mirror' when 'DC' then 'flip' when 'AD' then 'transpose' when 'CB' then 'transverse' else 'none' end as turn from images""")
def orientation_turns(spark, d):
    from framelake.functions.pixels import turn

    return read(spark, d, "images").select("image_id", turn(F.col("orientation")).alias("turn")).distinct()


@query("select c_custkey, c_name from customer where not coalesce(c_nationkey between 5 and 9, false) union all select s_suppkey + 900000000, s_name from supplier where s_nationkey between 5 and 9")
def scoped_replacement(spark, d):
    from framelake.sources.writers import replace_where

    new = read(spark, d, "supplier").where("s_nationkey between 5 and 9").select((F.col("s_suppkey") + 900_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return replace_where(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), new, F.col("c_nationkey").between(5, 9)).select("c_custkey", "c_name")


@query()
def near_demotions(spark, d):
    """Sequential by definition; held against brute force in the tests."""
    v = _vectors(spark, d).withColumns({"t": F.col("id"), "score": F.col("label").cast("double"), "star": F.col("label") == 9})
    return similarity.demote_near(v, [], "t", 20, 0.2, "score", "star")
