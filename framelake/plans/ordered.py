"""Queries: sessions and bursts, ranks, tiers, dealing, percentiles, rank fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions.identifiers import hex64, squeezed
from framelake.functions.times import local_seconds
from framelake.operators import ranking as rk
from framelake.operators import scoring as sc
from framelake.operators import windows as wn
from framelake.operators.relational import best_by
from framelake.plans.audit import query as _query
from framelake.plans.audit import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql=None):
    return _query(sql, (QUERIES, ORACLE_SQL))


def _events(spark, d):
    e = read(spark, d, "events")
    return e.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)"))


HOUR_US = 3_600_000_000
_BURSTS = """
b as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as burst from (select *, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) <= 3600000000 then 0 else 1 end n from events))"""


@query(f"with {_BURSTS} select event_id, user_id, burst from b")
def session_bursts(spark, d):
    return wn.bursts(_events(spark, d), ["user_id"], "us", "event_id", HOUR_US).select("event_id", "user_id", "burst")


@query(f"with {_BURSTS}, s as (select user_id, burst, count(*) n from b group by all) select user_id, count(*) as bursts, count(*) filter (where n > 1) as many, max(n) as longest from s group by 1")
def bursts_with_many(spark, d):
    b = wn.bursts(_events(spark, d), ["user_id"], "us", "event_id", HOUR_US).groupBy("user_id", "burst").agg(F.count("*").alias("n"))
    return b.groupBy("user_id").agg(F.count("*").alias("bursts"), F.count_if(F.col("n") > 1).alias("many"), F.max("n").alias("longest"))


@query(r"""
with i as (select distinct image_id, trim(regexp_replace(lower(camera), '[\s\p{Z}]+', ' ', 'g')) camera, left(capture_time, 19) s from images),
t as (select image_id, camera, epoch(try_strptime(translate(left(s, 10), ':', '-') || ' ' || substr(s, 12), '%Y-%m-%d %H:%M:%S'))::bigint t from i where camera != '' and regexp_full_match(s, '\d{4}[-:]\d\d[-:]\d\d[T ]\d\d:\d\d:\d\d')),
h as (select image_id, min(h) h from (select image_id, case when regexp_full_match(s, '[0-9a-f]{1,16}') then ('0x' || lpad(s, 16, '0'))::ubigint end h from (select image_id, regexp_replace(regexp_replace(regexp_replace(lower(phash), '[\s\p{Z}:-]', '', 'g'), '^0x', ''), '^0+', '') s from technical)) group by 1),
l as (select image_id, camera, t, h, lag(t) over w lt, lag(h) over w lh from t left join h using (image_id) where t is not null window w as (partition by camera order by t, image_id))
select image_id, camera, sum(case when t - lt <= 3 and coalesce(bit_count(xor(h, lh)), 0) <= 20 then 0 else 1 end) over (partition by camera order by t, image_id rows unbounded preceding)::bigint as burst from l""")
def burst_similarity(spark, d):
    i = read(spark, d, "images").select("image_id", squeezed(F.col("camera")).alias("camera"), local_seconds(F.col("capture_time")).alias("t")).where("camera is not null and t is not null").distinct()
    h = read(spark, d, "technical").select("image_id", hex64(F.col("phash")).alias("h")).groupBy("image_id").agg(F.min("h").alias("h"))
    return wn.bursts(i.join(h, "image_id", "left"), ["camera"], "t", "image_id", 3, bits="h").select("image_id", "camera", "burst")


_Z = "round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6)"


@query(f"""
with {_BURSTS}, z as (select event_id, user_id, burst, {_Z} as z from b),
k as (select *, row_number() over (partition by user_id, burst order by z desc, event_id) k from z),
r as (select event_id, user_id, burst, z, row_number() over (order by z desc, event_id) r, count(*) over () n from k where k = 1)
select event_id, user_id, burst, z, case when r <= greatest(1, floor(n * 0.015 + 1e-9)) then 'hero' when r <= greatest(0, floor(n * 0.1 + 1e-9)) then 'select' else 'keep' end as tier from r""")
def best_of_burst(spark, d):
    e = sc.zscores(wn.bursts(_events(spark, d), ["user_id"], "us", "event_id", HOUR_US), ["value"]).withColumn("z", F.round("value_z", 6))
    best = best_by(e.select("event_id", "user_id", "burst", "z"), ["user_id", "burst"], [F.desc("z"), F.col("event_id")])
    return wn.tiers(best, [F.desc("z"), F.col("event_id")], [("hero", 0.015, 1), ("select", 0.1, 0)], "keep")


@query("""
with t as (select image_id, min(lap_var) a, min(contrast) b from technical group by 1), s as (select avg(ln(1 + a)) ma, stddev_pop(ln(1 + a)) sa, avg(b) mb, stddev_pop(b) sb from t)
select image_id, round(0.7 * (ln(1 + a) - ma) / sa + 0.3 * (b - mb) / sb, 5) as score from t, s""")
def zscore_blend(spark, d):
    t = read(spark, d, "technical").groupBy("image_id").agg(F.log1p(F.min("lap_var")).alias("a"), F.min("contrast").alias("b"))
    return sc.blend(t, {"a": 0.7, "b": 0.3}).select("image_id", F.round("score", 5).alias("score"))


@query("""
select o_orderkey, case when count(*) over (partition by o_orderdate::date) > 1 then (row_number() over (partition by o_orderdate::date order by o_totalprice, o_orderkey) - 1) / (count(*) over (partition by o_orderdate::date) - 1) - 0.5 else 0.0 end as scaled_rank from orders""")
def day_rank(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return wn.scaled_rank(o, ["day"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "scaled_rank")


@query("""
with s as (select image_id, max(score) score from selection where score is not null and not isnan(score) group by 1), r as (select *, row_number() over (order by score desc, image_id) r, count(*) over () n from s)
select image_id, case when r <= greatest(1, floor(n * 0.015 + 1e-9)) then 'hero' when r <= greatest(0, floor(n * 0.1 + 1e-9)) then 'select' else 'keep' end as tier from r""")
def tiers(spark, d):
    s = read(spark, d, "selection").where("score is not null and not isnan(score)").groupBy("image_id").agg(F.max("score").alias("score"))
    return wn.tiers(s, [F.desc("score"), F.col("image_id")], [("hero", 0.015, 1), ("select", 0.1, 0)], "keep").select("image_id", "tier")


@query("""
with i as (select image_id, max(rating) rating, max(pick) pick from images group by 1), s as (select image_id, min(tier) tier from selection group by 1)
select image_id, case when tier = 'hero' or rating >= 4 then 'hero' when tier = 'select' or pick = 1 or rating >= 3 then 'select' else 'keep' end as tier from s join i using (image_id)""")
def tier_floors(spark, d):
    i = read(spark, d, "images").groupBy("image_id").agg(F.max("rating").alias("rating"), F.max("pick").alias("pick"))
    s = read(spark, d, "selection").groupBy("image_id").agg(F.min("tier").alias("tier"))
    j = s.join(i, "image_id").withColumn("tier", F.when(F.col("tier").isin("hero", "select"), F.col("tier")).otherwise("keep"))
    return wn.raise_to(j, "tier", ["hero", "select", "keep"], [(F.col("rating") >= 4, "hero"), ((F.col("pick") == 1) | (F.col("rating") >= 3), "select")]).select("image_id", "tier")


@query("""
with n as (select *, count(*) over (partition by ts::date) n, row_number() over (partition by ts::date order by value desc, event_id) r from events) select event_id from n where n >= 8 and r <= greatest(3, ceil(n * 0.03 - 1e-9))""")
def shoot_topn(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return wn.quota(e, ["day"], [F.desc("value"), F.col("event_id")], 3, 0.03, 8).select("event_id")


_PART = "with p as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) - 1 pos, count(*) over () n from part) select p_partkey, "


def _parts(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")]


@query(_PART + "(pos % ceil(n / 36))::bigint as hand from p")
def deal_groups(spark, d):
    return wn.deal(*_parts(spark, d), 36).select("p_partkey", "hand")


@query(_PART + "floor(pos / ceil(n / ceil(n / 45)))::bigint as chunk from p")
def chunks(spark, d):
    return wn.balanced_chunks(*_parts(spark, d), 45).select("p_partkey", "chunk")


@query(_PART + "pos // 9 as batch from p")
def batches9(spark, d):
    return wn.batches(*_parts(spark, d), 9).select("p_partkey", "batch")


@query("""
select o_orderkey, row_number() over w = 1 or o_orderstatus is distinct from lag(o_orderstatus) over w as starts from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def section_starts(spark, d):
    return wn.section_starts(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus").select("o_orderkey", "starts")


@query("""
select c_custkey, coalesce(lag(c_custkey) over w, last_value(c_custkey) over (w rows between unbounded preceding and unbounded following)) as before, coalesce(lead(c_custkey) over w, first_value(c_custkey) over (w rows between unbounded preceding and unbounded following)) as after
from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)""")
def ring_neighbours(spark, d):
    return wn.neighbours(read(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")], "c_custkey").select("c_custkey", "before", "after")


@query("""
select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) r from (select distinct l_partkey, l_orderkey, l_linenumber from lineitem)) where r = 1""")
def first_occurrence(spark, d):
    return wn.first_occurrence(read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
with b as (select distinct l_partkey k from lineitem where l_returnflag = 'R'), k as (select distinct l_partkey k from lineitem where l_tax = 0), n as (select distinct l_partkey k from lineitem where l_quantity >= 45), c as (select distinct l_partkey k from lineitem where l_discount >= 0.1)
select k as l_partkey, 'added' as fate from (select * from n except select * from b) union all select k, 'removed' from (select * from b except select * from n) union all select k, 'rehomed' from (select * from c intersect select * from n)
union all select k, 'unaccounted' from (select k from (select * from b union select * from k) except select * from n except select * from c)""")
def accounting(spark, d):
    part = lambda cond: read(spark, d, "lineitem").where(cond).select("l_partkey")
    return rk.accounting(part("l_returnflag = 'R'"), part("l_tax = 0"), part("l_quantity >= 45"), part("l_discount >= 0.1"), "l_partkey")


@query("""
with p as (select unnest([0.5, 0.9, 0.99]) share) select l_returnflag, share::double as share, case share when 0.5 then quantile_cont(l_extendedprice, 0.5) when 0.9 then quantile_cont(l_extendedprice, 0.9) else quantile_cont(l_extendedprice, 0.99) end as l_extendedprice from lineitem, p group by l_returnflag, share""")
def percentiles(spark, d):
    return sc.linear_percentiles(read(spark, d, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.99], ["l_returnflag"])


@query("""
with r as (select l_quantity, l_linestatus, row_number() over (partition by l_linestatus order by l_quantity) - 1 i, count(*) over (partition by l_linestatus) n from lineitem), p as (select unnest([1, 5, 25, 50, 75, 95, 99, 100])::int percent)
select l_linestatus, percent, l_quantity from r, p where i = least(n * percent // 100, n - 1)""")
def ladder(spark, d):
    return sc.percentile_ladder(read(spark, d, "lineitem"), "l_quantity", [1, 5, 25, 50, 75, 95, 99, 100], ["l_linestatus"])


_AUC = """
with x as (select {g} format, lap_var s, tier in ('hero', 'select') y from (select image_id, min(lap_var) lap_var from technical group by 1) join (select image_id, min(tier) tier from selection group by 1) using (image_id) join (select image_id, min(format) format from images group by 1) using (image_id)),
r as (select *, rank() over (partition by format order by s) + (count(*) over (partition by format, s) - 1) / 2 r from x), a as (select format, count(*) filter (where y) pos, count(*) filter (where not y) neg, sum(case when y then r else 0 end) ranks from r group by 1)
select {c} pos, neg, round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) as auc from a where pos > 0 and neg > 0"""


def _labelled(spark, d):
    t = read(spark, d, "technical").groupBy("image_id").agg(F.min("lap_var").alias("lap_var"))
    s = read(spark, d, "selection").groupBy("image_id").agg(F.min("tier").alias("tier"))
    i = read(spark, d, "images").groupBy("image_id").agg(F.min("format").alias("format"))
    return t.join(s, "image_id").join(i, "image_id").withColumn("y", F.col("tier").isin("hero", "select"))


@query(_AUC.format(g="'all'", c=""))
def auc_overall(spark, d):
    return sc.auc(_labelled(spark, d), "lap_var", "y").withColumn("auc", F.round("auc", 6))


@query(_AUC.format(g="format", c="format,"))
def auc_within(spark, d):
    return sc.auc(_labelled(spark, d), "lap_var", "y", ["format"]).withColumn("auc", F.round("auc", 6))


@query("""
with n as (select n_regionkey, c_nationkey, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1, 2) select c_nationkey, n / max(n) over (partition by n_regionkey) as of_max, n / sum(n) over (partition by n_regionkey) as of_total from n""")
def share_rollup(spark, d):
    n = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"))
    return sc.shares(n, "n", ["n_regionkey"]).select("c_nationkey", "of_max", "of_total")


_VOTES = """
with t as (select c_custkey item, c_acctbal a, count(o_orderkey) b, coalesce(round(sum(o_totalprice), 2), 0) c from customer left join orders on c_custkey = o_custkey group by all),
v as (select 'a' ballot, item, row_number() over (order by a desc, item) - 1 place from t union all select 'b', item, row_number() over (order by b desc, item) - 1 from t union all select 'c', item, row_number() over (order by c desc, item) - 1 from t),
u as (select * from v where place < 60), p as (select item, sum(60 - place)::bigint points, count(*) ballots from u group by 1)"""


def _votes(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("b"), F.round(F.sum("o_totalprice"), 2).alias("c"))
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("a")).join(o, F.col("item") == F.col("o_custkey"), "left").na.fill(0, ["b", "c"])
    out = None
    for judge in "abc":  # each ballot is a top-60 report, taken without a global sort
        top = t.orderBy(F.desc(judge), "item").limit(60)
        v = top.select(F.lit(judge).alias("ballot"), "item", (F.row_number().over(Window.partitionBy(F.lit(judge)).orderBy(F.desc(judge), "item")) - 1).alias("place"))
        out = v if out is None else out.unionByName(v)
    return out


@query(_VOTES + " select item, points, ballots from p")
def borda(spark, d):
    return rk.borda_rows(_votes(spark, d), 60)


@query(_VOTES + " select ballot, item, place / 59 as position from u")
def ballot_positions(spark, d):
    return rk.relative_position(_votes(spark, d), ["ballot"], "place").select("ballot", "item", "position")


@query(_VOTES + """, a as (select item, 0 tier, -points k from p union all select c_custkey, 1, 0 from customer where c_mktsegment = 'BUILDING' union all select c_custkey, 2, 0 from customer),
f as (select item, tier, k from (select *, row_number() over (partition by item order by tier) r from a) where r = 1) select item, tier, row_number() over (order by tier, k, item) as rank from f""")
def final_ranking(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.lit(0).cast("bigint").alias("k"), "c_mktsegment")
    first = rk.borda_rows(_votes(spark, d), 60).select("item", (-F.col("points")).cast("bigint").alias("k"))
    u = rk.tiered_union([first, c.where("c_mktsegment = 'BUILDING'").select("item", "k"), c.select("item", "k")], "item", ["k"])
    return wn.ranked(u, [F.col("tier"), F.col("k"), F.col("item")]).select("item", "tier", "rank")


@query("select count(*) as n, true as ok from customer")
def ranking_bijection(spark, d):
    return rk.bijection(final_ranking(spark, d), "rank", "item")


@query("""
with m as (select distinct p_brand key, p_type grp from part), s as (select grp, count(distinct key) n from m group by 1) select key, arg_min(grp, (n, grp)) as grp from m join s using (grp) group by 1""")
def theme_argmin(spark, d):
    m = read(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("grp"), F.col("p_type").alias("place")).distinct()
    return rk.primary_group(m, "key", "grp", "place")


@query("""
with u as (select l_partkey, count(*) n from lineitem group by 1) select p_type, count(distinct p_partkey) as parts, count(distinct case when n >= 30 then p_partkey end) as busy, arg_min(p_partkey, (-coalesce(n, 0), p_partkey)) as cover from part left join u on l_partkey = p_partkey group by 1 having count(distinct p_partkey) >= 3""")
def theme_rollup(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    j = read(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    g = j.groupBy("p_type").agg(F.count_distinct("p_partkey").alias("parts"), F.count_distinct(F.when(F.col("n") >= 30, F.col("p_partkey"))).alias("busy"), F.min_by("p_partkey", F.struct((-F.coalesce("n", F.lit(0))).alias("a"), F.col("p_partkey").alias("b"))).alias("cover"))
    return g.where("parts >= 3")


@query("""
with m as (select distinct l_partkey k, 'returned' m from lineitem where l_returnflag = 'R' union select distinct l_partkey, 'bulk' from lineitem where l_quantity >= 49 union select p_partkey, 'dear' from part where p_retailprice >= 1500) select k as part, string_agg(m, ',' order by m) as methods from m group by 1""")
def methods_union(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "part")
    return rk.methods([("returned", li.where("l_returnflag = 'R'")), ("bulk", li.where("l_quantity >= 49")), ("dear", read(spark, d, "part").where("p_retailprice >= 1500").withColumnRenamed("p_partkey", "part"))], "part")


@query("select camera, count(*) as n from (select distinct image_id, camera from images) where camera is not null group by 1 having count(*) >= 20")
def owned_having(spark, d):
    return read(spark, d, "images").where("camera is not null").select("image_id", "camera").distinct().groupBy("camera").agg(F.count("*").alias("n")).where("n >= 20")


@query("""
with o as (select camera from (select distinct image_id, camera from images) where camera is not null group by 1 having count(*) >= 20),
s as (select i.image_id, min((case when i.camera is null or o.camera is null then 1 else 0 end) + (case when format in ('JPG', 'PNG') then 1 else 0 end) + (case when width < 2000 then 1 else 0 end) + (case when path_state != 'found' then 1 else 0 end)) n from images i left join o using (camera) group by 1)
select image_id, n as signals from s where n >= 2""")
def signals(spark, d):
    own = owned_having(spark, d).select("camera").withColumn("_own", F.lit(1))
    j = read(spark, d, "images").join(own, "camera", "left")
    rules = [F.col("_own").isNull(), F.col("format").isin("JPG", "PNG"), F.col("width") < 2000, F.col("path_state") != "found"]
    n = sum((F.coalesce(r.cast("int"), F.lit(0)) for r in rules), F.lit(0))
    return j.groupBy("image_id").agg(F.min(n).alias("signals")).where("signals >= 2")


@query("""
select p_brand, min(case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 else 2 end) as best, count(*) as n from part group by 1""")
def folder_groups(spark, d):
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    return read(spark, d, "part").groupBy("p_brand").agg(F.min(rank).alias("best"), F.count("*").alias("n")).orderBy("best", F.desc("n"), "p_brand")


@query("""
with v as (select distinct image_id, clip_dark a, clip_bright b, contrast / 100 c from technical) select image_id, max(greatest(a, b, c)) as value, max(case when c >= a and c >= b then 'flat' when a >= b then 'dark' else 'bright' end) as label from v group by 1""")
def argmax_label(spark, d):
    from framelake.functions.vectors import greatest_label

    t = read(spark, d, "technical").select("image_id", "clip_dark", "clip_bright", "contrast").distinct()
    best = greatest_label([(F.col("clip_bright"), "bright"), (F.col("clip_dark"), "dark"), (F.col("contrast") / 100, "flat")])
    return t.withColumn("g", best).groupBy("image_id").agg(F.max("g.value").alias("value"), F.max("g.label").alias("label"))


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 240 offset 480")
def listing_page(spark, d):
    return wn.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 240).select("o_orderkey")


@query("with r as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) rank from customer) select c_custkey, rank from r where rank >= (select greatest(1, least(50, max(rank))) from r) and rank < (select greatest(1, least(50, max(rank))) from r) + 25")
def jump_to_rank(spark, d):
    r = wn.ranked(read(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")])
    return wn.around_rank(r, "rank", 50, 25).select("c_custkey", "rank")


@query("with s as (select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) - 1 pos from supplier) select s_suppkey, pos // 9 as sheet, chr((65 + pos % 9)::int) as slot from s")
def contact_slots(spark, d):
    return wn.slots(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "sheet", "slot")


@query("select regexp_extract(path, '^/[^/]*/[^/]*') as folder, count(*) as n from images group by 1 order by n desc, min(image_id) limit 25")
def common_folders(spark, d):
    i = read(spark, d, "images").withColumn("folder", F.regexp_extract("path", "^/[^/]*/[^/]*", 0))
    return wn.most_common(i, "folder", "image_id", 25)


@query("with r as (select p_partkey, row_number() over (order by p_retailprice, p_partkey) r from part) select p_partkey, r > 150 as deferred from r")
def deferred_work(spark, d):
    return wn.limited(read(spark, d, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice"), F.col("p_partkey")], 150).select("p_partkey", "deferred")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice <= 300000, o_orderkey) r from orders) where r = 1")
def first_good_row(spark, d):
    from framelake.operators.relational import first_where

    return first_where(read(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 300000, "o_orderkey").select("o_custkey", "o_orderkey")
