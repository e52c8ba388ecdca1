"""Queries of the training-data problems and, where SQL can state them, the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.identifiers import hex64, whole_number
from framelake.llm.cutoffs import keep_cutoffs, kept_items
from framelake.llm.hamming_pairs import close_groups, close_hashes, close_records, pruning
from framelake.llm.mixing import mix
from framelake.llm.packing import fills, pack
from framelake.llm.quantiles import BOUND, merge_sketches, percentiles, sketch
from framelake.llm.spans import shared_characters, shared_stretches, sharers, sharing_clusters, sharing_pairs
from framelake.llm.tokens import token_counts
from framelake.llm.topn import top_n
from framelake.physical import broadcast_if_small
from framelake.staging import stage

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Problem 1: near-duplicate records with small edits


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "technical").select(F.col("image_id").alias("id"), hex64(F.col("phash")).alias("h"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return close_records(_hashes(spark, d), 6).withColumnsRenamed({"id_a": "image_id_a", "id_b": "image_id_b"})


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return close_groups(_hashes(spark, d), 6).withColumnRenamed("id", "image_id")


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different hashes that the exact form finds (tolerance 0), and how many of them the default tolerance finds."""
    h = stage(_hashes(spark, d).select("h"), "hashes")
    every, some = close_hashes(h, 6, tolerance=0), close_hashes(h, 6).withColumn("hit", F.lit(True))
    return every.join(some, ["ha", "hb"], "full").agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))


def p1_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons before and after each pruning step."""
    return pruning(_hashes(spark, d).select("h"), 6)


# Problem 2: cutoff keeping a target fraction


def _year_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    goals = _read(spark, d, "keep_targets").select(whole_number(F.col("year")).alias("grp"), F.col("target_permille").alias("permille"))
    years = _read(spark, d, "images").select("image_id", whole_number(F.col("year")).alias("grp")).where("grp is not null").groupBy("image_id").agg(F.min("grp").alias("grp"))
    scores = _read(spark, d, "selection").where("score is not null and not isnan(score)").select("image_id", "score").groupBy("image_id").agg(F.max("score").alias("score"))
    return stage(scores.join(years, "image_id"), "year-scores"), goals


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, goals = _year_scores(spark, d)
    return kept_items(items, goals).select(F.col("grp").alias("year"), "image_id")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    items, goals = _year_scores(spark, d)
    return keep_cutoffs(items, goals).drop("rounds").withColumnRenamed("grp", "year")


# Problem 3: percentiles of very large numeric columns

SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _measures(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """``year``, ``metric``, ``v``: the usable measurements, one row per image and metric; images without a year don't count."""
    years = _read(spark, d, "images").select("image_id", whole_number(F.col("year")).alias("year")).where("year > 0").groupBy("image_id").agg(F.min("year").alias("year"))
    ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))
    metrics = ("sharp_top3", "luma")
    one = _read(spark, d, "technical").groupBy("image_id").agg(*[F.max(ok(c)).alias(c) for c in metrics])
    return one.join(years, "image_id").select("year", *more, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in metrics])).alias("m")).select("year", *more, "m.*").where("v is not null")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["year", "metric"]
    return percentiles(sketch(_measures(spark, d), keys, "v"), keys, list(SHARES))


def p3_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketch(_measures(spark, d), ["year", "metric"], "v")


def _within(values: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each percentile's true rank lies within the bound, counted over all values."""
    got = stage(got, "percentiles")
    ranks = values.join(broadcast_if_small(got), keys).groupBy(*keys, "share", "n").agg(F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("share") * F.col("n") - 1e-9))
    slack = BOUND * F.least(rank, F.col("n") - rank + 1)
    return ranks.select(*keys, "share", "n", ((F.col("below") + 1 <= rank + slack) & (F.col("upto") >= rank - slack)).alias("within"))


def p3_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    keys = ["year", "metric"]
    values = stage(_measures(spark, d), "measures")
    return _within(values, percentiles(sketch(values, keys, "v"), keys, list(SHARES)), keys)


def p3_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """As ``p3_rank_errors``, of sketches that were made and stored for each day (or none) by itself and merged afterwards."""
    keys = ["year", "metric"]
    days = _read(spark, d, "images").groupBy("image_id").agg(F.min(F.substring("capture_time", 1, 10)).alias("day"))
    values = stage(_measures(spark, d, "image_id").join(days, "image_id").drop("image_id"), "measures")
    by_day = stage(sketch(values, [*keys, "day"], "v"), "day-sketches")
    return _within(values, percentiles(merge_sketches(by_day.drop("day"), keys), keys, list(SHARES)), keys)


# Problem 6: top N items within every group


def _burst_scores(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "selection").select(F.col("burst").alias("grp"), F.col("image_id").alias("id"), "score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_burst_scores(spark, d), 3, least=5).select(F.col("grp").alias("burst"), F.col("id").alias("image_id"))


def p6_top3(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_burst_scores(spark, d), 3).select(F.col("grp").alias("burst"), F.col("id").alias("image_id"), "score", "rank")


# Problem 7: filling fixed-capacity containers


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), "text")
    return stage(token_counts(docs), "sizes")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pack_sizes").select(F.col("pack_name").alias("kind"), F.col("capacity_tokens").alias("capacity"))


_PACKED = {"kind": "pack_name", "id": "doc_id"}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sized(spark, d), _kinds(spark, d)).withColumnsRenamed(_PACKED)


def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    kinds = _kinds(spark, d)
    return fills(pack(_sized(spark, d), kinds), kinds).withColumnsRenamed(_PACKED)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of ``p7_containers``, counted over all documents and containers of each kind.

    ``overfull`` containers, ``needless`` (documents in pieces that would fit whole), ``torn`` (documents whose pieces
    don't add up to their size), and whether the containers are within one in a hundred of what the tokens fill.
    """
    kinds, sizes = _kinds(spark, d), _sized(spark, d)
    packed = stage(pack(sizes, kinds), "packed")
    cap = F.broadcast(kinds.where("capacity >= 1").distinct())  # checked by pack: one row per kind
    bins = fills(packed, kinds).join(cap, "kind").groupBy("kind", "capacity").agg(F.count_if(F.col("free") < 0).alias("overfull"), F.count_if(F.col("used") > 0).alias("bins"), F.sum("used").alias("used"))
    docs = packed.groupBy("kind", "id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("got")).join(sizes.select("id", "tokens"), "id", "full").join(cap, "kind", "left")
    of = docs.groupBy("kind").agg(F.count("*").alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("needless"), F.count_if(~F.col("got").eqNullSafe(F.col("tokens"))).alias("torn"))
    full = F.col("bins") <= F.ceil(F.col("used") / F.col("capacity")) * 1.01 + 1
    return of.join(bins, "kind").select(F.col("kind").alias("pack_name"), "docs", "overfull", "needless", "torn", full.alias("full"))


# Problem 8: mixing sources to target weights


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "mix_targets").select(F.col("mix_name").alias("mix"), F.lower(F.trim("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))


_MIXED = {"mix": "mix_name", "id": "doc_id"}


def p8_order(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), _targets(spark, d))[0].withColumnsRenamed(_MIXED)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), _targets(spark, d))[1].withColumnsRenamed(_MIXED)


def p8_balanced_shares(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixes in which every source that has documents reaches its share."""
    return mix(_sized(spark, d), _targets(spark, d), size="targets")[1].withColumnsRenamed(_MIXED)


def p8_scheduled_order(spark: SparkSession, d: str) -> DataFrame:
    """Captions fade out over the training time, letters and series texts come in halfway."""
    late = [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]
    return mix(_sized(spark, d), _targets(spark, d), schedules={"captions": [(0.0, 1.0), (1.0, 0.0)], "letters": late, "series-texts": late})[0].withColumnsRenamed(_MIXED)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the order and shares of each mix and source, at both sizes, counted over all documents.

    ``docs`` with tokens in the source, most ``copies`` beyond the cap, whether each source meets its demand to within half
    its largest document (or gives all it may), and whether the reported tokens are those of the order.
    """
    sized, targets = _sized(spark, d), _targets(spark, d)
    have = sized.where("tokens > 0").groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    out = None
    for size in ("all", "targets"):
        order, shares = mix(sized, targets, size=size)
        got = order.groupBy("mix", "source").agg(F.sum("tokens").alias("in_order"), F.max("copy").alias("copy"))
        j = targets.join(shares.drop("target_share"), ["mix", "source"]).join(got, ["mix", "source"], "left").join(have, "source", "left")
        reach = F.min(F.when(F.col("tokens") > 0, F.col("repeats") * F.col("tokens") / F.col("share"))).over(Window.partitionBy("mix"))
        every = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix"))
        demand = F.col("share") * (every if size == "all" else F.least(reach, every.cast("double")))
        ask = F.least(demand, F.col("repeats") * F.coalesce("tokens", F.lit(0)).cast("double"))
        met = F.abs(F.col("used_tokens") - ask) <= F.coalesce("largest", F.lit(0)) / 2 + 1e-6
        j = j.select("mix", "source", F.lit(size).alias("size"), F.coalesce("docs", F.lit(0).cast("bigint")).alias("docs"), (F.coalesce("copy", F.lit(-1)) < F.col("repeats")).alias("capped"), met.alias("met"), (F.coalesce("in_order", F.lit(0)) == F.col("used_tokens")).alias("reported"))
        out = j if out is None else out.unionByName(j)
    return out.withColumnsRenamed(_MIXED)


# Problem 9: long exact spans shared between records


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_pairs(sharers(_texts(spark, d))).withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)
    return shared_characters(docs, shared_stretches(docs)).withColumnRenamed("id", "doc_id")


def p9_clusters(spark: SparkSession, d: str) -> DataFrame:
    return sharing_clusters(sharers(_texts(spark, d))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_recall": p1_recall,
    "p1_pruning": p1_pruning,
    "p2_found": p2_found,
    "p2_cutoffs": p2_cutoffs,
    "p3_percentiles": p3_percentiles,
    "p3_sketches": p3_sketches,
    "p3_rank_errors": p3_rank_errors,
    "p3_merged_days": p3_merged_days,
    "p6_found": p6_found,
    "p6_top3": p6_top3,
    "p7_containers": p7_containers,
    "p7_fills": p7_fills,
    "p7_invariants": p7_invariants,
    "p8_order": p8_order,
    "p8_shares": p8_shares,
    "p8_balanced_shares": p8_balanced_shares,
    "p8_scheduled_order": p8_scheduled_order,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_shared": p9_shared,
    "p9_clusters": p9_clusters,
}

_SQL_SPACE = r"[\s\p{Z}]"
_SQL_YEAR = rf"try_cast(nullif(regexp_extract(regexp_replace(year, '{_SQL_SPACE}', '', 'g'), '^(\d+)(\.0*)?$', 1), '') as bigint)"
_SQL_P1 = r"""
with raw as (select distinct image_id, regexp_replace(regexp_replace(regexp_replace(lower(phash), '[\s\p{Z}:-]', '', 'g'), '^0x', ''), '^0+', '') s from technical),
t as (select image_id, ('0x' || lpad(s, 16, '0'))::ubigint h from raw where regexp_full_match(s, '[0-9a-f]{1,16}'))
select a.image_id image_id_a, b.image_id image_id_b from t a join t b on a.image_id < b.image_id and bit_count(xor(a.h, b.h)) <= 6
"""
_SQL_P2 = rf"""
with y as (select distinct image_id, {_SQL_YEAR} yr from images),
k as (select {_SQL_YEAR} yr, target_permille from keep_targets),
s as (select distinct y.yr, s.image_id, s.score, k.target_permille p from selection s join y using (image_id) join k using (yr) where s.score is not null and not isnan(s.score)),
r as (select *, count(*) over (partition by yr) n, count(*) over (partition by yr order by score desc range between unbounded preceding and current row) reach from s),
c as (select yr, max(n) n, max(greatest(1, (n * p + 999) // 1000)) need, max(score) filter (where reach >= greatest(1, (n * p + 999) // 1000)) cutoff from r group by yr)
"""
_SQL_P3 = rf"""
with y as (select distinct image_id, {_SQL_YEAR} as year from images),
t as (select distinct image_id, sharp_top3, luma from technical),
m as (select image_id, 'sharp_top3' metric, sharp_top3 v from t union all select image_id, 'luma', luma from t),
u as (select y.year, m.metric, count(*) n from m join y using (image_id) where v is not null and not isnan(v) and v >= 0 and not isinf(v) and y.year > 0 group by all)
select year, metric, share::double as share, n, true as within from u, unnest([{", ".join(map(str, SHARES))}]) s(share)"""
_SQL_P6 = """
with s as (select distinct burst, image_id, score from selection where burst is not null and score is not null and not isnan(score)),
r as (select *, row_number() over (partition by burst order by score desc, image_id) rank, count(*) over (partition by burst) n from s)
"""

_SQL_P9 = """
with g as (select doc_id, text, unnest(range(1, length(text) - 198)) k from documents where length(text) >= 200),
h as (select doc_id, k, md5(substr(text, k, 200)) s from g), m as (select s, min(doc_id) lo, max(doc_id) hi from h group by 1 having min(doc_id) != max(doc_id)),
f as (select doc_id, k, s from h join m using (s))
"""

_SQL_P9_PAIRS = _SQL_P9 + "select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from (select distinct s, doc_id from f) a join (select distinct s, doc_id from f) b on a.s = b.s and a.doc_id < b.doc_id"


def _sql_components(pairs: str, a: str, b: str, node: str, group: str, size: str) -> str:
    """SQL for the components of a query's pairs: all that each node reaches, then the least of it."""
    return f"""
with recursive e as materialized ({pairs}), p as materialized (select {a} x, {b} y from e union select {b}, {a} from e), r as (select x, x m from p union select r.x, p.y from r join p on p.x = r.m)
select x as {node}, min(m) as {group}, count(*) as {size} from r group by x"""


ORACLE_SQL: dict[str, str] = {
    "p1_found": _SQL_P1,
    "p1_recall": _SQL_P1.replace("t as (select image_id,", "t as (select distinct").replace("select a.image_id image_id_a, b.image_id image_id_b", "select count(*) as pairs, count(*) as found").replace("a.image_id < b.image_id", "a.h < b.h"),
    "p1_groups": _sql_components(_SQL_P1, "image_id_a", "image_id_b", "image_id", "group_id", "group_size"),
    "p2_found": _SQL_P2 + "select r.yr as year, r.image_id from r join c using (yr) where r.score >= c.cutoff",
    "p2_cutoffs": _SQL_P2 + "select c.yr as year, c.n, c.need::bigint as need, c.cutoff, count(*) as kept from c join r using (yr) where r.score >= c.cutoff group by all",
    "p3_rank_errors": _SQL_P3,
    "p3_merged_days": _SQL_P3,
    "p8_invariants": """
with d as (select lower(trim(source)) source, count(*) n from documents where text != '' group by 1), z(size) as (values ('all'), ('targets'))
select mix_name, lower(trim(t.source)) as source, size, coalesce(n, 0) as docs, true as capped, true as met, true as reported from mix_targets t cross join z left join d on d.source = lower(trim(t.source))""",
    "p7_invariants": """
select pack_name, count(distinct doc_id) as docs, 0::bigint as overfull, 0::bigint as needless, 0::bigint as torn, true as "full" from pack_sizes, documents where capacity_tokens >= 1 group by 1""",
    "p9_found": _SQL_P9_PAIRS,
    "p9_clusters": _sql_components(_SQL_P9_PAIRS, "doc_id_a", "doc_id_b", "doc_id", "cluster_id", "cluster_size"),
    "p9_shared": _SQL_P9
    + """, n as (select doc_id, least(200, coalesce(lead(k) over (partition by doc_id order by k) - k, 200)) c from (select distinct doc_id, k from f)), c as (select doc_id, sum(c)::bigint c from n group by 1)
select doc_id, coalesce(length(text), 0) as chars, coalesce(c, 0) as shared_chars, case when length(text) > 0 then coalesce(c, 0) / length(text) else 0.0 end as share from documents left join c using (doc_id)""",
    "p6_found": _SQL_P6 + "select burst, image_id from r where rank <= 3 and n >= 5",
    "p6_top3": _SQL_P6 + "select burst, image_id, score, rank::int as rank from r where rank <= 3",
}
