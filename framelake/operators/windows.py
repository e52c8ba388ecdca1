"""Ordered operators: bursts, ranks within groups, dealing, chunking, tiers.

Operators over a whole table (tiers, dealing) take positions from a range sort
with part offsets, never from a window without partition keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.vectors import bit_distance
from framelake.physical import global_position, group_position, part_offsets, range_sorted
from framelake.staging import stage, unstage


def bursts(rows: DataFrame, scope: Sequence[str], time: str, tie: str, gap: float, bits: str | None = None, most_bits: int = 20) -> DataFrame:
    """Number the bursts of each scope (``burst``, from 1) in order of (time, tie).

    A new burst begins where the step from the previous row is more than ``gap``
    or, with ``bits`` (a bigint column), where it differs from the previous
    row's in more than ``most_bits`` bits; drift over several rows is allowed.
    Rows with a null time get a null burst and are no neighbours; null bits
    count as no difference.

    A scope may hold any share of the rows: they are range-sorted by (scope, time, tie) and staged, so a large scope
    spans many parts; each part gets the last row of the parts before it, and
    burst numbers are the part's own counts plus those of earlier parts.
    """
    timed = rows.where(F.col(time).isNotNull())
    data = range_sorted(timed, [*map(F.col, scope), F.col(time), F.col(tie)], "bursts")
    own = [*scope, time, *([bits] if bits else [])]
    ends = data.groupBy("_part").agg(F.max_by(F.struct(*own), "_row").alias("_end"))
    order = Window.orderBy("_part")  # one row per part
    ends = ends.select("_part", F.lag("_end").over(order).alias("_end"))
    w = Window.partitionBy("_part").orderBy("_row")
    j = data.join(F.broadcast(ends), "_part").withColumn("_prev", F.coalesce(F.lag(F.struct(*own)).over(w), F.col("_end")))
    same = F.lit(True)
    for k in scope:
        same = same & F.col(k).eqNullSafe(F.col(f"_prev.{k}"))
    new = F.col(time) - F.col(f"_prev.{time}") > gap
    if bits:
        new = new | F.coalesce(bit_distance(F.col(bits), F.col(f"_prev.{bits}")) > most_bits, F.lit(False))
    j = j.withColumn("_new", F.when(F.col("_prev").isNull() | ~same, 1).otherwise(new.cast("int")))
    j = j.withColumn("_no", F.sum("_new").over(Window.partitionBy("_part", *scope).orderBy("_row")))
    starts = part_offsets(j, list(scope), F.col("_new")).withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(["_part", *scope])})
    on = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(["_part", *scope])]
    numbered = j.join(starts, on).withColumn("burst", (F.col("_no") + F.col("_before")).cast("bigint")).select(*rows.columns, "burst")
    # staged, since callers tend to read it several times
    numbered = stage(numbered, "bursts")
    unstage(data)
    return numbered.unionByName(rows.where(F.col(time).isNull()).withColumn("burst", F.lit(None).cast("bigint")))


def group_size(rows: DataFrame, keys: Sequence[str], name: str = "group_size") -> DataFrame:
    """Rows per key beside each row; null keys are one group (counted by aggregation and joined null-safely)."""
    n = rows.groupBy(*keys).agg(F.count("*").alias(name)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(n, on).drop(*[f"_k{i}" for i in range(len(keys))])


def scaled_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "scaled_rank") -> DataFrame:
    """Ordinal rank within the group, scaled to -1/2 .. 1/2; 0 in a group of one.  A group may hold any share of the rows."""
    pos = group_size(group_position(rows, list(keys), list(order), "scaled"), keys, "_n")
    return pos.withColumn(name, F.when(F.col("_n") > 1, F.col("_pos") / (F.col("_n") - 1) - 0.5).otherwise(0.0)).drop("_n", "_pos")


def quota(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], floor: int, share: float, least_rows: int = 1) -> DataFrame:
    """The best max(floor, ceil(share * n)) rows of every group that has at least ``least_rows``.  A group may hold any share of the rows."""
    pos = group_size(group_position(rows, list(keys), list(order), "quota"), keys, "_n")
    return pos.where((F.col("_n") >= least_rows) & (F.col("_pos") < F.greatest(F.lit(floor), F.ceil(F.col("_n") * share - 1e-9)))).drop("_n", "_pos")


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position in the order of the whole table; the order should be total."""
    pos = global_position(range_sorted(rows, list(order), "ranked"))
    return pos.withColumn(name, F.col("_pos") + 1).drop("_pos", "_part", "_row")


def _total(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.agg(F.count("*").alias("_total")))


def tiers(rows: DataFrame, order: Sequence[Column], cuts: Sequence[tuple[str, float, int]], rest: str, name: str = "tier") -> DataFrame:
    """Name a tier by position: each cut is (tier, cumulative share, least rows), the share rounded down; others are ``rest``."""
    pos = ranked(rows, order, "_rank").withColumn("_key", F.lit(1))
    pos = pos.join(_total(rows).withColumn("_key", F.lit(1)), "_key")
    out = None
    for tier, share, least in cuts:
        cond = F.col("_rank") <= F.greatest(F.lit(least), F.floor(F.col("_total") * share + 1e-9))
        out = F.when(cond, tier) if out is None else out.when(cond, tier)
    return pos.withColumn(name, out.otherwise(rest)).drop("_key", "_total", "_rank")


def raise_to(rows: DataFrame, tier: str, ladder: Sequence[str], rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Lift ``tier`` to at least a rule's tier where the rule holds; ``ladder`` is best first."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ladder)), c)
    best = F.least(place(F.col(tier)), *[F.when(cond, place(F.lit(t))) for cond, t in rules])
    return rows.withColumn(tier, F.element_at(F.array(*map(F.lit, ladder)), best.cast("int")))


def deal(rows: DataFrame, order: Sequence[Column], hand: int, name: str = "hand") -> DataFrame:
    """Deal the ordered rows round robin to ceil(N / hand) hands, so that all get a share of the best."""
    return _by_position(rows, order, lambda pos, n: pos % F.ceil(n / hand), name)


def balanced_chunks(rows: DataFrame, order: Sequence[Column], most: int, name: str = "chunk") -> DataFrame:
    """Contiguous chunks of ceil(N / n) rows with n = ceil(N / most); only the last may be shorter (unlike ntile)."""
    return _by_position(rows, order, lambda pos, n: F.floor(pos / F.ceil(n / F.ceil(n / most))), name)


def batches(rows: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Contiguous batches of ``size`` rows."""
    return _by_position(rows, order, lambda pos, n: F.floor(pos / size), name)


def _by_position(rows: DataFrame, order, number, name: str) -> DataFrame:
    pos = global_position(range_sorted(rows, list(order), name)).withColumn("_key", F.lit(1))
    # the total is one row; an equality on a constant keeps this an ordinary broadcast join
    pos = pos.join(_total(rows).withColumn("_key", F.lit(1)), "_key")
    return pos.withColumn(name, number(F.col("_pos"), F.col("_total")).cast("bigint")).drop("_key", "_pos", "_part", "_row", "_total")


def section_starts(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], label: str, name: str = "starts") -> DataFrame:
    """Whether the row's label differs from the previous row's (true for the first)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn(name, (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w)))


def neighbours(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """``before`` and ``after``: the value of the row before and after, the ends joined to a ring.

    Rows meet by their positions in the scope, so a scope may hold any share of them.
    """
    pos = stage(group_size(group_position(rows, list(scope), list(order), "ring"), scope, "_n"), "ring")
    keys = [f"_k{i}" for i in range(len(scope))]
    out = pos
    for name, step in (("before", 1), ("after", -1)):
        other = pos.select(*[F.col(k).alias(q) for k, q in zip(scope, keys)], F.pmod(F.col("_pos") + step, F.col("_n")).alias("_at"), F.col(value).alias(name))
        on = [F.col("_pos") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(q)) for k, q in zip(scope, keys)]]
        out = out.join(other, on).drop("_at", *keys)
    return out.drop("_pos", "_n")


def first_occurrence(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Each key's first row in the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page (from 0) of a listing; the limit is the feature, so only the rows up to the page's end are ordered."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def around_rank(rows: DataFrame, rank: str, wanted: int, size: int) -> DataFrame:
    """``size`` ranks from ``wanted`` on, which is clamped to the ranks there are."""
    top = rows.agg(F.max(rank).alias("_top")).withColumn("_key", F.lit(1))
    at = F.greatest(F.lit(1), F.least(F.lit(wanted), F.col("_top")))
    return rows.withColumn("_key", F.lit(1)).join(F.broadcast(top), "_key").where((F.col(rank) >= at) & (F.col(rank) < at + size)).drop("_key", "_top")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random, the same ones for the same seed; every task sends its own ``n`` first only.

    The draw is by a hash of ``key``, so it doesn't depend on how rows are spread; equal keys are drawn together.
    """
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def slots(rows: DataFrame, order: Sequence[Column], size: int = 9) -> DataFrame:
    """Sheets of ``size`` rows: ``sheet`` from 0 and ``slot``, a letter from A."""
    b = batches(rows, order, size, "sheet")
    w = Window.partitionBy("sheet").orderBy(*order)
    return b.withColumn("slot", F.char(F.lit(64) + F.row_number().over(w)))


def most_common(rows: DataFrame, key: str, first: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys with their counts, ties by first sighting (least ``first``)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def limited(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """All rows with ``deferred``: whether they lie beyond the first ``most`` of the order."""
    return ranked(rows, order, "_rank").withColumn("deferred", F.col("_rank") > most).drop("_rank")
