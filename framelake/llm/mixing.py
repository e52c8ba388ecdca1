"""Mixing sources to target weights along a curriculum.

Method: time-varying curriculum.  Each source has a weight schedule over the
training time t in [0, 1], piecewise linear, scaled so that its integral is the
source's share.  The integral of the schedule is the source's cumulative token
demand; inverting it gives every document copy, by its cumulative place in its
source, the time at which it is due.  Documents are then range-sorted by time.

Cumulative places come from a range-sorted table (sums of earlier parts plus a
running sum within the part), so a source that holds a third of all documents
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.physical import broadcast_if_small, part_offsets, range_sorted
from framelake.staging import stage

#: By default the weight of sources that may repeat rises by this much from the middle to the end (and is lower by as much at the start).
RAMP = 0.5

Knots = list[tuple[float, float]]


def schedule_segments(knots: Knots) -> list[tuple[float, float, float, float]]:
    """Segments (t0, weight at t0, slope, integral up to t0) of a piecewise linear schedule over [0, 1] with integral 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("knots must go from t = 0 to t = 1, ascending, with weights of at least 0")
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, w0 / total, (w1 - w0) / (t1 - t0) / total, done))
        done += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def _due(y: Column, segments: Column) -> Column:
    """The time at which the schedule's integral reaches ``y``."""
    s = F.element_at(F.filter(segments, lambda s: s.c0 <= y), -1)
    dy = y - s.c0
    root = F.sqrt(F.greatest(F.lit(0.0), s.w0 * s.w0 + 2 * s.slope * dy))
    # the stable form of the quadratic's solution; a flat segment is no special case
    return F.least(F.lit(1.0), s.t0 + F.coalesce(F.try_divide(2 * dy, s.w0 + root), F.lit(0.0)))


def mix_plan(docs: DataFrame, targets: DataFrame, schedules: dict[str, Knots] | None = None, total_tokens: int | None = None, ramp: float = RAMP, size: str = "all") -> DataFrame:
    """One row per ``mix`` and ``source`` of ``targets``: ``share``, ``repeats``, ``available``, ``demand``, ``take``, ``segments``.

    With ``size`` "all" a mix is as large as all documents of its sources
    together; a source is asked for its share of that and gives at most
    ``repeats`` times its own tokens, so where one is too small the others'
    shares end up above target.  With "targets" a mix is as large as it can be
    (but no larger than all documents) while every source that has documents
    reaches its share of it; only the share of absent sources is missing.  ``total_tokens`` sets the size.
    """
    if size not in ("all", "targets"):
        raise ValueError("size must be 'all' or 'targets'")
    have = docs.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"))
    ask = targets.where("mix is not null and source is not null and share >= 0 and repeats >= 0").groupBy("mix", "source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    plan = ask.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    w = Window.partitionBy("mix")
    reach = F.min(F.when((F.col("available") > 0) & (F.col("share") > 0), F.col("repeats") * F.col("available") / F.col("share"))).over(w)
    total = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.sum("available").over(w) if size == "all" else F.coalesce(F.least(reach, F.sum("available").over(w).cast("double")), F.lit(0.0))
    plan = plan.withColumn("demand", F.col("share") * total).withColumn("take", F.least("demand", F.col("repeats") * F.col("available").cast("double")))
    again = F.col("repeats") > 1
    up, once = F.sum(F.when(again, F.col("share")).otherwise(0.0)).over(w), F.sum(F.when(again, 0.0).otherwise(F.col("share"))).over(w)
    r = F.least(F.lit(float(ramp)), F.coalesce(F.try_divide(once, up), F.lit(0.0)))
    tilt = F.when(again, r).otherwise(-r * F.coalesce(F.try_divide(up, once), F.lit(0.0)))
    segments = F.array(F.struct(F.lit(0.0).alias("t0"), (1 - tilt).alias("w0"), (2 * tilt).alias("slope"), F.lit(0.0).alias("c0")))
    for source, knots in (schedules or {}).items():
        own = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(seg, ("t0", "w0", "slope", "c0"))]) for seg in schedule_segments(knots)])
        segments = F.when(F.col("source") == source, own).otherwise(segments)
    return plan.withColumn("segments", segments)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """The training order and the shares reached.

    ``docs``: ``id``, ``source``, ``tokens``; ``targets``: ``mix``, ``source``,
    ``share``, ``repeats``; further columns are ignored.  Documents of null or
    no size or of no named source are left out; every row is a document of its
    own.  A source uses all its documents once (in an order drawn by hash)
    before any is repeated; the last one is taken if its middle is within the
    demand, so a source misses its demand by at most half a document.

    Order: ``mix``, ``position`` (from 0), ``source``, ``id``, ``copy`` (from
    0), ``tokens``.  Shares: ``mix``, ``source``, ``target_share``,
    ``available_tokens``, ``used_tokens``, ``reached_share``, ``documents``,
    ``most_copies``, ``short`` (asked for more than it may give); a source that
    is absent has zeros.
    """
    docs = docs.where("id is not null and tokens > 0").select("id", "source", "tokens")
    plan = stage(mix_plan(docs, targets, **how), "mix-plan")
    named = broadcast_if_small(plan.select("source").distinct())
    rows = range_sorted(docs.join(named, "source", "left_semi"), [F.col("source"), F.xxhash64(F.lit(seed), "id"), F.col("id")], "mix-docs")
    run = F.sum("tokens").over(Window.partitionBy("_part", "source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    before = part_offsets(rows, ["source"], F.col("tokens"))
    placed = rows.withColumn("_run", run).join(broadcast_if_small(stage(before, "offsets")), ["_part", "source"]).withColumn("mid", F.col("_before") + F.col("_run") - F.col("tokens") / 2).select("id", "source", "tokens", "mid")
    copies = F.least(F.col("repeats").cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("take") - F.col("mid")) / F.col("available")) + 1))
    used = placed.join(broadcast_if_small(plan.where("take > 0")), "source").withColumn("n", copies).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    y = F.least(F.lit(1.0), (F.col("copy") * F.col("available") + F.col("mid")) / F.col("take"))
    due = used.withColumn("t", _due(y, F.col("segments"))).select("mix", "t", "source", "id", "copy", "tokens")
    order = range_sorted(due, [F.col(c) for c in ("mix", "t", "source", "id", "copy")], "mix-order")
    starts = order.groupBy("_part", "mix").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("mix").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(starts.select("_part", "mix", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    numbered = order.join(broadcast_if_small(starts), ["_part", "mix"]).select("mix", (F.col("_shift") + F.col("_row")).alias("position"), "source", "id", "copy", "tokens")
    got = order.groupBy("mix", "source").agg(F.sum("tokens").alias("used_tokens"), F.count_if(F.col("copy") == 0).alias("documents"), (F.max("copy") + 1).cast("bigint").alias("most_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    all_used = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy("mix"))
    shares = plan.join(got, ["mix", "source"], "left").select(
        "mix", "source", F.col("share").alias("target_share"), F.col("available").alias("available_tokens"), zero("used_tokens"),
        F.coalesce(F.try_divide(F.coalesce("used_tokens", F.lit(0)), all_used), F.lit(0.0)).alias("reached_share"), zero("documents"), zero("most_copies"), (F.col("take") < F.col("demand") * (1 - 1e-12)).alias("short"),
    )
    return numbered, shares
