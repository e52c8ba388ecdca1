"""Score cutoffs that keep a target fraction of every group.

Method: cutting-plane order statistic.  The need-th largest score of a group
is the only minimiser of the pinball loss

    f(t) = up * sum(max(x - t, 0)) + down * sum(max(t - x, 0)),
    up = n - need + 1/2, down = need - 1/2,

whose value and subgradient at several t per group come from a single
aggregation.  The tangents at both ends of the bracket cross at one t; it is
evaluated together with points that close in on it from either side and the
middle of the bracket, so that long tails cannot stall it.  The subgradient's
sign (the counts) says between which two of them the minimum lies, hence
rounding of the losses cannot make it wrong.  The new bracket is snapped to the
scores that lie there; scores outside are carried as sums only.  Rounds end when
a bracket holds one score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.physical import BROADCAST_ROWS, broadcast_if_small
from framelake.staging import stage, unstage

#: How close the points of a round lie to the crossing, as shares of its distance to either end.
CLOSER = (1 / 2, 1 / 8, 1 / 64)
POINTS = 2 * len(CLOSER) + 3


def keep_cutoffs(scores: DataFrame, targets: DataFrame, max_rounds: int = 400) -> DataFrame:
    """``grp``, ``n``, ``need``, ``cutoff``, ``kept``, ``rounds`` of every group of ``targets`` that has scores.

    ``scores``: ``grp``, ``score`` double (one row per item); ``targets``:
    ``grp``, ``permille``.  Null and NaN scores and null groups don't count.
    ``need`` is n * permille / 1000, rounded up, at least 1; the cutoff is the
    highest score that ``need`` items reach; where ``need`` exceeds ``n`` there
    is none (null, nothing kept).  Infinite scores are ordinary.  ``rounds``
    says how often the loss was evaluated.
    """
    goal = targets.where("grp is not null and permille is not null").groupBy("grp").agg(F.max("permille").alias("permille"))
    usable = scores.where(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    values = stage(usable.join(broadcast_if_small(goal), "grp", "left_semi").groupBy("grp", "score").agg(F.count("*").alias("c")), "values")
    inf = F.lit(float("inf"))
    finite = F.abs("score") < inf
    head = values.groupBy("grp").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("score") == inf, F.col("c"))), F.lit(0)).alias("n_top"),
        F.coalesce(F.sum(F.when(finite, F.col("c"))), F.lit(0)).alias("m"),
        F.sum(F.when(finite, F.col("c") * F.col("score"))).alias("s"),
        F.min(F.when(finite, F.col("score"))).alias("lo"),
        F.max(F.when(finite, F.col("score"))).alias("hi"),
        F.count(F.when(finite, F.lit(1))).alias("left"),
    )
    head = head.join(goal, "grp").withColumn("need", F.greatest(F.lit(1).cast("bigint"), F.expr("(n * permille + 999) div 1000")))
    head = head.withColumn("k", F.col("need") - F.col("n_top"))  # rank among the finite scores
    up, down = F.col("m") - F.col("k") + 0.5, F.col("k") - 0.5
    state = head.select(
        "grp", "n", "n_top", "need", "k", "m", "lo", "hi", "left", F.col("m").alias("inside"),
        F.when(F.col("need") > F.col("n"), F.lit("none")).when(F.col("k") <= 0, F.lit("top")).when(F.col("k") > F.col("m"), F.lit("bottom")).otherwise(F.lit("open")).alias("case"),
        F.lit(0).cast("bigint").alias("above"), F.lit(0.0).alias("above_s"), F.lit(0).cast("bigint").alias("below"), F.lit(0.0).alias("below_s"),
        F.col("lo").alias("t_l"), (up * (F.col("s") - F.col("m") * F.col("lo"))).alias("f_l"), (-up * F.col("m")).alias("g_l"),
        F.col("hi").alias("t_r"), (down * (F.col("m") * F.col("hi") - F.col("s"))).alias("f_r"), (down * F.col("m")).alias("g_r"),
        F.lit(0).alias("rounds"),
    )
    state = stage(state, "brackets")
    busy = (F.col("case") == "open") & (F.col("left") > 1)
    groups, wide = state.agg(F.count("*"), F.count_if(busy)).first()
    small = groups <= BROADCAST_ROWS  # one row per group, in every round
    for _ in range(max_rounds):
        if not wide:
            break
        after = stage(_step(values, state.where(busy), small).unionByName(state.where(~busy)), "brackets")
        unstage(state)
        state = after
        wide = state.where(busy).count()
    else:
        raise RuntimeError(f"brackets still open after {max_rounds} rounds")
    unstage(values)
    case, top, bottom = F.col("case"), float("inf"), -float("inf")
    cutoff = F.when(case == "open", F.col("lo")).when(case == "top", F.lit(top)).when(case == "bottom", F.lit(bottom))
    kept = F.when(case == "open", F.col("n_top") + F.col("above") + F.col("inside")).when(case == "top", F.col("n_top")).when(case == "bottom", F.col("n")).otherwise(F.lit(0).cast("bigint"))
    return state.select("grp", "n", "need", cutoff.alias("cutoff"), kept.alias("kept"), "rounds")


def _side(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def _points():
    """The points of a round in ascending order, all above ``lo`` and at most ``hi`` (which is one of them)."""
    lo, hi = F.col("lo"), F.col("hi")
    cut = F.try_divide(F.col("f_r") - F.col("f_l") + F.col("g_l") * F.col("t_l") - F.col("g_r") * F.col("t_r"), F.col("g_l") - F.col("g_r"))
    inside = lambda c: (c > lo) & (c <= hi)
    mid = lo / 2 + hi / 2
    cut = F.when(inside(cut), cut).when(inside(mid), mid).otherwise(hi)
    near = [cut * (1 - f) + end * f for f in CLOSER for end in (lo, hi)]
    return F.sort_array(F.array(*[F.when(inside(t), t).otherwise(hi) for t in (cut, mid, *near, hi)]))


def _step(values: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """One evaluation of loss and subgradient at all points of every group; returns the narrowed brackets."""
    asked = state.withColumn("_t", _points())
    points = [f"_t{i}" for i in range(POINTS)]
    at = _side(asked.select("grp", "lo", "hi", *[F.col("_t")[i].alias(p) for i, p in enumerate(points)]), small)
    rows = values.join(at, "grp").where((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")))
    place = sum((F.col("score") >= F.col(p)).cast("int") for p in points)
    seen = rows.groupBy("grp", place.alias("_j")).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("score")).alias("s"), F.min("score").alias("v_lo"), F.max("score").alias("v_hi"), F.count("*").alias("d"))
    # at most POINTS + 1 rows of a group: counts and sums at each point
    w = Window.partitionBy("grp")
    higher = w.orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    seen = seen.withColumns({"c_up": zero(F.sum("c").over(higher), 0), "s_up": zero(F.sum("s").over(higher), 0.0), "c_all": F.sum("c").over(w), "s_all": F.sum("s").over(w)})
    j = seen.join(_side(asked, small), "grp").where((F.col("above") + F.col("c_up") < F.col("k")) & (F.col("k") <= F.col("above") + F.col("c_up") + F.col("c")))
    up, down = F.col("m") - F.col("k") + 0.5, F.col("k") - 0.5
    above, above_s = F.col("above") + F.col("c_up"), F.col("above_s") + F.col("s_up")
    below, below_s = F.col("below") + F.col("c_all") - F.col("c_up") - F.col("c"), F.col("below_s") + F.col("s_all") - F.col("s_up") - F.col("s")

    def tangent(t, n_ge, s_ge, n_lt, s_lt):
        return up * (s_ge - t * n_ge) + down * (t * n_lt - s_lt), down * n_lt - up * n_ge

    first, last = F.col("_j") == 0, F.col("_j") == POINTS
    t_l, t_r = F.element_at("_t", F.greatest(F.col("_j"), F.lit(1))), F.element_at("_t", F.least(F.col("_j") + 1, F.lit(POINTS)))
    f_l, g_l = tangent(t_l, above + F.col("c"), above_s + F.col("s"), below, below_s)
    f_r, g_r = tangent(t_r, above, above_s, below + F.col("c"), below_s + F.col("s"))
    old = lambda edge, name, new: F.when(edge, F.col(name)).otherwise(new).alias(name)
    return j.select(
        "grp", "n", "n_top", "need", "k", "m", F.col("v_lo").alias("lo"), F.col("v_hi").alias("hi"), F.col("d").alias("left"), F.col("c").alias("inside"), "case",
        above.alias("above"), above_s.alias("above_s"), below.alias("below"), below_s.alias("below_s"),
        old(first, "t_l", t_l), old(first, "f_l", f_l), old(first, "g_l", g_l), old(last, "t_r", t_r), old(last, "f_r", f_r), old(last, "g_r", g_r),
        (F.col("rounds") + 1).alias("rounds"),
    )


def kept_items(items: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """The rows of ``items`` (``grp``, ``score``, further columns) at or above their group's cutoff."""
    cut = stage(keep_cutoffs(items.select("grp", "score"), targets, **how).select("grp", F.col("cutoff").alias("_cutoff")), "cutoffs")
    return items.where(~F.isnan("score")).join(broadcast_if_small(cut), "grp").where(F.col("score") >= F.col("_cutoff")).drop("_cutoff")
