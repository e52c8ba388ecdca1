import math
import random

from pyspark.sql import functions as F

from framelake.llm.cutoffs import keep_cutoffs, kept_items


def brute(rows, goals):
    out = {}
    for g, p in goals.items():
        xs = sorted((s for k, s in rows if k == g and s is not None and not math.isnan(s)), reverse=True)
        if xs:
            need = max(1, -(-len(xs) * p // 1000))
            cut = xs[need - 1] if need <= len(xs) else None
            out[g] = (len(xs), need, cut, sum(x >= cut for x in xs) if cut is not None else 0)
    return out


def run(spark, rows, goals, **how):
    df = spark.createDataFrame(rows, "grp bigint, score double").withColumns({"t": F.lit(1), "lo": F.lit(2), "n": F.lit(3), "c": F.lit("x")})
    t = spark.createDataFrame(list(goals.items()), "grp bigint, permille int").withColumn("score", F.lit(1))
    return {r["grp"]: (r["n"], r["need"], r["cutoff"], r["kept"]) for r in keep_cutoffs(df, t, **how).collect()}


def test_equal_to_sorting(spark):
    rnd = random.Random(4)
    rows = [(1, rnd.gauss(0, 1)) for _ in range(400)] + [(2, round(rnd.gauss(0, 1), 1)) for _ in range(400)] + [(3, rnd.lognormvariate(0, 40)) for _ in range(300)]
    rows += [(4, 7.0)] * 50 + [(5, None), (5, math.nan), (6, -1.0), (None, 3.0)]
    goals = {1: 333, 2: 50, 3: 500, 4: 10, 5: 100, 6: 1, 9: 100}
    assert run(spark, rows, goals) == brute(rows, goals)


def test_infinite_scores_zero_and_over_target(spark):
    inf = math.inf
    rows = [(1, inf), (1, 1.0), (1, 2.0), (1, -inf), (2, 1.0), (2, 2.0), (3, 1.0)]
    for p in (0, 250, 500, 750, 1000, 1001):
        goals = {1: p, 2: p, 3: p}
        assert run(spark, rows, goals) == brute(rows, goals)


def test_hot_group_extremes_and_empty(spark):
    rows = [(1, float(i % 997)) for i in range(20_000)] + [(2, 1e308), (2, -1e308), (2, 1e-300)]
    goals = {1: 123, 2: 400}
    assert run(spark, rows, goals) == brute(rows, goals)
    assert run(spark, [], goals) == {} and run(spark, rows, {}) == {}


def test_few_rounds_of_real_cuts(spark):
    rnd = random.Random(7)
    rows = [(1, rnd.lognormvariate(0, 3)) for _ in range(5000)] + [(2, 1.0), (2, 2.0)]
    df, goals = spark.createDataFrame(rows, "grp bigint, score double"), spark.createDataFrame([(1, 77), (2, 500)], "grp bigint, permille int")
    rounds = {r["grp"]: r["rounds"] for r in keep_cutoffs(df, goals).collect()}
    assert 1 < rounds[1] <= 8 and rounds[2] == 1


def test_kept_items_keep_ties(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, 5.0, "b"), (1, 1.0, "c"), (1, None, "d")], "grp bigint, score double, name string").withColumns({"cutoff": F.lit(1), "permille": F.lit(2)})
    t = spark.createDataFrame([(1, 100)], "grp bigint, permille int")
    assert {r["name"] for r in kept_items(df, t).collect()} == {"a", "b"}
