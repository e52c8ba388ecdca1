import math

from pyspark.sql import functions as F

from framelake.operators import scoring as sc
from framelake.operators import windows as wn


def groups(rows, key="burst"):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r["id"])
    return out


def test_gap_boundary_stays_together(spark):
    df = spark.createDataFrame([(1, "u", 0), (2, "u", 3), (3, "u", 7)], "id int, k string, t bigint")
    assert sorted(map(sorted, groups(wn.bursts(df, ["k"], "t", "id", 3).collect()).values())) == [[1, 2], [3]]


def test_drift_is_allowed_and_a_jump_is_not(spark):
    a, b, c = 0, (1 << 15) - 1, (1 << 30) - 1  # neighbours differ in 15 bits, the ends in 30
    df = spark.createDataFrame([(1, "u", 0, a), (2, "u", 1, b), (3, "u", 2, c), (4, "u", 3, a), (5, "u", 4, None)], "id int, k string, t bigint, h bigint")
    got = sorted(map(sorted, groups(wn.bursts(df, ["k"], "t", "id", 3, bits="h").collect()).values()))
    assert got == [[1, 2, 3], [4, 5]]


def test_null_time_has_no_burst(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", 5), (3, None, 5)], "id int, k string, t bigint")
    got = {r["id"]: r["burst"] for r in wn.bursts(df, ["k"], "t", "id", 3).collect()}
    assert got == {1: None, 2: 1, 3: 1}
    assert wn.bursts(df.limit(0), ["k"], "t", "id", 3).count() == 0


def test_bursts_equal_brute_force(spark):
    rows = [(i, "hot" if i % 3 else "ab"[i % 2], (i * 7919) % 900, (i * 2654435761) % 2**40) for i in range(2000)] + [(9000, None, 5, 1), (9001, "hot", None, 1), (9002, None, 6, None)]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, h bigint").repartition(6)
    for bits in (None, "h"):
        a = {(r["id"], r["burst"]) for r in wn.bursts(df, ["k"], "t", "id", 0, bits=bits, most_bits=18).collect()}
        want, last = {(9001, None)}, {}
        for i, k, t, h in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
            no, before = last.get(k, (0, None))
            if before is None or t - before[0] > 0 or (bits and h is not None and before[1] is not None and bin(h ^ before[1]).count("1") > 18):
                no += 1
            last[k] = no, (t, h)
            want.add((i, no))
        assert a == want


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 7)], "id int, k int")
    assert {r["id"]: r["group_size"] for r in wn.group_size(df, ["k"]).collect()} == {1: 2, 2: 2, 3: 1}


def test_scaled_rank(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 4.0)], "day string, id int, s double")
    got = {(r["day"], r["id"]): r["scaled_rank"] for r in wn.scaled_rank(df, ["day"], [F.col("s"), F.col("id")]).collect()}
    assert got == {("a", 1): 0, ("b", 1): -0.5, ("b", 2): 0, ("b", 3): 0.5}


def test_constant_scores_have_zero_z(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, s double")
    assert [r["s_z"] for r in sc.zscores(df, ["s"]).collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, math.nan)], "id int, s double")
    assert [r["s_z"] for r in sc.zscores(odd, ["s"]).orderBy("id").collect()] == [-1.0, 1.0, 0.0, 0.0]


def test_tier_cut(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, s double")
    t = [r["tier"] for r in wn.tiers(df, [F.desc("s"), F.col("id")], [("hero", 0.015, 1), ("select", 0.1, 0)], "keep").collect()]
    assert (t.count("hero"), t.count("select"), t.count("keep")) == (1, 0, 9)


def sizes(df, name):
    return sorted((r["n"] for r in df.groupBy(name).agg(F.count("*").alias("n")).collect()), reverse=True)


def test_chunks_and_hands(spark):
    rows = lambda n: spark.createDataFrame([(i,) for i in range(n)], "id int")
    assert sizes(wn.balanced_chunks(rows(91), [F.col("id")], 45), "chunk") == [31, 31, 29]
    assert sizes(wn.deal(rows(73), [F.col("id")], 36), "hand") == [25, 24, 24]
    assert sizes(wn.batches(rows(20), [F.col("id")], 9), "batch") == [9, 9, 2]
    assert wn.deal(rows(0), [F.col("id")], 36).count() == 0
    assert [r["rank"] for r in wn.ranked(rows(50).repartition(7), [F.desc("id")]).orderBy(F.desc("id")).collect()] == list(range(1, 51))


def test_sections_ring_quota_and_first(spark):
    df = spark.createDataFrame([(1, "g", "x"), (2, "g", "x"), (3, "g", None), (4, "g", None)], "id int, k string, l string")
    assert [r["starts"] for r in wn.section_starts(df, ["k"], [F.col("id")], "l").orderBy("id").collect()] == [True, False, True, False]
    assert [(r["before"], r["after"]) for r in wn.neighbours(df, ["k"], [F.col("id")], "id").orderBy("id").collect()] == [(4, 2), (1, 3), (2, 4), (3, 1)]
    q = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1)], "k string, id int")
    assert wn.quota(q, ["k"], [F.col("id")], 3, 0.05, 8).count() == 5
    f = spark.createDataFrame([("p", 2, 0), ("p", 1, 5), ("q", 3, 0)], "key string, theme int, pos int")
    assert {tuple(r) for r in wn.first_occurrence(f, "key", [F.col("theme"), F.col("pos")]).collect()} == {("p", 1, 5), ("q", 3, 0)}


def test_raise_to(spark):
    df = spark.createDataFrame([(1, "keep", 4), (2, "hero", 0), (3, "keep", 0)], "id int, tier string, stars int")
    got = {r["id"]: r["tier"] for r in wn.raise_to(df, "tier", ["hero", "select", "keep"], [(F.col("stars") >= 4, "select")]).collect()}
    assert got == {1: "select", 2: "hero", 3: "keep"}


def test_auc_with_ties_and_ladder(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", 0.0, False), ("b", 1.0, True)], "k string, s double, y boolean")
    assert [(r["k"], r["auc"]) for r in sc.auc(df, "s", "y", ["k"]).collect()] == [("a", 0.75)]
    v = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    assert {r["percent"]: r["v"] for r in sc.percentile_ladder(v, "v", [1, 50, 99, 100]).collect()} == {1: 0.0, 50: 5.0, 99: 9.0, 100: 9.0}


def test_positions_and_percentiles_of_hot_and_null_groups(spark):
    from framelake.operators import scoring
    from framelake.physical import group_position

    rows = [(i, "hot" if i % 3 else None, (i * 37) % 101 / 4) for i in range(900)] + [(1000, "one", 5.0), (1001, "one", None)]
    df = spark.createDataFrame(rows, "id bigint, k string, x double").repartition(7)
    got = {r["id"]: r["_pos"] for r in group_position(df, ["k"], [F.col("x"), F.col("id")], "t").collect()}
    for k in ("hot", None, "one"):
        ids = [i for i, _, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]
        assert [got[i] for i in ids] == list(range(len(ids)))
    ring = {r["id"]: (r["before"], r["after"]) for r in wn.neighbours(df.where("k = 'hot'"), ["k"], [F.col("id")], "id").collect()}
    ids = sorted(ring)
    assert all(ring[i] == (ids[n - 1], ids[(n + 1) % len(ids)]) for n, i in enumerate(ids))
    p = {(r["k"], r["share"]): r["x"] for r in scoring.linear_percentiles(df, "x", [0.0, 0.1, 0.5, 1.0], ["k"]).collect()}
    import numpy as np

    for k in ("hot", None, "one"):
        xs = [x for _, g, x in rows if g == k and x is not None]
        for s in (0.0, 0.1, 0.5, 1.0):
            assert abs(p[k, s] - float(np.percentile(xs, 100 * s))) < 1e-9
    assert scoring.linear_percentiles(df.limit(0), "x", [0.5]).count() == 0
