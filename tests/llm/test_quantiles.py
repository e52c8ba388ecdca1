import math

import numpy as np
from pyspark.sql import functions as F

from framelake.llm.quantiles import BOUND, Compactors, merge_sketches, percentiles, sketch

SHARES = [0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999]


def off(values, share, got):
    """Relative rank error of a value for a share."""
    values = np.sort(values)
    n = len(values)
    rank = max(1, math.ceil(share * n - 1e-9))
    lo, hi = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
    return max(0, lo - rank, rank - hi) / min(rank, n - rank + 1)


def test_error_bound_and_weights():
    rng = np.random.default_rng(0)
    for data in (rng.lognormal(0, 3, 200_000), np.arange(200_000.0), np.round(rng.normal(size=200_000), 1)):
        s = Compactors(1)
        for part in np.array_split(data, 37):
            s.add(0, part)
            s.squeeze()
        assert sum(len(x) << h for h, x in enumerate(s.items)) == len(data)
        assert s.size() < 6000
        items = np.concatenate(s.items)
        weight = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(s.items)])
        order = np.argsort(items)
        reach = np.cumsum(weight[order])
        for share in (0.0001, 0.001, 0.01, 0.1, 0.5):
            got = items[order][np.searchsorted(reach, max(1, math.ceil(share * len(data))))]
            assert off(data, share, got) <= BOUND


def test_days_merge_within_bound(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.gamma(2, 10, n) for k, n in (("a", 60_000), ("b", 500), ("c", 1))}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", math.nan), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5).withColumns({"side": F.lit(1), "level": F.lit("x"), "items": F.lit(0)})
    days = [sketch(df.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i), ["k"], "v") for i in range(3)]
    merged = merge_sketches(days[0].unionByName(days[1]).unionByName(days[2]), ["k"])
    got = percentiles(merged, ["k"], SHARES).collect()
    assert {(r["k"], r["n"]) for r in got} == {("a", 60_000), ("b", 500), ("c", 1), (None, 1)}
    assert len(got) == 4 * len(SHARES)
    for r in got:
        if r["k"]:
            assert off(data[r["k"]], r["share"], r["value"]) <= BOUND
    small = {r["share"]: r["value"] for r in got if r["k"] == "b"}
    assert small == {s: np.sort(data["b"])[max(1, math.ceil(s * 500 - 1e-9)) - 1] for s in SHARES}  # exact while nothing is compacted


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert percentiles(sketch(df, ["k"], "v"), ["k"], SHARES).count() == 0


def test_tree_of_any_depth(spark, monkeypatch):
    from framelake.llm import quantiles

    monkeypatch.setattr(quantiles, "FAN_IN", 3)
    values = np.random.default_rng(5).lognormal(0, 2, 40_000)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double").repartition(20)
    got = percentiles(sketch(df, ["k"], "v"), ["k"], SHARES).collect()
    assert {r["n"] for r in got} == {40_000} and all(off(values, r["share"], r["value"]) <= BOUND for r in got)
