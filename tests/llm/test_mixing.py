import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.llm.mixing import mix, schedule_segments

DOCS, TARGETS = "id bigint, source string, tokens bigint", "mix string, source string, share double, repeats int"


def data(seed=1, n=1500):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["big"] * 8 + ["mid"] * 3 + ["tiny"]), rnd.randint(1, 300)) for i in range(n)]


def run(spark, docs, targets, **how):
    d = spark.createDataFrame(docs, DOCS).withColumns({"mix": F.lit("x"), "t": F.lit(0), "copy": F.lit(1), "n": F.lit(2), "mid": F.lit(3)})
    order, shares = mix(d, spark.createDataFrame(targets, TARGETS).withColumn("tokens", F.lit(1)), **how)
    return order.orderBy("mix", "position").collect(), {(r["mix"], r["source"]): r for r in shares.collect()}


def test_shares_repeats_and_positions(spark):
    docs = data() + [(9000, "mid", None), (9001, "mid", 0), (9002, None, 5), (None, "mid", 5)]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 3), ("e", "mid", 0.5, 1), ("e", "absent", 0.5, 4)]
    order, shares = run(spark, docs, targets)
    have = defaultdict(int)
    for i, s, n in docs:
        if i is not None and s and n:
            have[s] += n
    used, copies = defaultdict(int), defaultdict(list)
    for m in "me":
        assert [r["position"] for r in order if r["mix"] == m] == list(range(sum(r["mix"] == m for r in order)))
    for r in order:
        used[r["mix"], r["source"]] += r["tokens"]
        copies[r["mix"], r["source"], r["id"]].append(r["copy"])
    limit = {(m, s): k for m, s, _, k in targets}
    for (m, s, _), c in copies.items():
        assert sorted(c) == list(range(len(c))) and len(c) <= limit[m, s]
    for m, s, share, k in targets:
        total = sum(have[x] for y, x, _, _ in targets if y == m)
        want = min(share * total, k * have[s])
        assert abs(used[m, s] - want) <= 150.5  # half a document
        r = shares[m, s]
        assert (r["used_tokens"], r["available_tokens"], r["target_share"]) == (used[m, s], have[s], share)
        assert r["reached_share"] == pytest.approx(used[m, s] / sum(v for (y, _), v in used.items() if y == m))
        assert r["short"] == (k * have[s] < share * total)
    assert shares["e", "absent"]["used_tokens"] == 0 and shares["e", "absent"]["short"]


def test_all_documents_once_before_any_repeat(spark):
    order, _ = run(spark, data(2, 400), [("m", "big", 0.2, 5), ("m", "mid", 0.8, 5)])
    n = len({r["id"] for r in order if r["source"] == "mid"})
    first = [r["copy"] for r in order if r["source"] == "mid"]
    assert first == sorted(first) and first.count(0) == n


def test_curriculum_is_followed(spark):
    docs = [(i, "a" if i % 2 else "b", 10) for i in range(4000)]
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]
    order, _ = run(spark, docs, targets, schedules={"a": [(0, 0.0), (1, 2.0)], "b": [(0, 2.0), (1, 0.0)]})
    a = [r["source"] == "a" for r in order]
    for i in range(4):  # of a quarter of the time the share of a is the mean of its ramp there
        part = a[i * 1000 : (i + 1) * 1000]
        assert sum(part) / 1000 == pytest.approx((2 * i + 1) / 8, abs=0.01)


def test_segments_and_empty(spark):
    segs = schedule_segments([(0, 1.0), (0.5, 3.0), (1, 1.0)])
    assert segs[1][3] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        schedule_segments([(0, 1.0), (0.5, 1.0)])
    order, shares = run(spark, [], [("m", "a", 1.0, 1)])
    assert order == [] and shares["m", "a"]["used_tokens"] == 0
    assert run(spark, data(1, 10), [])[0] == []


def test_targets_hold_at_the_largest_size(spark):
    docs = data(5, 3000)
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.2, 2), ("m", "tiny", 0.3, 3), ("e", "mid", 0.5, 1), ("e", "absent", 0.5, 4)]
    _, shares = run(spark, docs, targets, size="targets")
    used = sum(shares["m", s]["used_tokens"] for s in ("big", "mid", "tiny"))
    for s, goal in (("big", 0.5), ("mid", 0.2), ("tiny", 0.3)):
        assert shares["m", s]["reached_share"] == pytest.approx(goal, abs=0.01) and not shares["m", s]["short"]
    assert used == pytest.approx(min(k * shares["m", s]["available_tokens"] / g for _, s, g, k in targets[:3]), rel=0.01)
    assert shares["e", "mid"]["used_tokens"] == pytest.approx(shares["e", "mid"]["available_tokens"] / 2, rel=0.01) and shares["e", "absent"]["short"]
    with pytest.raises(ValueError):
        run(spark, docs, targets, size="none")
