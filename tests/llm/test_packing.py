import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.llm.packing import best_fit, fills, pack


def best_fit_decreasing(sizes, capacity):
    """Containers that item-by-item best fit opens."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        if s:
            i = bisect_left(gaps, s)
            gap = gaps.pop(i) if i < len(gaps) else capacity
            opened += gap == capacity
            if gap > s:
                insort(gaps, gap - s)
    return opened


def test_best_fit_with_and_without_budget():
    rnd = random.Random(1)
    for capacity in (1, 7, 100, 512):
        for _ in range(20):
            sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 400))), reverse=True)
            where, free = best_fit(sizes, [], capacity, None)
            used = Counter()
            for w, s in zip(where, sizes):
                used[w] += s
            assert -1 not in used and all(used[i] + f == capacity for i, f in enumerate(free))
            assert len(free) == best_fit_decreasing(sizes, capacity)
            gaps = [rnd.randint(0, capacity) for _ in range(20)]
            where, free = best_fit(sizes, gaps, capacity, 2)
            assert len(free) - 20 <= max(2, sum(2 * s > capacity for s in sizes))
            assert sum(gaps) + capacity * (len(free) - 20) - sum(free) == sum(s for w, s in zip(where, sizes) if w >= 0)
            assert all(s <= capacity // 2 for w, s in zip(where, sizes) if w < 0)
    assert best_fit([5, 4], [4, 9, 5], 10, 0) == ([2, 0], [0, 9, 0])


def check(rows, packed, kinds, slack=0.0):
    size = defaultdict(list)
    for r in packed:
        assert 0 <= r["tokens"] <= kinds[r["kind"]]
        size[r["kind"], r["id"]].append((r["piece"], r["tokens"]))
    for kind, cap in kinds.items():
        want = Counter((i, max(0, n or 0)) for i, n in rows)
        for (i, n), times in want.items():
            got = sorted(size[kind, i])
            if times == 1 and sum(c == i for c, _ in want) == 1:
                assert [p for p, _ in got] == list(range(len(got))) and sum(t for _, t in got) == n
                assert len(got) == max(1, -(-n // cap))  # only what is too large is split
        fill = Counter()
        for r in packed:
            if r["kind"] == kind:
                fill[r["container"]] += r["tokens"]
        assert max(fill.values(), default=0) <= cap
        pieces = [r["tokens"] for r in packed if r["kind"] == kind]
        assert len([c for c in fill.values() if c]) <= best_fit_decreasing(pieces, cap) * (1 + slack)


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 3, 3, 3, rnd.randint(1, 60), rnd.randint(50, 900)])) for i in range(800)]
    rows += [(900, None), (901, -4), (902, 100_000), (5, 44), (None, 9)] + [(10_000 + i, 17) for i in range(600)]
    kinds = {"s": 64, "m": 512}
    df = spark.createDataFrame(rows, "id bigint, tokens bigint").withColumns({"k": F.lit("x"), "cap": F.lit(1), "size": F.lit(2), "piece": F.lit(3)})
    kdf = spark.createDataFrame([*kinds.items(), ("bad", 0), ("none", None)], "kind string, capacity int")
    packed = pack(df, kdf)
    out = packed.collect()
    check([r for r in rows if r[0] is not None], [r for r in out if r["id"] is not None or True], kinds)
    f = fills(packed, kdf).collect()
    assert all(r["used"] + r["free"] == kinds[r["kind"]] and r["free"] >= 0 for r in f)
    assert sum(r["items"] for r in f) == len(out)


@pytest.mark.parametrize("sizes", ["mixed", "equal", "hot"])
def test_many_sweeps(spark, sizes):
    rnd = random.Random(3)
    draw = {"mixed": lambda: rnd.choice([rnd.randint(1, 60), rnd.randint(50, 700)]), "equal": lambda: 200, "hot": lambda: 7 if rnd.random() < 0.4 else rnd.randint(1, 300)}[sizes]
    rows = [(i, draw()) for i in range(3000)]
    kinds = {"m": 512, "l": 4096}
    packed = pack(spark.createDataFrame(rows, "id bigint, tokens bigint"), spark.createDataFrame([*kinds.items()], "kind string, capacity int"), sweep=128)
    check(rows, packed.collect(), kinds, slack=0.03)


def test_kinds(spark):
    items = spark.createDataFrame([("a", 5), ("b", 12)], "id string, tokens int")
    with pytest.raises(ValueError):
        pack(items, spark.createDataFrame([("s", 4), ("s", 5)], "kind string, capacity int"))
    with pytest.raises(ValueError):
        pack(items, spark.range(1001).selectExpr("id as kind", "id + 1 as capacity"))
    got = sorted(map(tuple, pack(items, spark.createDataFrame([(3, 10)], "kind int, capacity int")).collect()))
    assert got == [(3, 0, "b", 0, 10), (3, 1, "a", 0, 5), (3, 1, "b", 1, 2)]


def test_empty(spark):
    items = spark.createDataFrame([], "id bigint, tokens bigint")
    kinds = spark.createDataFrame([("s", 64)], "kind string, capacity int")
    assert pack(items, kinds).count() == 0
    assert pack(spark.createDataFrame([(1, 2)], "id bigint, tokens bigint"), kinds.limit(0)).count() == 0
