import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from framelake.functions.identifiers import hex64
from framelake.llm.hamming_pairs import BITS, LEVELS, Layout, allowed, close_groups, close_hashes, close_records, posterior, pruning, signed


def hashes(seed=1, n=60):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n)]
    out = list(base)
    for b in base:
        for _ in range(3):
            x = b
            for p in rnd.sample(range(64), rnd.randint(1, 9)):
                x ^= 1 << p
            out.append(x)
    return out


def brute(rows, most):
    return {(a, b) for (a, x), (b, y) in combinations(sorted(rows), 2) if a != b and bin(x ^ y).count("1") <= most}


def frame(spark, rows):
    return spark.createDataFrame([(i, signed(x) if x is not None else None) for i, x in rows], "id bigint, h bigint")


@pytest.mark.parametrize("most", [0, 3, 6, 8])
def test_pairs_equal_brute_force(spark, most):
    rows = list(enumerate(hashes()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (3, rows[3][1])]  # copies and a repeated row
    got = {tuple(r) for r in close_records(frame(spark, rows), most).collect()}
    assert got == brute(rows, most)


def test_hot_band_is_split_and_stays_exact(spark):
    rnd = random.Random(5)
    fixed = rnd.getrandbits(64)
    rows = []
    for i in range(300):  # all agree on 40 bits, so every band is hot
        x = fixed
        for p in rnd.sample(range(24), rnd.randint(0, 12)):
            x ^= 1 << p
        rows.append((i, x))
    got = {tuple(r) for r in close_records(frame(spark, rows), 6, band_limit=20).collect()}
    assert got == brute(rows, 6)


def test_nulls_empty_and_clashing_columns(spark):
    rows = frame(spark, [(1, 5), (2, None), (None, 5), (4, 7)]).withColumns({"band": F.lit(1), "bits": F.lit("x"), "count": F.lit(0)})
    assert [tuple(r) for r in close_records(rows, 6).collect()] == [(1, 4)]
    assert close_records(frame(spark, []), 6).count() == 0
    assert close_groups(frame(spark, []), 6).count() == 0


def test_an_id_with_several_hashes_is_close_by_any(spark):
    rows = [(1, 0b1), (1, 0xFFFFFFFF), (2, 0xFFFFFFFE), (3, 0b11)]
    got = [tuple(r) for r in close_records(frame(spark, rows), 2).collect()]
    assert sorted(got) == [(1, 2), (1, 3)]
    assert {tuple(r) for r in close_groups(frame(spark, rows), 2).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}


def test_groups_are_components(spark):
    rows = list(enumerate(hashes(2)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 6):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), []).append(i)
    want = {(i, min(g), len(g)) for g in want.values() if len(g) > 1 for i in g}
    assert {tuple(r) for r in close_groups(frame(spark, rows), 6).collect()} == want


def test_posterior():
    assert posterior(64, 6, 6) == 1 and posterior(16, 7, 6) == 0
    assert 0 < posterior(16, 6, 6) < posterior(16, 2, 6) < 1
    assert allowed(24, 6, 0.2) == 3 and allowed(64, 6, 0.2) == 6 and allowed(24, 6, 0) == 6


@pytest.mark.parametrize("most", [1, 3, 6, 8])
def test_the_default_tolerance_prunes_and_loses_nothing(most):
    layout = Layout(most, 11)
    assert layout.tolerance >= 0.05 and not len(layout.lost(layout.tolerance))
    assert most < 3 or min(layout.most_after[0]) < most
    rnd = random.Random(most)
    drawn = [[sum(layout.masks[t] for t in draw[: k + 1]) for k in range(len(draw))] for draw in layout.draws]
    ones = lambda x: (x % (1 << BITS)).bit_count()
    for _ in range(3000):
        x = sum(1 << p for p in rnd.sample(range(BITS), most))
        kept = [all(ones(x & m) <= k for m, k in zip(masks, limit)) for masks, limit, band in zip(drawn, layout.most_after, layout.bands) if not x & (layout.masks[band[0]] | layout.masks[band[1]]) % (1 << BITS)]
        assert any(kept)


def test_a_larger_tolerance_loses_what_is_counted(spark):
    layout = Layout(6, 11, 0.9)
    assert len(layout.lost(0.9)) > 0
    rows = list(enumerate(hashes(3, 120)))
    every = {tuple(r) for r in close_hashes(frame(spark, rows), 6, tolerance=0).collect()}
    assert every == {tuple(r) for r in close_hashes(frame(spark, rows), 6).collect()}
    some = {tuple(r) for r in close_hashes(frame(spark, rows), 6, tolerance=0.9).collect()}
    assert some < every


def test_pruning_report(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.getrandbits(12)) for i in range(3000)]  # many meet in a band
    steps = sorted(map(tuple, pruning(frame(spark, rows), 6).collect()))
    assert len(steps) == 6 and all(k <= c for _, c, k in steps) and [c for _, c, _ in steps[1:]] == [k for _, _, k in steps[:-1]]
    exact = sorted(map(tuple, pruning(frame(spark, rows), 6, tolerance=0).collect()))
    assert exact[0][1] == steps[0][1] and exact[0][2] > steps[0][2]


def test_hot_groups_are_split_again(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(200):  # all agree on 52 bits
        x = 0
        for p in rnd.sample(range(12), rnd.randint(0, 8)):
            x ^= 1 << (5 * p)
        rows.append((i, x))
    assert LEVELS > 1
    got = {tuple(r) for r in close_records(frame(spark, rows), 3, band_limit=4).collect()}
    assert got == brute(rows, 3)


def test_hex64(spark):
    texts = ["0x1A", "1a", " 00:1A\n", "0-0-1a", "", None, "0", "nan", "ffffffffffffffff", "1ffffffffffffffff", " 1a", "0x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(hex64(F.col("s"))).collect()]
    assert got == [26, 26, 26, 26, None, None, None, None, -1, None, 26, None]
