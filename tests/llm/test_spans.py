import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from framelake.llm.spans import shared_characters, shared_stretches, sharers, sharing_clusters, sharing_pairs


def brute(rows, span):
    at = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for k in range(len(t) - span + 1):
                at[t[k : k + span]].add(i)
    pairs = {p for ids in at.values() for p in combinations(sorted(ids), 2)}
    shared = {}
    for i, t in rows:
        if i is not None:
            mark = [0] * len(t or "")
            for k in range(len(mark) - span + 1):
                if len(at[t[k : k + span]]) > 1:
                    mark[k : k + span] = [1] * span
            shared[i] = (len(mark), sum(mark))
    return pairs, shared


def texts(seed=1):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdé \n😀") for _ in range(n))
    rows, pool = [], [word(k) for k in (19, 20, 21, 30, 80, 200)]
    for i in range(120):
        rows.append((i, "".join(rnd.choice([word(rnd.randint(0, 40)), rnd.choice(pool), rnd.choice(pool)[: rnd.randint(10, 60)]]) for _ in range(rnd.randint(0, 5)))))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "a" * 100), (203, "a" * 64), (204, "ab" * 50), (205, None), (206, ""), (None, pool[5]), (207, "x" * 30_000 + pool[5] + "y" * 30_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string").withColumns({"h": F.lit(1), "at": F.lit("x"), "n": F.lit(0), "spots": F.lit(2)})


def test_pairs_and_coverage_equal_brute_force(spark):
    rows = texts()
    pairs, shared = brute(rows, 20)
    df = frame(spark, rows)
    found = shared_stretches(df, 20)
    assert {tuple(r) for r in sharing_pairs(sharers(df, 20)).collect()} == pairs
    got = {r["id"]: (r["chars"], r["shared_chars"]) for r in shared_characters(df, found).collect()}
    assert got == shared


def test_any_shingle_gives_the_same(spark):
    rows = texts(7)[:60]
    pairs, _ = brute(rows, 25)
    for shingle in (1, 5, 24, 25):
        assert {tuple(r) for r in sharing_pairs(sharers(frame(spark, rows), 25, shingle)).collect()} == pairs


def test_clusters_are_components(spark):
    rows = texts(3)
    pairs, _ = brute(rows, 20)
    low = {i: i for i, _ in rows if i is not None}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    members = {i for p in pairs for i in p}
    got = {(r["id"], r["cluster_id"]) for r in sharing_clusters(sharers(frame(spark, rows), 20)).collect()}
    assert got == {(i, low[i]) for i in members}


def test_an_id_with_several_texts(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    p = word(40)
    rows = [(1, word(30) + p + word(9)), (1, word(50) + p), (2, p + word(30)), (3, word(60)), (3, "x" + word(60) + p[:30])]
    got = {tuple(r) for r in sharing_pairs(sharers(frame(spark, rows), 24)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_hot_passage_and_empty(spark):
    rows = [(i, f"{i:05d}" * 8 + "the same forty characters in every text!" + f"{i:05d}"[::-1] * 8) for i in range(150)]
    assert sharing_pairs(sharers(frame(spark, rows), 40)).count() == 150 * 149 // 2
    assert sharing_pairs(sharers(frame(spark, []), 40)).count() == 0
    assert sharing_clusters(sharers(frame(spark, []), 40)).count() == 0
