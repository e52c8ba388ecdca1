import random

from framelake.llm.components import connected_components


def test_components_equal_union_find(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(300)]
    edges += [(7, 7), (None, 3), (4, None)] + edges[:10]
    low = {}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    for a, b in real:
        low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in real:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == set(low.items())
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
