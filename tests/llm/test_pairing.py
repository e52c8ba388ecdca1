from itertools import combinations

import pytest

from framelake.llm.pairing import pairs_within


@pytest.mark.parametrize("chunk", [1, 7, 512])
def test_every_pair_once(spark, chunk):
    groups = {1: range(40), 2: [100], 3: [200, 201], 4: range(300, 314)}
    rows = [(g, i, len(ids)) for g, ids in groups.items() for i in ids]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "g int, id bigint, n bigint"), "g", chunk).collect()]
    assert sorted(got) == sorted(p for ids in groups.values() for p in combinations(ids, 2))
    assert pairs_within(spark.createDataFrame([], "g int, id bigint, n bigint"), "g").count() == 0
