import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.llm.topn import top_n


def brute(rows, n, least):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    out = set()
    for g, d in best.items():
        if len(d) >= least:
            out |= {(g, i, s, r + 1) for r, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n])}
    return out


@pytest.mark.parametrize("bands", [1, 3, 6])
@pytest.mark.parametrize("least", [1, 5])
def test_equal_to_sorting(spark, bands, least):
    rnd = random.Random(bands)
    rows = [(g, g * 100 + i, round(rnd.gauss(0, 2))) for g in range(40) for i in range(rnd.randint(1, 12))]
    rows += [(99, 10_000 + i, round(rnd.gauss(0, 1), 1)) for i in range(3000)]  # a third of all rows and more
    rows += rows[:20] + [(None, 1, 1.0), (1, None, 9.0), (2, 7, None), (2, 8, math.nan)]
    rows = [(g, i, float(s) if s is not None else None) for g, i, s in rows]
    df = spark.createDataFrame(rows, "grp bigint, id bigint, score double").withColumns({"rank": F.lit(0), "count": F.lit("x"), "_r": F.lit(1)})
    assert {tuple(r) for r in top_n(df, 3, least, bands).collect()} == brute(rows, 3, least)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "grp bigint, id bigint, score double"), 3).count() == 0
