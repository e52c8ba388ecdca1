import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.identifiers import squeezed, whole_number
from framelake.functions.times import local_seconds, local_text
from framelake.operators.geo import EARTH_M, points_in_polygons, within_circles
from framelake.operators.sessions import SECONDS, closed_runs, sessions


def brute_sessions(rows, gap):
    out, by = set(), {}
    for e, t, i in rows:
        if e is not None and t is not None:
            by.setdefault(e, {}).setdefault(t, set()).add(i)
    for e, ts in by.items():
        run = []
        for t in sorted(ts):
            if run and t - run[-1] > gap:
                out.add((e, run[0], run[-1], run[-1] - run[0], sum(len(ts[x] - {None}) for x in run)))
                run = []
            run.append(t)
        out.add((e, run[0], run[-1], run[-1] - run[0], sum(len(ts[x] - {None}) for x in run)))
    return out


@pytest.mark.parametrize("gap", [1, 60, 1800, 40_000, 5_000_000])
def test_sessions_equal_brute_force(spark, gap):
    rnd = random.Random(gap)
    rows, t = [], -3_000_000
    for i in range(1500):  # one entity holds most rows
        t += rnd.choice([0, 1, 2, gap, gap + 1, rnd.randint(0, 3 * gap + 3)])
        rows.append(("hot", t, i))
    rows += [(e, rnd.randint(-(10**9), 10**9), i) for i, e in enumerate("abcab" * 8)]
    rows += [("edge", SECONDS - 1, 1), ("edge", SECONDS, 2), ("edge", SECONDS + gap, 3), ("edge", SECONDS + 2 * gap + 1, 4)]
    rows += rows[:30] + [(None, 5, 1), ("a", None, 1), ("z", 7, None)]
    df = spark.createDataFrame(rows, "entity string, t bigint, id bigint").withColumns({"bucket": F.lit("x"), "start": F.lit(0), "bits": F.lit(1)})
    assert {tuple(r) for r in sessions(df, gap).collect()} == brute_sessions(rows, gap)


def test_sessions_edges(spark):
    assert sessions(spark.createDataFrame([], "entity string, t bigint, id bigint"), 5).count() == 0
    with pytest.raises(ValueError):
        sessions(spark.createDataFrame([], "entity string, t bigint, id bigint"), 0)


def test_one_session_across_chunks(spark):
    df = spark.range(0, 40_000).select(F.lit("e").alias("entity"), (F.col("id") * 1700).alias("t"), "id")
    assert [tuple(r) for r in sessions(df, 1800).collect()] == [("e", 0, 39_999 * 1700, 39_999 * 1700, 40_000)]


def test_closing():
    bits = np.zeros((2, SECONDS // 64), dtype=np.uint64)
    for p in (0, 3, 10, 63, 64, SECONDS - 1):
        bits[1, p // 64] |= np.uint64(1) << np.uint64(p % 64)
    row, a, b = closed_runs(bits, 3)
    assert [*zip(row, a, b)] == [(1, 0, 3), (1, 10, 10), (1, 63, 64), (1, SECONDS - 1, SECONDS - 1)]


def test_times(spark):
    good = {"2004-07-31T03:00:02": 1091242802, "2004:07:31 03:00:02.5+09:30": 1091242802, "1969-12-31 23:59:59": -1, "0001-01-01T00:00:00": -62135596800, "2000-02-29T00:00:00Z": 951782400}
    bad = [None, "", "unknown", "2004-08", "0000-00-00T00:00:00", "2001-02-29T00:00:00", "2004-07-31T24:00:00", "2004-07-31T23:60:00", "2004-07-31T23:59:60", "2004/07/31T03:00:02", " 2004-07-31T03:00:0"]
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string").select(local_seconds(F.col("s")).alias("t"))
    assert [r["t"] for r in df.collect()] == [*good.values(), *[None] * len(bad)]
    assert [r[0] for r in df.limit(4).select(local_text(F.col("t"))).collect()] == ["2004-07-31T03:00:02"] * 2 + ["1969-12-31T23:59:59", "0001-01-01T00:00:00"]


def test_identifiers(spark):
    y = ["2019", " 2019", "2019 ", "\t2019.0", "02019", "2019.5", "", None, "0000", "x"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in y], "s string").select(whole_number(F.col("s"))).collect()] == [2019, 2019, 2019, 2019, 2019, None, None, None, 0, None]
    c = [" Nor \t VELIK ", "", " ", None]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in c], "s string").select(squeezed(F.col("s"))).collect()] == ["nor velik", None, None, None]


def distance(a, b):
    (p, q), (r, s) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_circles_equal_brute_force(spark):
    rnd = random.Random(8)
    places = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180), 10 ** rnd.uniform(1, 7.2)) for i in range(60)]
    places += [(100, 90.0, 0.0, 3e5), (101, -90.0, 50.0, 1e6), (102, 89.9, 10.0, 2e4), (103, 0.0, 180.0, 5e5), (104, 10.0, -180.0, 5e5), (105, 0.0, 0.0, 3e7), (106, 5.0, 5.0, 0.0), (107, 45.0, 179.99, 2e3), (108, 60.0, 100.0, 9.9e6)]
    points = []
    for i in range(400):
        p = rnd.choice(places)
        r = p[3] / 111_000 * rnd.uniform(0, 1.3)
        points.append((i, max(-90.0, min(90.0, p[1] + r * rnd.uniform(-1, 1))), (p[2] + 180 + r * rnd.uniform(-1, 1)) % 360 - 180))
    points += [(900, 90.0, 0.0), (901, -90.0, 12.0), (902, 0.0, 180.0), (903, 0.0, -180.0), (904, 5.0, 5.0)]
    want = {(i, k) for i, a, b in points for k, c, d, r in places if distance((a, b), (c, d)) <= r}
    odd = [(905, None, 1.0), (906, math.nan, 2.0), (907, 3.0, None), points[0]]
    pts = spark.createDataFrame(points + odd, "id bigint, lat double, lon double").withColumns({"x": F.lit("c"), "region": F.lit(1)})
    cir = spark.createDataFrame(places + [(200, None, 1.0, 5.0), (201, 1.0, 1.0, -5.0), (202, 1.0, 1.0, None)], "region bigint, lat double, lon double, radius_m double").withColumn("id", F.lit(0))
    assert {tuple(r) for r in within_circles(pts, cir).collect()} == want
    assert within_circles(pts.limit(0), cir).count() == 0 and within_circles(pts, cir.limit(0)).count() == 0


def test_polygons_vertices_and_edges(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]
    edges = [("p", 0, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]
    e = spark.createDataFrame(edges, "region string, piece int, x0 double, y0 double, x1 double, y1 double")
    cases = {(1, 1): True, (2, 3): False, (2, 2): True, (4, 4): True, (0, 2): True, (2, 0): True, (3, 3): True, (3, 3.5): False, (-1, 2): False, (5, 0): False, (1, 2): True, (-1, 4): False, (-1, 0): False}
    pts = spark.createDataFrame([(float(x), float(y)) for x, y in cases], "x double, y double").withColumns({c: F.lit(1) for c in ("ly", "cx", "edges", "piece", "x0")})
    got = {(r["x"], r["y"]) for r in points_in_polygons(pts, e).collect()}
    assert got == {k for k, v in cases.items() if v}


def test_polygon_of_many_edges(spark):
    rnd = random.Random(4)
    # a comb: all its teeth cross every strip, so a cell holds many rows of the index; and a ring of small steps
    teeth = [(i * 0.01, 10.0 if i % 2 else -10.0) for i in range(1, 401)]
    comb = [(0.0, -11.0), *teeth, (4.02, -11.0)]
    ring = [(20 + math.cos(a), math.sin(a)) for a in (2 * math.pi * i / 3000 for i in range(3000))]
    edges = [(name, 0, *p, *q) for name, pts in (("comb", comb), ("ring", ring)) for p, q in zip(pts, pts[1:] + pts[:1])]
    points = [(i, rnd.uniform(-0.1, 4.2), rnd.uniform(-12, 12)) for i in range(200)] + [(i, rnd.uniform(18.8, 21.2), rnd.uniform(-1.2, 1.2)) for i in range(200, 300)]
    points += [points[0], (400, None, 1.0), (401, 1.0, math.nan)]

    def inside(name, x, y):
        n = 0
        for r, _, x0, y0, x1, y1 in edges:
            if r == name and min(y0, y1) <= y < max(y0, y1):
                n += x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0))
        return n % 2 == 1

    want = sorted((i, name) for i, x, y in points if x is not None and not math.isnan(y) for name in ("comb", "ring") if inside(name, x, y))
    e = spark.createDataFrame([*edges, ("bad", 0, 1.0, None, 2.0, 3.0)], "region string, piece int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "id bigint, x double, y double").withColumns({"edges": F.lit(1), "piece": F.lit(2), "chunks": F.lit(3)})
    got = points_in_polygons(p, e)
    assert sorted((r["id"], r["region"]) for r in got.collect()) == want and got.columns == [*p.columns, "region"]
