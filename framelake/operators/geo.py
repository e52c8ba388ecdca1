"""Points in regions by crossing parity, and points within great-circle distance of places.

A polygon's edges are binned into latitude strips (and the polygon's longitude
range into columns) of a grid whose cells follow the polygon's size and, in
latitude, the root of the number of its edges.  A row of the index holds at most
``CHUNK`` edges.  Points meet the edges of their cell only; crossings of a ray
to the east are counted in each row, summed by point and polygon where a
polygon has several rows in a cell, and an odd number means inside.  Edges own their lower end (so a ray through a vertex counts
once) and a point on an edge is inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.physical import broadcast_if_light, broadcast_if_small
from framelake.staging import stage

EARTH_M = 6_371_000.0
#: Grid sizes are 180 / 2^level degrees; neighbouring sizes differ by 2^3.
LEVELS = (0, 3, 6, 9, 12, 15, 18)
#: Edges in a row of the index.
CHUNK = 64
#: Strips in which a circle's outline is drawn.
STRIPS = 16


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = EARTH_M) -> Column:
    """Haversine distance on a sphere, in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius_m * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _level(extent: Column, cells: Column) -> Column:
    """The finest level at which ``extent`` degrees span at most about ``cells`` cells."""
    return reduce(lambda rest, lv: F.when(extent <= cells * 180.0 / (1 << lv), F.lit(lv)).otherwise(rest), LEVELS, F.lit(0))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x * F.call_function("shiftleft", F.lit(1), level) / 180.0)


def edge_index(edges: DataFrame) -> DataFrame:
    """``ly``, ``lx``, ``cy``, ``cx``, ``region``, ``piece``, ``chunks``, ``edges``: a polygon's edges by grid cell, in ``chunks`` rows of at most ``CHUNK``.

    ``edges``: ``region``, ``piece`` (polygons of one region, which must not
    overlap), ``x0``, ``y0``, ``x1``, ``y1`` in degrees.  Edges with a null or
    NaN are left out.
    """
    edges = edges.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x0", "y0", "x1", "y1")))
    box = edges.groupBy("region", "piece").agg(F.min(F.least("x0", "x1")).alias("w"), F.max(F.greatest("x0", "x1")).alias("e"), F.min(F.least("y0", "y1")).alias("s"), F.max(F.greatest("y0", "y1")).alias("n"), F.count("*").alias("m"))
    strips = F.greatest(F.lit(8.0), 2 * F.sqrt("m"))
    box = box.withColumn("ly", _level(F.col("n") - F.col("s"), strips)).withColumn("lx", _level(F.col("e") - F.col("w"), F.lit(8.0)))
    rows = edges.join(box, ["region", "piece"]).withColumn("cy", F.explode(F.sequence(_cell(F.least("y0", "y1"), F.col("ly")), _cell(F.greatest("y0", "y1"), F.col("ly")))))
    key = ["region", "piece", "ly", "lx", "cy"]
    many = rows.groupBy(*key).agg(F.count("*").alias("_m")).where(F.col("_m") > CHUNK)
    # a strip with many edges is cut at random into pieces of at most about half a chunk, and these are cut to size
    rows = rows.join(many, key, "left").withColumn("_k", F.coalesce(F.ceil(F.col("_m") / (CHUNK // 2)), F.lit(1)))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("x0", "y0", "x1", "y1"), F.col("_k")))
    rows = rows.groupBy(*key, "w", "e", "_p").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_edges"))
    rows = rows.withColumn("edges", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_edges") - 1) / CHUNK).cast("int")), lambda i: F.slice("_edges", i * CHUNK + 1, CHUNK))))
    chunks = rows.groupBy(*key).agg(F.count("*").alias("chunks"))
    rows = rows.join(chunks, key)
    return rows.withColumn("cx", F.explode(F.sequence(_cell(F.col("w"), F.col("lx")), _cell(F.col("e"), F.col("lx"))))).select("ly", "lx", "cy", "cx", "region", "piece", "chunks", "edges")


def _crossings(edges: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """How many edges a ray to the east from (x, y) crosses, and whether the point lies on one."""

    def meets(e):
        return e.x0 + (y - e.y0) * F.try_divide(e.x1 - e.x0, e.y1 - e.y0)

    def crossed(e):
        return (y >= F.least(e.y0, e.y1)) & (y < F.greatest(e.y0, e.y1)) & (x < meets(e))

    def on(e):
        level = (e.y0 == e.y1) & (y == e.y0) & x.between(F.least(e.x0, e.x1), F.greatest(e.x0, e.x1))
        return level | (y.between(F.least(e.y0, e.y1), F.greatest(e.y0, e.y1)) & (e.y0 != e.y1) & (x == meets(e)))

    return F.size(F.filter(edges, crossed)), F.exists(edges, on)


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``points`` (``x``, ``y`` degrees, further columns but ``region``) with ``region`` for each polygon around them.

    The edge index is broadcast if its bytes are counted and few; otherwise
    points and index are shuffled by cell, where adaptive execution splits hot
    cells.  A null or NaN coordinate is in no region.
    """
    grid = ("ly", "lx", "cy", "cx")
    index = stage(edge_index(edges), "edge-index")
    seen = index.groupBy("ly", "lx").agg(F.max("chunks").alias("chunks")).collect()  # at most len(LEVELS)^2
    if not seen:
        return points.select("*", F.lit(None).cast(edges.schema["region"].dataType).alias("region")).limit(0)
    cells = F.array(*[F.struct(F.lit(r["ly"]).alias("ly"), F.lit(r["lx"]).alias("lx"), _cell(F.col("y"), F.lit(r["ly"])).alias("cy"), _cell(F.col("x"), F.lit(r["lx"])).alias("cx")) for r in seen])
    usable = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    several = max(r["chunks"] for r in seen) > 1
    if several:
        usable = usable.withColumn("_point", F.monotonically_increasing_id())
    asked = usable.withColumn("_c", F.explode(cells)).withColumns({f"_{k}": F.col(f"_c.{k}") for k in grid}).drop("_c")
    there = broadcast_if_light(index, 100 + 32 * F.size("edges")).withColumnsRenamed({k: f"_{k}" for k in (*grid, "edges", "piece", "chunks")})
    n, on = _crossings(F.col("_edges"), F.col("x"), F.col("y"))
    met = asked.join(there, [f"_{k}" for k in grid]).withColumns({"_n": n, "_on": on}).drop("_edges")
    inside = F.col("_on") | (F.col("_n") % 2 == 1)
    keep = [*points.columns, "region"]
    if not several:
        return met.where(inside).select(*keep)
    # crossings of a point and a polygon from several rows of the index
    first = [F.first(c).alias(c) for c in points.columns]
    summed = met.where("_chunks > 1").groupBy("_point", "region", "_piece").agg(*first, F.sum("_n").alias("_n"), F.max("_on").alias("_on"))
    return met.where("_chunks = 1").where(inside).select(*keep).unionByName(summed.where(inside).select(*keep))


def circle_edges(circles: DataFrame) -> DataFrame:
    """Edges of an outline that holds each circle (``region``, ``lat``, ``lon``, ``radius_m``) on the globe.

    The circle's latitudes are cut into strips; in each the outline has the
    circle's greatest half width there.  Over a pole the whole circle of
    longitude belongs to the outline; across the antimeridian it is cut into
    shifted pieces.  Circles with null, NaN or negative values have no edges.
    """
    ok = " and ".join(f"{c} is not null and not isnan({c})" for c in ("lat", "lon", "radius_m")) + " and region is not null and radius_m >= 0 and abs(lat) <= 90"
    half = F.lit(90 - 1e-9)
    inside = lambda d: F.radians(F.greatest(-half, F.least(half, d)))
    c = circles.where(ok).select("region", F.pmod(F.col("lon") + 180, F.lit(360.0)).alias("lon0"), "lat", (F.col("radius_m") / EARTH_M * (1 + 1e-6) + 1e-7).alias("rho"))
    c = c.withColumn("lon", F.col("lon0") - 180).withColumn("s", F.greatest(F.lit(-90.0001), F.col("lat") - F.degrees("rho"))).withColumn("n", F.least(F.lit(90.0001), F.col("lat") + F.degrees("rho")))
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STRIPS - 1))))
    at = lambda i: F.col("s") + (F.col("n") - F.col("s")) * i / STRIPS
    c = c.withColumn("y0", at(F.col("i"))).withColumn("y1", at(F.col("i") + 1))
    p0 = inside(F.col("lat"))

    def width(y: Column) -> Column:
        v = (F.cos("rho") - F.sin(inside(y)) * F.sin(p0)) / (F.cos(inside(y)) * F.cos(p0))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))

    polar = F.abs(F.col("lat")) + F.degrees("rho") >= 90 - 1e-6
    widest = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p0) / F.cos("rho")))))
    bulge = F.when(~polar & widest.between(F.col("y0"), F.col("y1")), F.asin(F.least(F.lit(1.0), F.sin("rho") / F.cos(p0)))).otherwise(F.lit(0.0))
    w = F.when(F.col("rho") >= 1.57, F.lit(180.0)).otherwise(F.degrees(F.greatest(width(F.col("y0")), width(F.col("y1")), bulge)) * (1 + 1e-9) + 1e-6)
    c = c.withColumn("w", w)
    # a strip over a pole goes all around, in piece 0; the others are drawn once and a turn to either side
    full = F.col("w") >= 180 - 1e-5
    turn = F.explode(F.when(full, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    c = c.withColumn("turn", turn)
    west = F.when(full, F.lit(-180.0001)).otherwise(F.col("lon") - F.col("w") + 360 * F.col("turn"))
    east = F.when(full, F.lit(180.0001)).otherwise(F.col("lon") + F.col("w") + 360 * F.col("turn"))
    c = c.select("region", F.col("turn").alias("piece"), west.alias("west"), east.alias("east"), "y0", "y1").where("east >= -180 and west <= 180")
    sides = F.array(*[F.struct(F.col(x).alias("x0"), F.col("y0"), F.col(x).alias("x1"), F.col("y1")) for x in ("west", "east")])
    return c.select("region", "piece", F.explode(sides).alias("e")).select("region", "piece", "e.x0", "e.y0", "e.x1", "e.y1")


def within_circles(points: DataFrame, circles: DataFrame) -> DataFrame:
    """``id``, ``region`` for each point (``id``, ``lat``, ``lon``) at most ``radius_m`` from a circle's centre.

    The outline finds the candidates, the great-circle distance decides.
    Repeated points count once; null or NaN positions are in no circle.
    """
    p = points.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = points_in_polygons(p, circle_edges(circles))
    centre = circles.select("region", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "radius_m")
    near = met.join(broadcast_if_small(centre), "region").where(great_circle_m(F.col("y"), F.col("x"), F.col("lat0"), F.col("lon0")) <= F.col("radius_m"))
    return near.select("id", "region").distinct()
