"""Queries on the media tables: sessions and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.identifiers import squeezed
from framelake.functions.times import local_seconds, local_text
from framelake.operators.geo import points_in_polygons, within_circles
from framelake.operators.sessions import sessions

SESSION_GAP_S = 1800


def _frames(spark: SparkSession, d: str) -> DataFrame:
    images = spark.read.parquet(f"{d}/images.parquet")
    return images.select(squeezed(F.col("camera")).alias("entity"), local_seconds(F.col("capture_time")).alias("t"), F.col("image_id").alias("id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions(_frames(spark, d), SESSION_GAP_S).select(F.col("entity").alias("camera"), local_text(F.col("start")).alias("session_start"), local_text(F.col("end")).alias("session_end"))


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(_frames(spark, d), SESSION_GAP_S)
    return s.select(F.col("entity").alias("camera"), local_text(F.col("start")).alias("session_start"), local_text(F.col("end")).alias("session_end"), F.col("duration").alias("duration_s"), F.col("events").alias("frames"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    ok = "has_gps = 1 and lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0)"
    return spark.read.parquet(f"{d}/images.parquet").where(ok).select("image_id", "lat", "lon")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    places = spark.read.parquet(f"{d}/places.parquet").select(F.col("place_id").alias("region"), "lat", "lon", "radius_m")
    near = within_circles(_positions(spark, d).withColumnRenamed("image_id", "id"), places)
    return near.select(F.col("id").alias("image_id"), F.col("region").alias("place_id"))


# A star of eight corners around each place that is not at a seam, in shares of its radius (north, east); one degree is about 111 km
_STAR = [(1.0, 0.0), (0.3, 0.3), (0.0, 1.0), (-0.3, 0.3), (-1.0, 0.0), (-0.3, -0.3), (0.0, -1.0), (0.3, -0.3)]


def p5_regions(spark: SparkSession, d: str) -> DataFrame:
    """The star-shaped polygons that hold each image with a usable position, by crossing parity alone."""
    p = spark.read.parquet(f"{d}/places.parquet").where("abs(lat) < 80 and abs(lon) < 170 and radius_m between 1 and 500000").select(F.col("place_id").alias("region"), "lat", "lon", (F.col("radius_m") / 111000).alias("r"))
    corner = lambda k, axis: F.col("lat" if axis == 0 else "lon") + F.lit(_STAR[k % 8][axis]) * F.col("r")
    sides = F.array(*[F.struct(corner(k, 1).alias("x0"), corner(k, 0).alias("y0"), corner(k + 1, 1).alias("x1"), corner(k + 1, 0).alias("y1")) for k in range(8)])
    edges = p.select("region", F.lit(0).alias("piece"), F.explode(sides).alias("e")).select("region", "piece", "e.*")
    points = _positions(spark, d).distinct().select("image_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return points_in_polygons(points, edges).select("image_id", F.col("region").alias("place_id"))


QUERIES = {"p4_found": p4_found, "p4_sessions": p4_sessions, "p5_found": p5_found, "p5_regions": p5_regions}

_P4 = r"""
with f as (select distinct trim(regexp_replace(lower(camera), '[\s\p{Z}]+', ' ', 'g')) camera, image_id, left(capture_time, 19) s from images),
t as (select camera, image_id, try_strptime(translate(left(s, 10), ':', '-') || ' ' || substr(s, 12), '%Y-%m-%d %H:%M:%S') t from f
      where camera != '' and regexp_full_match(s, '\d{4}[-:]\d\d[-:]\d\d[T ]\d\d:\d\d:\d\d')),
g as (select *, case when date_diff('second', lag(t) over (partition by camera order by t), t) <= 1800 then 0 else 1 end n from t where t is not null),
s as (select camera, t, image_id, sum(n) over (partition by camera order by t rows unbounded preceding) no from g)
"""
_P4_COLS = "camera, strftime(min(t), '%Y-%m-%dT%H:%M:%S') as session_start, strftime(max(t), '%Y-%m-%dT%H:%M:%S') as session_end"

_CORNERS = ", ".join(f"({k}, {n}, {e})" for k, (n, e) in enumerate([*_STAR, _STAR[0]]))

ORACLE_SQL = {
    "p5_regions": f"""
with i as (select distinct image_id, lat, lon from images where has_gps = 1 and not isnan(lat) and not isnan(lon) and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)),
c(k, n, e) as (values {_CORNERS}), p as (select place_id, k, lat + n::double * (radius_m / 111000) y, lon + e::double * (radius_m / 111000) x from places, c where abs(lat) < 80 and abs(lon) < 170 and radius_m between 1 and 500000),
s as (select a.place_id, a.x x0, a.y y0, b.x x1, b.y y1 from p a join p b on a.place_id = b.place_id and b.k = a.k + 1)
select image_id, place_id from i, s where (lat >= least(y0, y1)) and lat < greatest(y0, y1) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) group by 1, 2 having count(*) % 2 = 1""",
    "p4_found": f"{_P4} select {_P4_COLS} from s group by camera, no",
    "p4_sessions": f"{_P4} select {_P4_COLS}, date_diff('second', min(t), max(t)) as duration_s, count(distinct image_id) as frames from s group by camera, no",
    "p5_found": """
with i as (select distinct image_id, lat, lon from images where has_gps = 1 and not isnan(lat) and not isnan(lon) and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0))
select distinct image_id, place_id from i, places p
where 2 * 6371000 * asin(least(1, sqrt(sin(radians(p.lat - i.lat) / 2) ** 2 + cos(radians(i.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - i.lon) / 2) ** 2))) <= radius_m""",
}
