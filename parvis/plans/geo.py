"""Queries on places and distances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from parvis.operators import spatial
from parvis.plans.registry import oracle, query
from parvis.session import table

NEAR_M = 75


@query
def p7_found(spark, d):
    """Pairs of saved places at most 75 m apart."""
    rows = spatial.usable(table(spark, d, "place_candidates"), key="place_row_id", location="location")
    return spatial.near_pairs(rows, metres=NEAR_M).select(F.col("a").alias("place_row_id"), F.col("b").alias("near_row_id"))


oracle("p7_found", """
WITH p AS (SELECT place_row_id AS id, location.latitude AS la, location.longitude AS lo FROM place_candidates
  WHERE location.latitude BETWEEN 20 AND 46 AND location.longitude BETWEEN 122 AND 154),
c AS (SELECT *, CAST(floor(la / 0.001) AS BIGINT) AS i, CAST(floor(lo / 0.001) AS BIGINT) AS j FROM p),
n AS (SELECT c.*, c.i + di AS ni, c.j + dj AS nj FROM c, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj))
SELECT n.id AS place_row_id, c.id AS near_row_id FROM n JOIN c ON n.ni = c.i AND n.nj = c.j AND n.id < c.id
WHERE 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(c.la - n.la) / 2), 2) + cos(radians(n.la)) * cos(radians(c.la)) * pow(sin(radians(c.lo - n.lo) / 2), 2)))) <= 0.075
""")


@query
def p7_areas(spark, d):
    """The areas whose circle holds each saved place."""
    rows = spatial.usable(table(spark, d, "place_candidates"), key="place_row_id", location="location")
    areas = table(spark, d, "geonames").where("code is not null").select(F.xxhash64("code").alias("region"), "code", F.col("center.latitude").alias("latitude"), F.col("center.longitude").alias("longitude"), F.col("coveringRadiusKm").alias("radius_km")).where("radius_km is not null and latitude is not null and longitude is not null")
    held = spatial.rows_in_circles(rows, areas.drop("code"))
    return held.join(areas.select("region", "code"), "region").select(F.col("key").alias("place_row_id"), "code")


oracle("p7_areas", """
SELECT place_row_id, code FROM place_candidates p, geonames g
WHERE location.latitude BETWEEN 20 AND 46 AND location.longitude BETWEEN 122 AND 154 AND
  2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(g.center.latitude - p.location.latitude) / 2), 2) + cos(radians(p.location.latitude)) * cos(radians(g.center.latitude)) * pow(sin(radians(g.center.longitude - p.location.longitude) / 2), 2)))) <= coveringRadiusKm
""")


@query
def p7_polygons(spark, d):
    """The municipality stars that hold each saved place: concave polygons of ten corners around the area's centre."""
    rows = spatial.usable(table(spark, d, "place_candidates"), key="place_row_id", location="location")
    areas = table(spark, d, "geonames").where("code is not null and type = 'MUNICIPALITY' and coveringRadiusKm is not null and center.latitude is not null and center.longitude is not null")
    reach = F.col("coveringRadiusKm") / 111.0
    corners = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct((F.col("center.longitude") + reach * F.when(k % 2 == 0, 1.0).otherwise(0.4) * F.cos(k * math.pi / 5 + 0.1)).alias("longitude"), (F.col("center.latitude") + reach * F.when(k % 2 == 0, 1.0).otherwise(0.4) * F.sin(k * math.pi / 5 + 0.1)).alias("latitude")))
    stars = areas.select(F.xxhash64("code").alias("region"), "code", corners.alias("ring"))
    held = spatial.points_in_regions(rows.withColumnRenamed("key", "point"), spatial.triangulate_polygons(stars))
    return held.join(stars.select("region", "code"), "region").select(F.col("point").alias("place_row_id"), "code")


# a point is inside where a ray to the east crosses an odd number of sides
oracle("p7_polygons", """
WITH g AS (SELECT code, center.longitude AS x, center.latitude AS y, coveringRadiusKm / 111.0 AS r FROM geonames WHERE type = 'MUNICIPALITY' AND coveringRadiusKm IS NOT NULL),
c AS (SELECT code, x, y, r, k, x + r * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.4 END * cos(k * pi() / 5 + 0.1) AS cx, y + r * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.4 END * sin(k * pi() / 5 + 0.1) AS cy FROM g, range(10) t(k)),
s AS (SELECT a.code, a.x, a.y, a.r, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2 FROM c a JOIN c b ON a.code = b.code AND b.k = (a.k + 1) % 10),
p AS (SELECT place_row_id, location.longitude AS px, location.latitude AS py FROM place_candidates WHERE location.latitude BETWEEN 20 AND 46 AND location.longitude BETWEEN 122 AND 154)
SELECT place_row_id, code FROM p JOIN s ON abs(px - x) <= r AND abs(py - y) <= r WHERE (y1 > py) != (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
