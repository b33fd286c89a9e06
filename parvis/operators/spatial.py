"""Points near points and regions holding points, by triangles in bounding-volume hierarchies.

Regions (polygons, circles, or the discs around points) are triangulated by ear clipping. A first hierarchy is built over a
histogram of the points, a table bounded by the grid, not by the data; its leaves are the units of work, and triangles and
points are sent to the leaves they touch. In a leaf a second hierarchy over its triangles yields candidates for its points,
each candidate triangle is tested exactly, and where a point lies on an edge that triangles share, or a triangle in several
leaves, the region is reported once. Distances are then checked exactly on the sphere.

Equal locations are folded into one point before any of this, so a location that a third of all rows share costs one point;
its rows are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

EARTH_KM = 6371.0088
CELL = 0.05  # degrees; the histogram has at most (46 - 20) * (154 - 122) / CELL ** 2 = 332,800 cells for the default domain
MOST_CELLS = 1_000_000
DOMAIN = (20.0, 46.0, 122.0, 154.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere of radius EARTH_KM."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def ear_clip(ring: np.ndarray) -> np.ndarray:
    """Triangles (k, 3, 2) of a simple polygon given as (n, 2) corners, open or closed, in either direction."""
    p = np.asarray(ring, float)
    if len(p) > 1 and np.array_equal(p[0], p[-1]):
        p = p[:-1]
    if len(p) < 3:
        return np.zeros((0, 3, 2))
    x, y = p[:, 0], p[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        p = p[::-1]
    left, out = list(range(len(p))), []

    def cross(a: int, b: int, c: int) -> float:
        return (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])

    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            if cross(a, b, c) <= 0:
                continue
            if any(cross(a, b, q) >= 0 and cross(b, c, q) >= 0 and cross(c, a, q) >= 0 for q in left if q not in (a, b, c) and not any(np.array_equal(p[q], p[z]) for z in (a, b, c))):
                continue
            out.append((a, b, c))
            del left[i]
            break
        else:  # only flat corners are left: drop one
            del left[next((i for i in range(len(left)) if abs(cross(left[i - 1], left[i], left[(i + 1) % len(left)])) < 1e-18), 0)]
    out.append(tuple(left))
    return p[np.array(out)]


def disc(lat: float, lon: float, radius_km: float, sides: int) -> np.ndarray:
    """Corners (lon, lat) of a polygon that holds the whole disc around a point on the sphere."""
    reach = np.degrees(radius_km / EARTH_KM)
    widest = min(89.0, abs(lat) + reach)
    angle = np.pi * (2 * np.arange(sides) + 1) / sides
    grow = 1.0005 / np.cos(np.pi / sides)
    return np.stack([lon + grow * reach / np.cos(np.radians(widest)) * np.cos(angle), lat + grow * reach * np.sin(angle)], 1)


class Hierarchy(NamedTuple):
    """A bounding-volume hierarchy as arrays; leaves hold ranges of ``order``."""

    box: np.ndarray  # (nodes, 4): least x, least y, most x, most y
    left: np.ndarray  # child, or -1 in a leaf
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray


def build(boxes: np.ndarray, weight: np.ndarray | None = None, leaf: float = 8) -> Hierarchy:
    """Median splits along the longer side of the centres until a leaf holds at most ``leaf`` weight or one box."""
    n = len(boxes)
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    centre = (boxes[:, :2] + boxes[:, 2:]) / 2
    order = np.arange(n)
    nodes: list[list] = []
    stack = [(0, n, -1, 0)] if n else []
    while stack:
        a, b, parent, side = stack.pop()
        own = order[a:b]
        node = len(nodes)
        nodes.append([np.concatenate([boxes[own, :2].min(0), boxes[own, 2:].max(0)]), -1, -1, a, b])
        if parent >= 0:
            nodes[parent][1 + side] = node
        if b - a > 1 and weight[own].sum() > leaf:
            c = centre[own]
            axis = int(np.ptp(c[:, 1]) > np.ptp(c[:, 0]))
            own = own[np.argsort(c[:, axis], kind="stable")]
            order[a:b] = own
            total = np.cumsum(weight[own])
            m = a + min(b - a - 1, max(1, int(np.searchsorted(total, total[-1] / 2))))
            stack += [(m, b, node, 1), (a, m, node, 0)]
    if not nodes:
        return Hierarchy(np.zeros((0, 4)), *(np.zeros(0, np.int64) for _ in range(4)), order)
    return Hierarchy(np.array([x[0] for x in nodes]), *(np.array([x[i] for x in nodes], np.int64) for i in range(1, 5)), order)


def overlaps(tree: Hierarchy, boxes: np.ndarray, at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, leaf node) of every leaf whose box a query box touches, level by level, in bounded portions."""
    if not len(tree.left):
        return
    stack = [(np.arange(i, min(i + at_once // 8, len(boxes))), np.zeros(min(at_once // 8, len(boxes) - i), np.int64)) for i in range(0, len(boxes), at_once // 8)]
    while stack:
        query, node = stack.pop()
        t, b = tree.box[node], boxes[query]
        hit = (t[:, 0] <= b[:, 2]) & (t[:, 2] >= b[:, 0]) & (t[:, 1] <= b[:, 3]) & (t[:, 3] >= b[:, 1])
        query, node = query[hit], node[hit]
        inner = tree.left[node] >= 0
        if (~inner).any():
            yield query[~inner], node[~inner]
        query, node = query[inner], node[inner]
        if len(query):
            query, node = np.concatenate([query, query]), np.concatenate([tree.left[node], tree.right[node]])
            for i in range(0, len(query), at_once):
                stack.append((query[i : i + at_once], node[i : i + at_once]))


def inside(triangles: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Is each point in its triangle, edges and corners included? Triangles run counter-clockwise."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]

    def cross(u, v, w):
        return (v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0])

    return (cross(a, b, points) >= 0) & (cross(b, c, points) >= 0) & (cross(c, a, points) >= 0)


def _in_leaf(points: pd.DataFrame, triangles: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, region) of one leaf, found by a hierarchy over its triangles."""
    corners = triangles[["x1", "y1", "x2", "y2", "x3", "y3"]].to_numpy().reshape(-1, 3, 2)
    regions = triangles["region"].to_numpy()
    tree = build(np.concatenate([corners.min(1), corners.max(1)], 1))
    where, ids = points[["x", "y"]].to_numpy(), points["point"].to_numpy()
    for query, node in overlaps(tree, np.concatenate([where, where], 1)):
        size = (tree.last - tree.first)[node]
        q = np.repeat(query, size)
        start = np.repeat(tree.first[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        t = tree.order[np.arange(len(q)) + start]
        ok = inside(corners[t], where[q])
        yield ids[q[ok]], regions[t[ok]]


class _Leaves:
    """The first hierarchy, over the histogram of the points; cells are squares of ``cell`` degrees."""

    def __init__(self, cells: np.ndarray, weight: np.ndarray, leaf: float, cell: float = CELL) -> None:
        low = cells * cell
        self.cell = cell
        self.tree = build(np.concatenate([low, low + cell], 1), weight, leaf)
        node = np.full(len(cells), -1)
        for n in np.flatnonzero(self.tree.left < 0):
            node[self.tree.order[self.tree.first[n] : self.tree.last[n]]] = n
        code = _code(cells)
        order = np.argsort(code)
        self.cells, self.code, self.node = cells[order], code[order], node[order]
        self.parts = np.maximum(1, np.ceil(np.sqrt(weight[order] / leaf))).astype(np.int64)

    def find(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and number of parts of each cell; every cell is one of the histogram."""
        at = np.searchsorted(self.code, _code(cells))
        return self.node[at], self.parts[at]


def _code(cells: np.ndarray) -> np.ndarray:
    return (cells[:, 0] << 32) + cells[:, 1]


def _points_scan(leaves):
    def scan(batches):
        known = leaves.value
        for b in batches:
            xy = b[["x", "y"]].to_numpy()
            cells = np.floor(xy / known.cell).astype(np.int64)
            if len(cells):
                yield pd.DataFrame({"leaf": _unit(cells, xy, *known.find(cells), known.cell), "point": b["point"], "x": b["x"], "y": b["y"]})

    return scan


def _unit(cells: np.ndarray, xy: np.ndarray, node: np.ndarray, parts: np.ndarray, cell: float) -> np.ndarray:
    """Name of the unit of work: the leaf, and in a crowded cell the part of the cell."""
    out = node.astype(str).astype(object)
    for k in np.flatnonzero(parts > 1):
        (cx, cy), p = cells[k], parts[k]
        out[k] = f"{cx}:{cy}:{int((xy[k, 0] - cx * cell) / cell * p)}:{int((xy[k, 1] - cy * cell) / cell * p)}"
    return out


def _triangles_scan(leaves):
    def scan(batches):
        known = leaves.value
        crowded: dict[int, list] = {}
        for k in np.flatnonzero(known.parts > 1):
            crowded.setdefault(int(known.node[k]), []).append((known.cells[k], int(known.parts[k])))
        hot = np.array(sorted(crowded), np.int64)
        for b in batches:
            c = b[["x1", "y1", "x2", "y2", "x3", "y3"]].to_numpy().reshape(-1, 3, 2)
            boxes = np.concatenate([c.min(1), c.max(1)], 1)
            index, name = [np.zeros(0, np.int64)], [np.zeros(0, object)]
            for query, node in overlaps(known.tree, boxes):
                query, node = np.asarray(query), np.asarray(node)
                split = np.isin(node, hot)
                index.append(query[~split])
                name.append(node[~split].astype(str).astype(object))
                for q, m in zip(query[split], node[split]):
                    for (cx, cy), parts in crowded[int(m)]:
                        step = known.cell / parts
                        x0, y0 = cx * known.cell, cy * known.cell
                        i = np.arange(max(0, int((boxes[q, 0] - x0) / step) - 1), min(parts - 1, int((boxes[q, 2] - x0) / step) + 1) + 1)
                        j = np.arange(max(0, int((boxes[q, 1] - y0) / step) - 1), min(parts - 1, int((boxes[q, 3] - y0) / step) + 1) + 1)
                        units = [f"{cx}:{cy}:{a}:{d}" for a in i for d in j]
                        index.append(np.full(len(units), q))
                        name.append(np.array(units, object))
            out = b.iloc[np.concatenate(index)].copy()
            out.insert(0, "leaf", np.concatenate(name))
            yield out

    return scan


_TRIANGLE = "region bigint, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


def triangulate_discs(discs: DataFrame, sides: int = 6) -> DataFrame:
    """Triangles of the polygons that hold the discs (region, latitude, longitude, radius_km)."""

    def scan(batches):
        for b in batches:
            parts, ids = [], []
            pattern = None
            for region, lat, lon, km in b[["region", "latitude", "longitude", "radius_km"]].itertuples(index=False):
                ring = disc(lat, lon, km, sides)
                if pattern is None:  # all discs have the same corners in the same order: clip once
                    order = ear_clip(np.stack([np.cos(np.pi * (2 * np.arange(sides) + 1) / sides), np.sin(np.pi * (2 * np.arange(sides) + 1) / sides)], 1))
                    base = np.stack([np.cos(np.pi * (2 * np.arange(sides) + 1) / sides), np.sin(np.pi * (2 * np.arange(sides) + 1) / sides)], 1)
                    pattern = np.array([[int(np.abs(base - corner).sum(1).argmin()) for corner in t] for t in order])
                parts.append(ring[pattern].reshape(-1, 6))
                ids.append(np.full(len(pattern), region))
            if parts:
                yield pd.DataFrame(np.concatenate(parts), columns=["x1", "y1", "x2", "y2", "x3", "y3"]).assign(region=np.concatenate(ids))[["region", "x1", "y1", "x2", "y2", "x3", "y3"]]

    return discs.select("region", "latitude", "longitude", "radius_km").mapInPandas(scan, _TRIANGLE)


def triangulate_polygons(polygons: DataFrame) -> DataFrame:
    """Triangles of polygons (region BIGINT, ring ARRAY<STRUCT<longitude, latitude>>), by ear clipping."""

    def scan(batches):
        for b in batches:
            parts, ids = [], []
            for region, ring in b[["region", "ring"]].itertuples(index=False):
                if ring is None or len(ring) < 3:
                    continue
                t = ear_clip(np.array([(p["longitude"], p["latitude"]) for p in ring]))
                parts.append(t.reshape(-1, 6))
                ids.append(np.full(len(t), region))
            if parts:
                yield pd.DataFrame(np.concatenate(parts), columns=["x1", "y1", "x2", "y2", "x3", "y3"]).assign(region=np.concatenate(ids))[["region", "x1", "y1", "x2", "y2", "x3", "y3"]]

    return polygons.select("region", "ring").mapInPandas(scan, _TRIANGLE)


def points_in_regions(points: DataFrame, triangles: DataFrame, *, leaf: int = 20_000) -> DataFrame:
    """(point, region), each once, for points (point BIGINT, longitude, latitude) in the regions of the triangles.

    Null and non-finite coordinates lie in no region; empty inputs give an empty result. The histogram that reaches the driver
    has at most MOST_CELLS cells: they are CELL degrees wide, or as much wider as the extent of the points needs.
    """
    spark = points.sparkSession
    own = points.select("point", F.col("longitude").alias("x"), F.col("latitude").alias("y")).where("x between -180 and 180 and y between -90 and 90")
    span = own.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    cell = max(CELL, float(np.sqrt((span[0] or 0.0) * (span[1] or 0.0) / MOST_CELLS)) * 1.01)
    cells = own.groupBy(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(F.count("*").alias("n")).toPandas()
    leaves = spark.sparkContext.broadcast(_Leaves(cells[["i", "j"]].to_numpy(np.int64).reshape(-1, 2), cells["n"].to_numpy(float), leaf, cell))
    placed = own.mapInPandas(_points_scan(leaves), "leaf string, point bigint, x double, y double")
    sent = triangles.mapInPandas(_triangles_scan(leaves), "leaf string, " + _TRIANGLE)

    def work(_, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = list(_in_leaf(p, t)) if len(p) and len(t) else []
        if not found:
            return pd.DataFrame({"point": pd.Series(dtype="int64"), "region": pd.Series(dtype="int64")})
        return pd.DataFrame({"point": np.concatenate([a for a, _ in found]), "region": np.concatenate([b for _, b in found])}).drop_duplicates()

    # a point belongs to one leaf, so a region that several of its triangles give is dropped within the leaf
    return placed.groupBy("leaf").cogroup(sent.groupBy("leaf")).applyInPandas(work, "point bigint, region bigint")


def usable(rows: DataFrame, *, key: str, location: str, domain: tuple[float, float, float, float] = DOMAIN) -> DataFrame:
    """(key, latitude, longitude) of the rows whose location is within the domain, null and impossible ones left out."""
    lat, lon = F.col(f"{location}.latitude").cast("double"), F.col(f"{location}.longitude").cast("double")
    return rows.select(F.col(key).alias("key"), lat.alias("latitude"), lon.alias("longitude")).where(F.col("latitude").between(domain[0], domain[1]) & F.col("longitude").between(domain[2], domain[3]))


def _spots(rows: DataFrame) -> DataFrame:
    return rows.withColumn("spot", F.xxhash64("latitude", "longitude"))


def near_pairs(rows: DataFrame, *, metres: float, chunk: int = 2_000) -> DataFrame:
    """(a, b) of different rows at most that far apart, a < b; rows as ``usable`` gives them.

    Distinct locations are paired first, the disc of each being a region; the rows of the locations follow by joins. Rows of
    one location are numbered into chunks, so that a location with a great many rows makes many small pieces of pairs.
    """
    from parvis.session import cut

    keyed = cut(_spots(rows))
    spots = cut(keyed.groupBy("spot").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.count("*").alias("n")))
    km = metres / 1000
    discs = triangulate_discs(spots.select(F.col("spot").alias("region"), "latitude", "longitude", F.lit(km).alias("radius_km")))
    met = points_in_regions(spots.select(F.col("spot").alias("point"), "longitude", "latitude"), discs).where("point <= region")
    p = spots.select(F.col("spot").alias("point"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"), F.col("n").alias("n1"))
    q = spots.select(F.col("spot").alias("region"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), F.col("n").alias("n2"))
    close = met.join(p, "point").join(q, "region").where(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= km)
    parts = F.when(F.col("n") > chunk, F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / chunk).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    members = keyed.join(spots.select("spot", "n"), "spot").select("spot", parts.alias("part"), "key")
    # pairs of pieces: (location, part) x (location, part), exploded so that no task holds more than one piece of each side
    pieces = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(n > chunk, F.ceil(n / chunk)).otherwise(F.lit(1)).cast("bigint") - 1))
    work = close.select("point", "region", "n1", "n2").select("point", "region", "n2", pieces(F.col("n1")).alias("part1")).select("point", "region", "part1", pieces(F.col("n2")).alias("part2"))
    left = members.select(F.col("spot").alias("point"), F.col("part").alias("part1"), F.col("key").alias("k1"))
    right = members.select(F.col("spot").alias("region"), F.col("part").alias("part2"), F.col("key").alias("k2"))
    pairs = work.join(left, ["point", "part1"]).join(right, ["region", "part2"])
    pairs = pairs.where((F.col("point") != F.col("region")) | (F.col("k1") < F.col("k2")))
    return pairs.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).where("a != b")


def rows_in_circles(rows: DataFrame, circles: DataFrame, sides: int = 48) -> DataFrame:
    """(key, region) for rows (as ``usable`` gives them) in circles (region BIGINT, latitude, longitude, radius_km)."""
    keyed = _spots(rows)
    spots = keyed.groupBy("spot").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    met = points_in_regions(spots.select(F.col("spot").alias("point"), "longitude", "latitude"), triangulate_discs(circles, sides))
    full = met.join(spots.withColumnRenamed("spot", "point"), "point").join(circles.select("region", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), "radius_km"), "region")
    held = full.where(haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) <= F.col("radius_km")).select(F.col("point").alias("spot"), "region")
    return keyed.join(held, "spot").select("key", "region")
