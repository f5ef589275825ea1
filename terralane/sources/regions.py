"""Study regions, clipping to them, and files fetched once."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, inside_ring
from . import vector

Edges = list[tuple[float, float, float, float]]


@dataclass(frozen=True)
class Region:
    name: str
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float


# The pilot's bounds.
REGIONS = {"ulster_poughkeepsie": Region("Ulster County, Poughkeepsie area", -74.35, 41.55, -73.88, 42.12)}


def region(key: str) -> Region:
    if key not in REGIONS:
        raise ValueError(f"unknown region {key}; there are {', '.join(sorted(REGIONS))}")
    return REGIONS[key]


def points_inside(df: DataFrame, r: Region, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points in the region, its border included."""
    return df.where(F.col(lon).between(r.min_lon, r.max_lon) & F.col(lat).between(r.min_lat, r.max_lat))


def clip_segments(df: DataFrame, r: Region) -> DataFrame:
    """Segments (x1, y1, x2, y2 in degrees) cut to the region; those outside go.

    The part of a segment inside a box is an interval of its length: the largest entry and the smallest exit of both axes.
    """
    def span(p: str, q: str, low: float, high: float):
        d = F.col(q) - F.col(p)
        a, b = (low - F.col(p)) / d, (high - F.col(p)) / d
        level = F.when(F.col(p).between(low, high), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
        return F.when(d == 0, level).otherwise(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    out = df.withColumns({"_x": span("x1", "x2", r.min_lon, r.max_lon), "_y": span("y1", "y2", r.min_lat, r.max_lat)}).where("_x is not null and _y is not null")
    out = out.withColumns({"_a": F.greatest(F.lit(0.0), "_x.a", "_y.a"), "_b": F.least(F.lit(1.0), "_x.b", "_y.b")}).where("_a <= _b")
    at = lambda p, q, t: F.col(p) + F.col(t) * (F.col(q) - F.col(p))
    new = {"x1": at("x1", "x2", "_a"), "y1": at("y1", "y2", "_a"), "x2": at("x1", "x2", "_b"), "y2": at("y1", "y2", "_b")}
    return out.withColumns(new).drop("_x", "_y", "_a", "_b")


def boundary(spark: SparkSession, key: str) -> DataFrame:
    """A region's bounds as a layer of one polygon."""
    r = region(key)
    ring = [(r.min_lon, r.min_lat), (r.max_lon, r.min_lat), (r.max_lon, r.max_lat), (r.min_lon, r.max_lat), (r.min_lon, r.min_lat)]
    return spark.createDataFrame([(0, "Polygon", [ring], 4326, key, r.name)], f"row long, geometry_type string, parts {vector.PARTS}, epsg int, region_key string, name string")


def write_boundary(spark: SparkSession, path: str, key: str = "ulster_poughkeepsie") -> str:
    return vector.write_vector(boundary(spark, key), path)


def with_edges(df: DataFrame, edges: Edges) -> DataFrame:
    """Add _edges, a boundary's edges.  They come from one small layer, so every executor may have them."""
    rows = df.sparkSession.createDataFrame([([tuple(map(float, e)) for e in edges],)], "_edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return df.crossJoin(F.broadcast(rows))  # one row


def points_within(df: DataFrame, edges: Edges, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points that a boundary covers, its border included; those outside its bounds are left out before that is looked at."""
    if not edges:
        return df.limit(0)
    near = df.where(F.col(x).between(min(min(e[0], e[2]) for e in edges), max(max(e[0], e[2]) for e in edges)) & F.col(y).between(min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)))
    return with_edges(near, edges).where(inside_ring(F.col(x), F.col(y), F.col("_edges"))).drop("_edges")


def _cuts(x1: Column, y1: Column, x2: Column, y2: Column, edges: Column) -> Column:
    """Sorted shares of a segment, from 0 to 1, at which it meets an edge; for edges that it runs along, their ends."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy

    def meets(e: Column) -> Column:
        ex, ey, qx, qy = e["x2"] - e["x1"], e["y2"] - e["y1"], e["x1"] - x1, e["y1"] - y1
        det = dx * ey - dy * ex
        t, u = (qx * ey - qy * ex) / det, (qx * dy - qy * dx) / det
        along = lambda px, py: ((px - x1) * dx + (py - y1) * dy) / square
        same = F.when((qx * dy - qy * dx == 0) & (square > 0), F.array(along(e["x1"], e["y1"]), along(e["x2"], e["y2"])))
        return F.when(det != 0, F.when(u.between(0, 1), F.array(t))).otherwise(same)

    found = F.filter(F.flatten(F.filter(F.transform(edges, meets), lambda a: a.isNotNull())), lambda t: (t > 0) & (t < 1))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), found, F.array(F.lit(1.0)))))


def lines_within(segments: DataFrame, edges: Edges) -> DataFrame:
    """Segments (line, part, seg, x1..y2) cut to a boundary: each run inside becomes a part of its line, numbered anew.

    A segment is cut where it meets the boundary, and of the pieces those stay whose middle the boundary covers.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cut = with_edges(segments.select("line", "part", "seg", "x1", "y1", "x2", "y2"), edges).withColumn("_t", _cuts(x1, y1, x2, y2, F.col("_edges")))
    spans = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda i: F.struct(F.get("_t", i - 1).alias("a"), F.get("_t", i).alias("b")))
    at = lambda p, q, t: p + t * (q - p)
    inside = F.filter(spans, lambda s: inside_ring(at(x1, x2, (s["a"] + s["b"]) / 2), at(y1, y2, (s["a"] + s["b"]) / 2), F.col("_edges")))
    piece = cut.select("line", "part", "seg", "x1", "y1", "x2", "y2", F.explode(inside).alias("s"))
    piece = piece.select("line", "part", "seg", F.col("s.a").alias("a"), *[at(F.col(f"{c}1"), F.col(f"{c}2"), F.col(f"s.{e}")).alias(f"{c}{i}") for i, e in ((1, "a"), (2, "b")) for c in "xy"])
    order = Window.partitionBy("line").orderBy("part", "seg", "a")
    lag = lambda c: F.lag(c).over(order)
    joined = (lag("part") == F.col("part")) & (distance(lag("x2"), lag("y2"), F.col("x1"), F.col("y1")) < 1e-9)
    runs = piece.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(order) - 1)
    within = Window.partitionBy("line", "run").orderBy("part", "seg", "a")
    out = runs.withColumns({"_seg": F.row_number().over(within) - 1, "length": distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))})
    out = out.withColumn("m0", F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return out.select("line", F.col("run").cast("int").alias("part"), F.col("_seg").alias("seg"), "x1", "y1", "x2", "y2", "length", "m0").withColumn("seg_id", F.xxhash64("line", "part", "seg")).where("length > 0")


def box_meets(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a box and the area inside the edges have a point in common."""

    def crosses(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

        def span(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
            inside = p.between(low, high)
            a, b = (low - p) / d, (high - p) / d
            return (F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)))

        (a, b), (c, d) = span(e["x1"], dx, west, east), span(e["y1"], dy, south, north)
        return F.greatest(F.lit(0.0), a, c) <= F.least(F.lit(1.0), b, d)

    return F.exists(edges, crosses) | inside_ring((west + east) / 2, (south + north) / 2, edges)


def filter_to_region(df: DataFrame, edges: Edges, clip: bool = True) -> DataFrame:
    """Features of a layer that meet a boundary; with ``clip``, lines are cut to it.  Both are in the same coordinates.

    Polygons are kept whole: of those that meet the boundary nothing is cut off.
    """
    flat = F.flatten("parts")
    pairs = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.struct(F.get(p, i - 1)["x"].alias("x1"), F.get(p, i - 1)["y"].alias("y1"), F.coalesce(F.get(p, i)["x"], F.get(p, i - 1)["x"]).alias("x2"), F.coalesce(F.get(p, i)["y"], F.get(p, i - 1)["y"]).alias("y2")))))
    if not edges:
        return df.limit(0)
    marked = with_edges(df, edges).withColumn("_own", pairs)
    covered = F.exists(flat, lambda q: inside_ring(q["x"], q["y"], F.col("_edges")))
    crossed = F.exists("_own", lambda e: F.size(_cuts(e["x1"], e["y1"], e["x2"], e["y2"], F.col("_edges"))) > 2)
    area = F.col("geometry_type").isin("Polygon", "MultiPolygon") & F.exists("_edges", lambda e: inside_ring(e["x1"], e["y1"], F.col("_own")))
    kept = marked.where(covered | crossed | area).drop("_edges", "_own")
    if not clip:
        return kept
    is_line = F.col("geometry_type").isin("LineString", "MultiLineString", "GeometryCollection")
    _, made = vector.lines(kept.where(is_line))
    cut = lines_within(made, edges)
    start = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    runs = cut.groupBy("line", "part").agg(F.array_sort(F.collect_list(F.struct("seg", start.alias("a"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("b")))).alias("s"))
    points = F.concat(F.transform("s", lambda s: s["a"]), F.array(F.element_at("s", -1)["b"]))
    parts = runs.select("line", F.struct("part", points.alias("p")).alias("part")).groupBy("line").agg(F.array_sort(F.collect_list("part")).alias("_parts"))
    lines = kept.where(is_line).join(parts.select(F.col("line").alias("row"), F.transform("_parts", lambda p: p["p"]).cast(vector.PARTS).alias("_parts")), "row")
    lines = lines.withColumns({"parts": F.col("_parts"), "geometry_type": F.when(F.size("_parts") == 1, "LineString").otherwise("MultiLineString")}).drop("_parts")
    inside_points = kept.where(F.col("geometry_type").isin("Point", "MultiPoint"))
    trimmed = with_edges(inside_points, edges).withColumn("parts", F.filter("parts", lambda p: inside_ring(p[0]["x"], p[0]["y"], F.col("_edges")))).drop("_edges")
    areas = kept.where(F.col("geometry_type").isin("Polygon", "MultiPolygon"))
    return lines.select(*df.columns).unionByName(trimmed.where(F.size("parts") > 0).select(*df.columns)).unionByName(areas.select(*df.columns))


def posted(url: str, form: dict[str, str], timeout: float = 270.0, opener: Callable = urllib.request.urlopen) -> str:
    """The text that a server answers to a form; its own words are in the error where it refuses."""
    request = urllib.request.Request(url, data=urllib.parse.urlencode(form).encode(), headers={"Content-Type": "application/x-www-form-urlencoded; charset=UTF-8"}, method="POST")
    try:
        with opener(request, timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as refused:
        raise RuntimeError(f"{url} answered {refused.code}: {refused.read().decode('utf-8', 'replace')[:500]}") from refused
    except urllib.error.URLError as failed:
        raise RuntimeError(f"{url} cannot be reached: {failed.reason}") from failed


def fetched(url: str, folder: str, timeout: float = 300.0, opener=urllib.request.urlopen) -> str:
    """The file of a URL in ``folder``, downloaded unless it is there; a download cut short leaves nothing under its name."""
    path = os.path.join(folder, url.rstrip("/").rsplit("/", 1)[-1])
    if os.path.exists(path):
        return path
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with opener(url, timeout=timeout) as source, open(part, "wb") as out:
        while chunk := source.read(1 << 20):
            out.write(chunk)
    os.replace(part, path)
    return path
