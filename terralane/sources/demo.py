"""A small made-up study area: straight roads, bent streams, known sites and a terrain formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import segments
from ..operators.raster import Grid

WEST, NORTH, CELL, SIZE = 577_800.0, 4_623_600.0, 30.0, 220


def _lines(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "line long, name string, rank int, points array<struct<x:double,y:double>>")


def roads(spark: SparkSession) -> DataFrame:
    """Six roads across the area, three each way."""
    east = [(i, f"State Rte {20 + i}", 1, [(WEST + 200, NORTH - 1200 * (i + 1)), (WEST + 6300, NORTH - 1200 * (i + 1) - 300)]) for i in range(3)]
    south = [(3 + i, f"Co Rd {5 + i}", 2, [(WEST + 1500 * (i + 1), NORTH - 200), (WEST + 1500 * (i + 1) + 250, NORTH - 6300)]) for i in range(3)]
    return _lines(spark, east + south)


def streams(spark: SparkSession) -> DataFrame:
    """Four streams of orders 1 to 4, each bent twice."""
    rows = []
    for i in range(4):
        x = WEST + 900 + 1450 * i
        rows.append((i, f"Stream {i + 1}", i + 1, [(x, NORTH - 150), (x + 350, NORTH - 2100), (x - 150, NORTH - 4200), (x + 420, NORTH - 6400)]))
    return _lines(spark, rows)


def terrain(spark: SparkSession) -> tuple[DataFrame, Grid]:
    """Elevations that rise to the south-east, with two valleys."""
    cells = spark.range(SIZE * SIZE).select((F.col("id") / SIZE).cast("int").alias("row"), (F.col("id") % SIZE).cast("int").alias("col"))
    r, c = F.col("row"), F.col("col")
    v = 145 + 0.12 * c + 0.08 * r - 8 * F.exp(-F.pow(c - 95, 2) / 2500) - 5 * F.exp(-F.pow(r - 120, 2) / 1800)
    return cells.withColumn("v", v), Grid(WEST, NORTH, CELL, CELL, SIZE, SIZE)


def write_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """The area as files: roads, streams, known sites where streams of higher order pass, and the terrain."""
    from ..functions.geometry import utm_zone
    from ..operators import candidates as cand
    from . import geotiff, vector

    zone = spark.range(1).select(utm_zone(F.lit(-74.0))).first()[0]
    epsg = vector.UTM_BASES[0] + zone

    def layer(df: DataFrame, order: str) -> DataFrame:
        return df.select(F.col("line").alias("row"), F.lit("LineString").alias("geometry_type"), F.array("points").cast(vector.PARTS).alias("parts"), F.lit(epsg).alias("epsg"), "name", F.col("rank").alias(order))

    r, s = roads(spark), streams(spark)
    met = cand.meetings(segments(r, "line"), segments(s, "line"), 30.0).join(s.select(F.col("line").alias("stream_line"), "rank"), "stream_line").where("rank >= 3")
    known = met.select((F.col("x") + 4).alias("x"), (F.col("y") - 3).alias("y"), F.format_string("K%02d%02d", "road_line", "stream_line").alias("culvert_id"))
    cells, grid = terrain(spark)
    return {
        "roads": vector.write_vector(layer(r, "road_rank"), f"{folder}/roads.gpkg"),
        "streams": vector.write_vector(layer(s, "stream_order"), f"{folder}/streams.gpkg"),
        "known": vector.write_vector(vector.of_points(known, "x", "y", epsg).drop("x", "y"), f"{folder}/known.gpkg"),
        "dem": geotiff.write_raster(cells, grid, epsg, f"{folder}/dem.tif"),
    }


def queue(spark: SparkSession) -> DataFrame:
    """The whole path: candidates, labels, features, terrain, scores."""
    from ..operators import candidates as cand
    from ..operators import features as feat
    from ..operators import labels, raster, scoring
    from ..storage import materialize

    r, s = roads(spark), streams(spark)
    road_segments, stream_segments = segments(r, "line"), segments(s, "line")
    found = cand.generate(road_segments, stream_segments, cand.road_attributes(r), cand.stream_attributes(s.withColumn("stream_order", F.col("rank"))), 30.0, 20.0)
    found, _ = materialize(found.withColumn("row", F.col("n")), "demo-candidates")
    known = found.where("stream_order >= 3").select(F.col("n").alias("known_row"), (F.col("x") + 4).alias("x"), (F.col("y") - 3).alias("y"), F.format_string("K%03d", F.col("n")).alias("culvert_id"))
    out = labels.label_known(feat.derived(found), known, 35.0)
    for name, layer in (("road", road_segments), ("stream", stream_segments)):
        out = feat.line_features(out, layer.withColumn("seg_id", F.xxhash64("line", "part", "seg")), "row", name, 75.0, (500.0,))
    cells, grid = terrain(spark)
    out = raster.window_stats(raster.sample(out, cells, grid, "elevation_m"), cells, grid, "row")
    out, _ = materialize(feat.hydrology_proxies(out), "demo-features")
    return scoring.score_candidates(labels.sample_weights(out))
