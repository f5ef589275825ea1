"""GeoJSON feature collections and JSON lines as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import to_utm, utm_zone


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a collection (one JSON document a file) or of one a line: properties (a DDL struct), kind, coordinates (JSON), row.

    Fails if nothing in the file is a feature.  Features without a geometry are left out, as on every read.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    feature = f"struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    as_one = F.from_json("value", f"struct<type:string,features:array<{feature}>>", {"mode": "PERMISSIVE"})
    rows = raw.select(F.posexplode(as_one["features"]).alias("row", "f"))
    if rows.isEmpty():
        raise ValueError(f"no features in {path}")
    return rows.where("f.geometry.type is not null").select("row", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def with_points(df: DataFrame) -> DataFrame:
    """Point features with longitude and latitude."""
    c = F.from_json("coordinates", "array<double>")
    return df.where("geometry_type = 'Point'").withColumns({"longitude": c[0], "latitude": c[1]}).where("longitude is not null and latitude is not null")


def with_parts(df: DataFrame) -> DataFrame:
    """Line features, a row per part: part, points (array of x, y); parts of fewer than two points are left out."""
    line, multi = F.from_json("coordinates", "array<array<double>>"), F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geometry_type") == "LineString", F.array(line)).when(F.col("geometry_type") == "MultiLineString", multi)
    out = df.where(F.col("geometry_type").isin("LineString", "MultiLineString")).select("*", F.posexplode(parts).alias("part", "_p"))
    return out.withColumn("points", F.transform("_p", lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))).drop("_p", "coordinates").where(F.size("points") >= 2)


def in_metres(df: DataFrame, zone: int | None = None) -> tuple[DataFrame, int]:
    """Points' x and y in a UTM zone, that of the middle of the table's extent unless given."""
    if zone is None:
        low, high = df.agg(F.min("longitude"), F.max("longitude")).first()
        zone = df.sparkSession.range(1).select(utm_zone(F.lit((low + high) / 2))).first()[0]
    x, y = to_utm(F.col("longitude"), F.col("latitude"), zone)
    return df.withColumns({"x": x, "y": y}), zone


def lines_in_metres(df: DataFrame, zone: int) -> DataFrame:
    def moved(p: Column) -> Column:
        x, y = to_utm(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))
    return df.withColumn("points", F.transform("points", moved))


def write_features(df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude") -> None:
    """Point features, one JSON object a line, in parallel; :func:`collection` joins a small table to one document."""
    features(df, lon, lat).write.mode("overwrite").text(path)


def features(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*df.columns).alias("properties"), point.alias("geometry"))).alias("value"))


def collection(df: DataFrame, order: str) -> str:
    """One document of a table that is published, so small: features in order."""
    rows = [r["value"] for r in features(df.orderBy(order)).collect()]
    return '{"type": "FeatureCollection", "features": [' + ", ".join(rows) + "]}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with line_no, counted from 1 in each file; blank lines are skipped, and the first that does not parse fails
    with its file and number.

    A line's number is that of the lines before it in its file: lines are counted by the parts in which Spark reads the file,
    so no part, and no file, has to pass one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of a file
    starts = blocks.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_from"))
    numbered = lines.join(starts, ["file", "_block"]).withColumn("line_no", F.col("_id") + F.col("_from")).where(F.trim("value") != "")
    parsed = numbered.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = parsed.where("r._bad is not null").orderBy("file", "line_no").select("file", "line_no").first()
    if bad:
        raise ValueError(f"invalid JSON at {bad['file']}:{bad['line_no']}")
    return parsed.select("line_no", "r.*").drop("_bad")
