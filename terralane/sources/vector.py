"""Vector layers from and to files: attributes as columns, geometry as parts, and the coordinate system.

A layer has row, geometry_type, parts (an array of arrays of structs x, y: points, lines or rings), epsg, and a column for each
attribute.  Parquet keeps a layer as it is; the other formats are read and written by name of the file.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import from_utm, segments, to_utm, utm_zone
from . import shapes

#: Columns of a layer that are not attributes.
OWN = ("row", "geometry_type", "parts", "epsg")
# Codes of longitude and latitude, and of the northern UTM zones on two datums.
LON_LAT, UTM_BASES = (4326, 4269), (32600, 26900)
PARTS = "array<array<struct<x:double,y:double>>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_vector(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The layer of a GeoJSON, shape, zipped shape, geometry package or Parquet file, without features that have no geometry.

    A missing file, a file without geometry and a layer without a coordinate system are errors.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no vector file at {path}")
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "json"):
        raw = _collection(spark, path)
    elif kind in ("shp", "zip", "gpkg"):
        shapes.register(spark)
        source = spark.read.format("geopackage" if kind == "gpkg" else "shapes")
        found = (source.option("layer", layer) if layer else source).load(path)
        raw = found.select("row", F.col("kind").alias("geometry_type"), _points_of(F.from_json("parts", "array<array<array<double>>>")).alias("parts"), "epsg", "attributes")
    else:
        raw = spark.read.parquet(path)
        if "parts" not in raw.columns:
            raise ValueError(f"no geometry column in {path}")
    raw = raw.where(F.exists("parts", lambda p: F.size(p) > 0))
    if raw.where("epsg is null").limit(1).count():
        raise ValueError(f"no coordinate system in {path}")
    return spread(raw) if "attributes" in raw.columns else raw


def _point(q: Column) -> Column:
    return F.struct(q[0].alias("x"), q[1].alias("y"))


def _points_of(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.transform(p, _point))


def _parts(kind: Column, coordinates: Column) -> Column:
    """Parts of a GeoJSON geometry whose coordinates are JSON text."""
    deep = lambda n: F.from_json(coordinates, "array<" * n + "double" + ">" * n)
    return (
        F.when(kind == "Point", F.array(F.array(_point(deep(1)))))
        .when(kind == "MultiPoint", F.transform(deep(2), lambda q: F.array(_point(q))))
        .when(kind == "LineString", F.array(F.transform(deep(2), _point)))
        .when(kind.isin("MultiLineString", "Polygon"), _points_of(deep(3)))
        .when(kind == "MultiPolygon", _points_of(F.flatten(deep(4))))
    )


def _collection(spark: SparkSession, path: str) -> DataFrame:
    """A feature collection; the parts of a geometry collection are those of its members."""
    geometry = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
    schema = f"struct<crs:struct<properties:struct<name:string>>,features:array<struct<properties:map<string,string>,geometry:{geometry}>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    rows = doc.select("d.crs", F.posexplode("d.features").alias("row", "f")).where("f.geometry.type is not null")
    name = F.coalesce("crs.properties.name", F.lit("CRS84"))
    epsg = F.when(F.contains(name, F.lit("CRS84")), 4326).otherwise(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int"))
    g = F.col("f.geometry")
    members = F.flatten(F.transform(g["geometries"], lambda m: F.coalesce(_parts(m["type"], m["coordinates"]), F.array().cast(PARTS))))
    parts = F.when(g["type"] == "GeometryCollection", members).otherwise(_parts(g["type"], g["coordinates"]))
    return rows.select(F.col("row").cast("long").alias("row"), g["type"].alias("geometry_type"), parts.cast(PARTS).alias("parts"), epsg.alias("epsg"), F.col("f.properties").alias("attributes"))


def spread(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """A map of texts as columns: whole numbers, numbers or booleans where all values read as such, else text.

    A number with leading zeros is a code, so text.  The names are one file's, so few.
    """
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(attributes))).distinct().collect())
    names = [n for n in names if n not in OWN]
    if not names:
        return df.drop(attributes)
    value = lambda n: F.col(attributes)[n]
    fits = {"long": r"^-?(0|[1-9]\d{0,17})$", "double": r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$", "boolean": r"^(true|false)$"}
    aggs = [F.bool_and(F.rlike(value(n), F.lit(p))).alias(f"{i}_{kind}") for i, n in enumerate(names) for kind, p in fits.items()]
    found = df.agg(*aggs).first()
    kind = lambda i: next((k for k in fits if found[f"{i}_{k}"]), "string")
    return df.select(*[c for c in df.columns if c != attributes], *[value(n).cast(kind(i)).alias(n) for i, n in enumerate(names)])


# --- Coordinate systems ---


def zone_of(epsg: int) -> int | None:
    """The UTM zone of a code, None for longitude and latitude."""
    if epsg in LON_LAT:
        return None
    for base in UTM_BASES:
        if 1 <= epsg - base <= 60:
            return epsg - base
    raise ValueError(f"unsupported coordinate system: EPSG {epsg}")


def _epsg(df: DataFrame) -> int | None:
    found = [r[0] for r in df.select("epsg").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("a layer has one coordinate system")
    return found[0] if found else None


def _moved(df: DataFrame, move, epsg: int) -> DataFrame:
    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return df.withColumns({"parts": F.transform("parts", lambda part: F.transform(part, point)), "epsg": F.lit(epsg)})


def to_lon_lat(df: DataFrame) -> DataFrame:
    epsg = _epsg(df)
    zone = zone_of(epsg) if epsg else None
    return df if zone is None else _moved(df, lambda x, y: from_utm(x, y, zone), LON_LAT[0])


def extent(df: DataFrame) -> tuple[float, float, float, float] | None:
    """Least and greatest x and y of a layer, None if it is empty."""
    p = df.select(F.explode(F.flatten("parts")).alias("p"))
    r = p.agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first()
    return None if r[0] is None else tuple(r)


def to_metres(*layers: DataFrame) -> tuple[list[DataFrame], int]:
    """Layers in one UTM zone: that of the first, if it is in metres already, else of the middle of their common extent."""
    codes = [_epsg(layer) for layer in layers]
    if not any(codes):
        raise ValueError("no layer has a feature")
    first = next(zone_of(c) for c in codes if c)
    if first is None:
        ends = [e for e in (extent(to_lon_lat(layer)) for layer, c in zip(layers, codes, strict=True) if c) if e]
        middle = (min(e[0] for e in ends) + max(e[2] for e in ends)) / 2
        first = layers[0].sparkSession.range(1).select(utm_zone(F.lit(middle))).first()[0]
    zone = first
    out = []
    for layer, code in zip(layers, codes, strict=True):
        if code and zone_of(code) != zone:
            layer = _moved(to_lon_lat(layer), lambda x, y: to_utm(x, y, zone), UTM_BASES[0] + zone)
        out.append(layer)
    return out, zone


def add_lon_lat(df: DataFrame, zone: int) -> DataFrame:
    """longitude and latitude of columns x and y in a zone."""
    lon, lat = from_utm(F.col("x"), F.col("y"), zone)
    return df.withColumns({"longitude": lon, "latitude": lat})


# --- Layers as operators take them ---


def points(df: DataFrame) -> DataFrame:
    """A row per feature with x and y: a point's place, or the middle of the others' bounds."""
    p = F.flatten("parts")
    mid = lambda c: (F.array_min(F.transform(p, lambda q: q[c])) + F.array_max(F.transform(p, lambda q: q[c]))) / 2
    return df.withColumns({"x": mid("x"), "y": mid("y")}).drop("geometry_type", "parts", "epsg")


def lines(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes by line, segments): the line's number is its row; parts of fewer than two points are left out.

    Segments have line, part, seg, x1, y1, x2, y2, m0, length, and seg_id.  Rings of polygons and members of collections count
    as parts, points do not.
    """
    long = df.where(~F.col("geometry_type").isin("Point", "MultiPoint")).withColumnRenamed("row", "line")
    parts = long.select("line", F.posexplode("parts").alias("part", "points")).where(F.size("points") >= 2)
    made = segments(parts, "line").where("length > 0")
    return long.drop("geometry_type", "parts", "epsg"), made.withColumn("seg_id", F.xxhash64("line", "part", "seg"))


def edges(df: DataFrame) -> list[tuple[float, float, float, float]]:
    """Edges of a boundary layer's rings: the borders of a few regions, so a small table."""
    ring = df.where(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select(F.explode("parts").alias("p"))
    pairs = ring.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))).alias("e"))
    return [(r["e"]["a"]["x"], r["e"]["a"]["y"], r["e"]["b"]["x"], r["e"]["b"]["y"]) for r in pairs.collect()]


def of_points(df: DataFrame, x: str = "longitude", y: str = "latitude", epsg: int = LON_LAT[0]) -> DataFrame:
    """A layer of a table of places."""
    place = F.array(F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    return df.drop("row").withColumns({"row": F.monotonically_increasing_id(), "geometry_type": F.lit("Point"), "parts": place, "epsg": F.lit(epsg)}).where(F.col(x).isNotNull() & F.col(y).isNotNull())


# --- Writing ---


def wkt(kind: Column, parts: Column) -> Column:
    """Well-known text of a geometry."""
    two = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    run = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, two), ", "), F.lit(")"))
    runs = F.concat(F.lit("("), F.array_join(F.transform(parts, run), ", "), F.lit(")"))
    return (
        F.when(kind == "Point", F.concat(F.lit("POINT ("), two(parts[0][0]), F.lit(")")))
        .when(kind == "MultiPoint", F.concat(F.lit("MULTIPOINT "), runs))
        .when(kind == "LineString", F.concat(F.lit("LINESTRING "), run(parts[0])))
        .when(kind == "Polygon", F.concat(F.lit("POLYGON "), runs))
        .when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), runs, F.lit(")")))
        .otherwise(F.concat(F.lit("MULTILINESTRING "), runs))
    )


def feature_json(df: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    pair = lambda p: F.array(p["x"], p["y"])
    run = lambda part: F.transform(part, pair)
    kind, parts = F.col("geometry_type"), F.col("parts")
    text = (
        F.when(kind == "Point", F.to_json(pair(parts[0][0])))
        .when(kind == "LineString", F.to_json(run(parts[0])))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda part: pair(part[0]))))
        .when(kind == "MultiPolygon", F.to_json(F.array(F.transform(parts, run))))
        .otherwise(F.to_json(F.transform(parts, run)))
    )
    named = F.when(kind == "GeometryCollection", "MultiLineString").otherwise(kind)
    names = [c for c in df.columns if c not in OWN]
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return df.select(F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": {"type": "'), named, F.lit('", "coordinates": '), text, F.lit("}}")).alias("value"))


def write_vector(df: DataFrame, path: str, layer: str | None = None, order: str | None = None) -> str:
    """Write a layer by the name's ending and return where it is.

    .csv: attributes and geometry_wkt, in parallel.  .parquet: as it is.  .geojson and .json: one document, in longitude and
    latitude.  Anything else becomes a .gpkg.  Documents and packages are single files by their nature: rows stream through
    the driver one at a time; a layer that is not published belongs into Parquet.
    """
    kind = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""
    rows = df.orderBy(order) if order else df
    if kind == "csv":
        rows.select(*[c for c in df.columns if c not in OWN], wkt(F.col("geometry_type"), F.col("parts")).alias("geometry_wkt")).write.mode("overwrite").csv(path, header=True)
    elif kind == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif kind in ("geojson", "json"):
        write_document((r["value"] for r in feature_json(to_lon_lat(rows)).toLocalIterator()), path)
    else:
        path = path if kind == "gpkg" else f"{path.removesuffix('.' + kind) if kind else path}.gpkg"
        _write_package(rows, path.removeprefix("file://"), layer or os.path.basename(path).rsplit(".", 1)[0])
    return path


def write_document(features: Iterator[str], path: str) -> None:
    """A feature collection of features given as text; the file appears whole or not at all."""

    def pieces() -> Iterator[str]:
        yield '{"type": "FeatureCollection", "features": ['
        for i, f in enumerate(features):
            yield (",\n" if i else "\n") + f
        yield "\n]}\n"

    write_file(path, pieces())


def write_file(path: str, pieces: Iterator[str]) -> None:
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as out:
        for piece in pieces:
            out.write(piece)
    os.replace(part, path)


_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 5}


def blob(kind: str, parts: list, epsg: int) -> bytes:
    """A geometry package's blob: a header without an envelope, then well-known binary."""
    run = lambda part: struct.pack("<I", len(part)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in part)
    head = lambda code: struct.pack("<BI", 1, code)
    code = _CODES[kind]
    if code == 1:
        body = head(1) + struct.pack("<2d", parts[0][0]["x"], parts[0][0]["y"])
    elif code == 2:
        body = head(2) + run(parts[0])
    elif code == 3:
        body = head(3) + struct.pack("<I", len(parts)) + b"".join(map(run, parts))
    elif code == 4:
        body = head(4) + struct.pack("<I", len(parts)) + b"".join(head(1) + struct.pack("<2d", p[0]["x"], p[0]["y"]) for p in parts)
    elif code == 5:
        body = head(5) + struct.pack("<I", len(parts)) + b"".join(head(2) + run(p) for p in parts)
    else:
        body = head(6) + struct.pack("<I", 1) + head(3) + struct.pack("<I", len(parts)) + b"".join(map(run, parts))
    return b"GP" + struct.pack("<BBi", 0, 1, epsg) + body


def _write_package(df: DataFrame, path: str, layer: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    names = [c for c in df.columns if c not in OWN]
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL"}
    types = dict(df.dtypes)
    quoted = [f'"{n}"' for n in names]
    with sqlite3.connect(part) as db:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        db.execute(f'CREATE TABLE "{layer}" (' + ", ".join(["_fid INTEGER PRIMARY KEY AUTOINCREMENT", "geom BLOB", *(f"{q} {kinds.get(types[n], 'TEXT')}" for q, n in zip(quoted, names, strict=True))]) + ")")
        insert = f'INSERT INTO "{layer}" ({", ".join(["geom", *quoted])}) VALUES ({", ".join("?" * (len(names) + 1))})'
        seen: int | None = None
        for r in df.toLocalIterator(prefetchPartitions=True):
            seen = r["epsg"]
            plain = (v if v is None or isinstance(v, bool | int | float | str) else json.dumps(v, default=str) if isinstance(v, list | dict) else str(v) for v in (r[n] for n in names))
            db.execute(insert, [blob(r["geometry_type"], r["parts"], seen), *plain])
        epsg = LON_LAT[0] if seen is None else seen
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG {epsg}", epsg, epsg))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, epsg))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, epsg))
    db.close()
    os.replace(part, path)
