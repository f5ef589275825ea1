"""Shapefiles, zipped or not, and SQLite geometry packages, as Spark data sources."""

from __future__ import annotations

import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row long, kind string, parts string, attributes map<string,string>, epsg int"
_KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def _files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    p = Path(path.removeprefix("file://"))
    found = sorted(str(f) for f in p.rglob("*") if f.suffix.lower() in suffixes) if p.is_dir() else [str(p)] if p.exists() else []
    if not found:
        raise FileNotFoundError(f"no {'/'.join(suffixes)} file at {path}")
    return found


def projection_code(text: str) -> int | None:
    """The code of a .prj file: longitude and latitude, or a northern UTM zone, on two datums; None for no text."""
    if not text.strip():
        return None
    american = re.search(r"NAD(?:_|\s)*(?:19)?83|North_American_1983", text) is not None
    if not text.lstrip().upper().startswith("PROJC"):
        return 4269 if american else 4326
    zone = re.search(r"UTM[_\s]+zone[_\s]+(\d+)N", text, re.IGNORECASE)
    if zone is None:
        raise ValueError(f"unsupported coordinate system: {text[:80]}")
    return (26900 if american else 32600) + int(zone[1])


def shape_records(shp: bytes) -> Iterator[tuple[str | None, list]]:
    """(kind, parts) of each record; parts are lists of [x, y]; a null shape has kind None."""
    at = 100
    while at + 8 <= len(shp):
        (words,) = struct.unpack(">i", shp[at + 4 : at + 8])
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (code,) = struct.unpack("<i", body[:4])
        base = code % 10
        if code == 0:
            yield None, []
        elif base == 1:
            yield "Point", [[list(struct.unpack("<2d", body[4:20]))]]
        elif base == 8:
            (n,) = struct.unpack("<i", body[36:40])
            yield "MultiPoint", [[list(struct.unpack("<2d", body[40 + 16 * i : 56 + 16 * i])) for i in range(n)]]
        else:
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            values = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            points = [[values[2 * i], values[2 * i + 1]] for i in range(n_points)]
            yield _KINDS[base], [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def table_rows(dbf: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Rows of a dBase table as strings; blank fields are null."""
    count, head, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii"), dbf[at + 16]))
        at += 32
    for i in range(count):
        row, out, p = dbf[head + i * size : head + (i + 1) * size], {}, 1
        for name, width in fields:
            out[name] = row[p : p + width].decode(encoding, "replace").strip("\0 ") or None
            p += width
        yield out


def blob_geometry(blob: bytes) -> tuple[str | None, list]:
    """(kind, parts) of a geometry package's blob: a header, then well-known binary."""
    if blob[:2] != b"GP":
        raise ValueError("not a geometry package blob")
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    if blob[3] >> 4 & 1:
        return None, []
    kind, parts, _ = _wkb(blob, 8 + envelope)
    return kind, parts


def _wkb(b: bytes, at: int) -> tuple[str, list, int]:
    o = "<" if b[at] else ">"
    (code,) = struct.unpack(o + "I", b[at + 1 : at + 5])
    dims = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)
    code, at = code % 1000, at + 5

    def points(at: int) -> tuple[list, int]:
        (n,) = struct.unpack(o + "I", b[at : at + 4])
        v = struct.unpack(f"{o}{n * dims}d", b[at + 4 : at + 4 + 8 * n * dims])
        return [[v[i * dims], v[i * dims + 1]] for i in range(n)], at + 4 + 8 * n * dims

    if code == 1:
        return "Point", [[list(struct.unpack(o + "2d", b[at : at + 16]))]], at + 8 * dims
    if code == 2:
        p, at = points(at)
        return "LineString", [p], at
    (n,) = struct.unpack(o + "I", b[at : at + 4])
    at, parts = at + 4, []
    if code == 3:
        for _ in range(n):
            p, at = points(at)
            parts.append(p)
        return "Polygon", parts, at
    for _ in range(n):
        _, p, at = _wkb(b, at)
        parts += p
    return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}[code], parts, at


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path, (".shp", ".zip"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        if partition.path.lower().endswith(".zip"):
            with zipfile.ZipFile(partition.path) as z:
                names = {Path(n).suffix.lower(): n for n in z.namelist()}
                shp, dbf = z.read(names[".shp"]), z.read(names[".dbf"])
                code = projection_code(z.read(names[".prj"]).decode("utf-8", "replace")) if ".prj" in names else None
        else:
            stem = Path(partition.path)
            shp, dbf = stem.read_bytes(), stem.with_suffix(".dbf").read_bytes()
            code = projection_code(stem.with_suffix(".prj").read_text("utf-8", "replace")) if stem.with_suffix(".prj").exists() else None
        for i, ((kind, parts), row) in enumerate(zip(shape_records(shp), table_rows(dbf), strict=False)):
            if kind is not None:
                yield partition.path, i, kind, json.dumps(parts), row, code


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer = options["path"], options.get("layer")

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path, (".gpkg",))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            layers = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
            columns = [c[1] for c in db.execute("PRAGMA table_info(gpkg_geometry_columns)")]
            systems = dict(db.execute("SELECT table_name, srs_id FROM gpkg_geometry_columns").fetchall()) if "srs_id" in columns else {}
            if not layers or (self.layer and self.layer not in layers):
                raise ValueError(f"no geometry layer {self.layer or ''} in {partition.path}")
            layer = self.layer or next(iter(layers))
            code = systems[layer] if systems.get(layer, 0) > 0 else None  # 0 and -1 are undefined systems
            found = db.execute(f'SELECT * FROM "{layer}"')
            names = [c[0] for c in found.description]
            for i, values in enumerate(found):
                row = dict(zip(names, values, strict=True))
                blob = row.pop(layers[layer])
                kind, parts = blob_geometry(blob) if blob else (None, [])
                if kind is not None and parts:
                    yield partition.path, i, kind, json.dumps(parts), {k: None if v is None else str(v) for k, v in row.items() if k != "_fid"}, code


class ShapefileSource(DataSource):
    """``spark.read.format("shapes").load(path)``: a file, a zip or a folder of them, a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


class PackageSource(DataSource):
    """``spark.read.format("geopackage").option("layer", name).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PackageReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(PackageSource)


