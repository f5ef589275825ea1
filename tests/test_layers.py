"""Vector layers, regions, rasters and elevations: round trips, errors and brute force."""

from __future__ import annotations

import io
import json
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.operators import raster
from terralane.operators.graph import components
from terralane.sources import elevation, geojson, geotiff, maps, regions, shapes, vector

POINT = {"type": "Point", "coordinates": [-74.1, 41.9]}
LINE = {"type": "LineString", "coordinates": [[-74.1, 41.9], [-74.0, 41.95], [-73.9, 41.9]]}
MULTI = {"type": "MultiLineString", "coordinates": [[[-74.1, 41.9], [-74.0, 41.95]], [[-73.95, 41.9], [-73.9, 41.92]]]}
POLYGON = {"type": "Polygon", "coordinates": [[[-74.2, 41.8], [-73.8, 41.8], [-73.8, 42.0], [-74.2, 42.0], [-74.2, 41.8]], [[-74.05, 41.85], [-74.0, 41.85], [-74.0, 41.9], [-74.05, 41.85]]]}
GROUP = {"type": "GeometryCollection", "geometries": [LINE, POINT]}


def write_collection(path, features, **more):
    path.write_text(json.dumps({"type": "FeatureCollection", **more, "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}))
    return str(path)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture
def mixed(tmp_path):
    rows = [({"id": 1, "name": "a", "code": "036", "v": 1.5, "yes": True}, POINT), ({"id": 2, "name": None, "code": "7", "v": 2, "yes": False}, LINE), ({"id": 3, "name": 'q"<é>'}, MULTI), ({"id": 4}, POLYGON), ({"id": 5}, GROUP), ({"id": 6}, None)]
    return write_collection(tmp_path / "a.geojson", rows)


def test_geojson_layer(spark, mixed):
    df = vector.read_vector(spark, mixed)
    assert dict(df.dtypes) | {"parts": ""} == {"row": "bigint", "geometry_type": "string", "parts": "", "epsg": "int", "code": "string", "id": "bigint", "name": "string", "v": "double", "yes": "boolean"}
    got = {r["id"]: r for r in df.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1]["code"] == "036" and got[1]["epsg"] == 4326
    assert [len(p) for p in got[4]["parts"]] == [5, 4] and [len(p) for p in got[5]["parts"]] == [3, 1] and len(got[3]["parts"]) == 2


@pytest.mark.parametrize("name", ["b.geojson", "b.gpkg", "b.anything", "b.parquet"])
def test_layers_round_trip(spark, mixed, tmp_path, name):
    df = vector.read_vector(spark, mixed).where("id < 5")
    path = vector.write_vector(df, f"{tmp_path}/{name}")
    assert path.endswith("b.gpkg" if name == "b.anything" else name)
    again = vector.read_vector(spark, path)
    columns = ["id", "name", "code", "v", "geometry_type", "parts"]
    assert plain(again, *columns) == plain(df, *columns)


def test_csv_has_well_known_text(spark, mixed, tmp_path):
    vector.write_vector(vector.read_vector(spark, mixed), f"{tmp_path}/c.csv")
    found = {r["id"]: r["geometry_wkt"] for r in spark.read.csv(f"{tmp_path}/c.csv", header=True).collect()}
    assert found["1"] == "POINT (-74.1 41.9)" and found["2"].startswith("LINESTRING (-74.1 41.9, ") and found["3"].count("(") == 3 and found["4"].startswith("POLYGON ((")


def test_layer_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        vector.read_vector(spark, f"{tmp_path}/none.geojson")
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    with pytest.raises(ValueError, match="no geometry"):
        vector.read_vector(spark, f"{tmp_path}/t.parquet")
    bad = write_collection(tmp_path / "crs.geojson", [({}, POINT)], crs={"type": "name", "properties": {"name": "local"}})
    with pytest.raises(ValueError, match="no coordinate system"):
        vector.read_vector(spark, bad)
    utm = write_collection(tmp_path / "utm.geojson", [({}, {"type": "Point", "coordinates": [580000.0, 4640000.0]})], crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::26918"}})
    layer = vector.read_vector(spark, utm)
    assert vector.to_metres(layer)[1] == 18 and abs(vector.points(vector.to_lon_lat(layer)).first()["x"] + 74.03) < 0.02
    with pytest.raises(ValueError, match="unsupported"):
        vector.zone_of(3857)
    empty = write_collection(tmp_path / "e.geojson", [({}, None)])
    assert vector.read_vector(spark, empty).count() == 0


def test_shapes_know_their_system(spark, tmp_path):
    body = struct.pack("<i2d", 1, 3.0, 4.0)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 1, 65, 5) + b"\0" * 20 + field + b"\r" + b" Main")
    with pytest.raises(ValueError, match="no coordinate system"):
        vector.read_vector(spark, f"{tmp_path}/a.shp")
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]]')
    assert plain(vector.read_vector(spark, f"{tmp_path}/a.shp"), "NAME", "epsg") == [("Main", 4269)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for s in ("shp", "dbf", "prj"):
            z.write(tmp_path / f"a.{s}", f"in/a.{s}")
    assert vector.read_vector(spark, f"{tmp_path}/z.zip").count() == 1
    assert shapes.projection_code('PROJCS["NAD_1983_UTM_Zone_18N",GEOGCS["GCS_North_American_1983"]]') == 26918
    assert shapes.projection_code('PROJCS["WGS 84 / UTM zone 18N",GEOGCS["WGS 84"]]') == 32618
    with pytest.raises(ValueError):
        shapes.projection_code('PROJCS["State_Plane"]')


# --- Regions ---

L_SHAPE = [(0, 0, 10, 0), (10, 0, 10, 4), (10, 4, 4, 4), (4, 4, 4, 10), (4, 10, 0, 10), (0, 10, 0, 0)]


def _inside(x, y):
    return (0 <= x <= 10 and 0 <= y <= 4) or (0 <= x <= 4 and 0 <= y <= 10)


def test_lines_are_cut_to_a_boundary(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, *(rng.uniform(-3, 13) for _ in range(4))) for i in range(60)]
    rows += [(100, 0, 0, 0.0, 0.0, 10.0, 0.0), (101, 0, 0, -5.0, 5.0, 15.0, 5.0), (102, 0, 0, 20.0, 20.0, 30.0, 30.0), (103, 0, 0, 1.0, 1.0, 2.0, 2.0), (103, 0, 1, 2.0, 2.0, 20.0, 2.0), (103, 0, 2, 20.0, 2.0, 5.0, 3.0)]
    got = regions.lines_within(spark.createDataFrame(rows, "line long, part int, seg int, x1 double, y1 double, x2 double, y2 double"), L_SHAPE)
    lengths = {r["line"]: r["l"] for r in got.groupBy("line").agg(F.sum("length").alias("l")).collect()}
    for i, _, _, x1, y1, x2, y2 in rows[:60]:
        n = 20_000
        share = sum(_inside(x1 + (k + 0.5) / n * (x2 - x1), y1 + (k + 0.5) / n * (y2 - y1)) for k in range(n)) / n
        assert lengths.get(i, 0.0) == pytest.approx(share * math.hypot(x2 - x1, y2 - y1), abs=0.01)
    assert lengths[100] == pytest.approx(10) and lengths[101] == pytest.approx(4) and 102 not in lengths
    parts = {(r["part"], r["seg"]): r for r in got.where("line = 103").collect()}
    assert set(parts) == {(0, 0), (0, 1), (1, 0)} and parts[0, 1]["m0"] == pytest.approx(math.sqrt(2)) and parts[0, 1]["x2"] == 10


def test_tiles_that_meet_a_boundary(spark):
    boxes = [(i, x, y, x + 1.0, y + 1.0) for i, (x, y) in enumerate((a, b) for a in (-3.0, 0.5, 3.5, 6.0, 11.0) for b in (-3.0, 0.5, 3.5, 6.0, 11.0))]
    boxes += [(90, -50.0, -50.0, 50.0, 50.0), (91, 10.0, 0.0, 11.0, 1.0)]
    got = {r["tile"] for r in maps.tiles_meeting(spark.createDataFrame(boxes, "tile int, west double, south double, east double, north double"), L_SHAPE).collect()}
    meets = lambda w, s, e, n: any(_inside(min(max(px, w), e), min(max(py, s), n)) for px in np.linspace(w, e, 21) for py in np.linspace(s, n, 21)) or (w <= 0 and s <= 0 and e >= 10 and n >= 10)
    assert got == {b[0] for b in boxes if meets(*b[1:])} and 91 in got


def test_filter_to_region(spark, mixed, tmp_path):
    df = vector.read_vector(spark, mixed)
    assert plain(regions.filter_to_region(df, vector.edges(df.where("id = 4"))), "id") == [(1,), (2,), (3,), (4,), (5,)]
    box = [(-74.05, 41.0, -73.0, 41.0), (-73.0, 41.0, -73.0, 43.0), (-73.0, 43.0, -74.05, 43.0), (-74.05, 43.0, -74.05, 41.0)]
    cut = {r["id"]: r for r in regions.filter_to_region(df, box).collect()}
    assert set(cut) == {2, 3, 4, 5} and min(p["x"] for p in cut[2]["parts"][0]) == pytest.approx(-74.05)
    assert len(regions.filter_to_region(df, box, clip=False).where("id = 2").first()["parts"][0]) == 3
    assert regions.filter_to_region(df, []).count() == 0
    path = regions.write_boundary(spark, f"{tmp_path}/r.geojson")
    assert plain(vector.read_vector(spark, path), "region_key") == [("ulster_poughkeepsie",)]
    got = regions.points_within(spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 5.0), (3, 4.0, 10.0)], "i int, longitude double, latitude double"), L_SHAPE)
    assert plain(got, "i") == [(1,), (3,)]


# --- Map server and census ---


def test_map_server_scan(spark, tmp_path):
    boundary = vector.read_vector(spark, write_collection(tmp_path / "b.geojson", [({"STATEFP": "36"}, POLYGON)]))

    def ask(url, query, timeout):
        if "highway" not in query:
            return json.dumps({"elements": []})
        way = {"type": "way", "id": 5, "tags": {"highway": "living_street"}, "geometry": [{"lat": 41.9, "lon": -74.5}, {"lat": 41.9, "lon": -73.5}]}
        return json.dumps({"elements": [way, {"type": "way", "id": 6, "geometry": [{"lat": 50.0, "lon": 1.0}, {"lat": 50.1, "lon": 1.0}]}]})

    found = maps.scan_server(spark, boundary, "highway", maps.ROAD_TAGS, ask=ask)
    rows = maps.server_roads(found).collect()
    assert [r["osm_id"] for r in rows] == [5] and rows[0]["highway"] == "living_street"
    xs = [p["x"] for part in rows[0]["parts"] for p in part]
    assert min(xs) == pytest.approx(-74.2) and max(xs) == pytest.approx(-73.8)
    assert "road" in maps.ROAD_TAGS.split("|") and "living_street" in maps.ROAD_TAGS


def test_census_addresses():
    urls = maps.census_urls(2024, "36111")
    assert urls["roads"].endswith("/TIGER2024/ROADS/tl_2024_36111_roads.zip") and urls["counties"].endswith("tl_2024_us_county.zip")


def zipped_shapes(kind: int, rows: list[tuple[dict, list]]) -> bytes:
    """A zipped shapefile of lines (3) or polygons (5) of one part, with text attributes."""
    records, names = b"", list(rows[0][0])
    for i, (_, points) in enumerate(rows, 1):
        body = struct.pack("<i4d2ii", kind, 0, 0, 0, 0, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2i", i, len(body) // 2) + body
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20]) + b"\0" * 15 for n in names)
    table = struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 33 + 32 * len(names), 1 + 20 * len(names)) + b"\0" * 20 + fields + b"\r" + b"".join(b" " + b"".join(str(a[n]).encode().ljust(20) for n in names) for a, _ in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("t.shp", b"\0" * 100 + records)
        z.writestr("t.dbf", table)
        z.writestr("t.prj", 'GEOGCS["GCS_North_American_1983"]')
    return out.getvalue()


def test_census_and_server_downloads(spark, tmp_path):
    """Through a stand-in for the network: each file is asked for once, then taken from the folder."""
    ring = [(-74.2, 41.8), (-73.8, 41.8), (-73.8, 42.0), (-74.2, 42.0), (-74.2, 41.8)]
    counties = zipped_shapes(5, [({"STATEFP": "36", "COUNTYFP": "111", "NAME": "Here", "GEOID": "36111"}, ring), ({"STATEFP": "36", "COUNTYFP": "001", "NAME": "There", "GEOID": "36001"}, ring)])
    lines = zipped_shapes(3, [({"LINEARID": "1", "FULLNAME": "Main St", "MTFCC": "S1200"}, [(-74.1, 41.9), (-73.9, 41.9)]), ({"LINEARID": "2", "FULLNAME": "", "MTFCC": "S1400"}, [(-74.0, 41.85), (-74.0, 41.95)])])
    asked = []

    def opener(url, timeout):
        asked.append(url)
        return io.BytesIO(counties if "county" in url else lines)

    for _ in range(2):
        found = maps.fetch_census(spark, f"{tmp_path}/census", "36", "111", opener=opener)
        assert plain(found["roads"], "id", "name", "highway") == [("1", "Main St", "S1200"), ("2", "2", "S1400")] and plain(found["boundary"], "NAME") == [("Here",)]
        assert found["streams"].select("stream_order").distinct().first()[0] == 1
    assert len(asked) == 3
    with pytest.raises(ValueError, match="no county"):
        maps.county_boundary(spark, f"{tmp_path}/counties", "36", "999", opener=opener)
    way = {"type": "way", "id": 5, "tags": {"highway": "primary", "waterway": "stream"}, "geometry": [{"lat": 41.9, "lon": -74.5}, {"lat": 41.9, "lon": -73.5}]}
    got = maps.fetch_server(spark, f"{tmp_path}/counties", "36", "111", opener=opener, ask=lambda u, q, t: json.dumps({"elements": [way]}))
    assert got["roads"].count() == got["streams"].count() == 1 and got["boundary"].first()["GEOID"] in (36111, "36111")
    with pytest.raises(ValueError, match="no roads"):
        maps.fetch_server(spark, f"{tmp_path}/counties", "36", "111", opener=opener, ask=lambda u, q, t: '{"elements": []}')


# --- JSON lines ---


def test_json_lines_count_in_each_file(spark, tmp_path):
    for name, n in (("a", 30), ("b", 40)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"v": {i}, "pad": "{"x" * 40}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # several parts a file
    try:
        got = geojson.read_jsonl(spark, str(tmp_path), "v int").collect()
        want = sorted((i + (i - 1) // 7, i) for n in (30, 40) for i in range(1, n + 1))
        assert sorted((r["line_no"], r["v"]) for r in got) == want
        (tmp_path / "b.jsonl").write_text((tmp_path / "b.jsonl").read_text() + "{bad\n")
        with pytest.raises(ValueError, match="b.jsonl:46"):
            geojson.read_jsonl(spark, str(tmp_path), "v int")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- Rasters ---


def lzw(data: bytes) -> bytes:
    """A plain encoder, for the decoder's sake."""
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> bits - 8 & 255)
            bits -= 8
        held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    put(256, 9)
    size, prior = 258, b""
    for b in data:
        both = prior + bytes([b])
        if both in table:
            prior = both
            continue
        put(table[prior], min(12, (size).bit_length()))
        table[both] = size
        size += 1
        if size == 4095:
            put(256, 12)
            table, size = {bytes([i]): i for i in range(256)}, 258
        prior = bytes([b])
    if prior:
        put(table[prior], min(12, size.bit_length()))
        size += 1
    put(257, min(12, size.bit_length()))
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def tiff(values: np.ndarray, compression: int, predictor: int, tile: int | None, order: str) -> bytes:
    height, width = values.shape
    kind = values.dtype.newbyteorder(order)
    step_r, step_c = (tile, tile) if tile else (7, width)
    blocks = []
    for r in range(0, height, step_r):
        for c in range(0, width, step_c):
            part = values[r : r + step_r, c : c + step_c]
            if tile:
                full = np.zeros((tile, tile), values.dtype)
                full[: part.shape[0], : part.shape[1]] = part
                part = full
            if predictor == 3:
                raw = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(part.shape[0], part.shape[1], -1).transpose(0, 2, 1).reshape(part.shape[0], -1)
                data = np.diff(raw, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            elif predictor == 2:
                data = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(kind).tobytes()
            else:
                data = part.astype(kind).tobytes()
            blocks.append(lzw(data) if compression == 5 else zlib.compress(data) if compression == 8 else data)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for b in blocks:
        places.append(len(out))
        out += b
    sizes = [len(b) for b in blocks]
    fmt = 3 if values.dtype.kind == "f" else 2 if values.dtype.kind == "i" else 1
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [fmt])]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [7]), (279, 4, sizes)]
    tags += [(33550, 12, [30.0, 30.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 577_800.0, 4_623_600.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32618]), (42113, 2, b"-9999\0")]
    entries = b""
    for tag, k, v in sorted(tags, key=lambda t: t[0]):
        raw = v if k == 2 else struct.pack(order + geotiff.FIELD[k] * len(v), *v)
        if len(raw) > 4:
            at = len(out)
            out += raw
            raw = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
    at = len(out)
    out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)
    out[4:8] = struct.pack(order + "I", at)
    return bytes(out)


@pytest.mark.parametrize(("dtype", "compression", "predictor", "tile", "order"), [("f4", 1, 1, None, "<"), ("f4", 8, 3, 16, "<"), ("i2", 8, 2, 16, ">"), ("f4", 5, 1, 16, "<"), ("i4", 5, 2, None, ">"), ("u1", 1, 1, 32, "<"), ("f8", 8, 1, None, "<")])
def test_geotiff_is_read(spark, tmp_path, dtype, compression, predictor, tile, order):
    rng = np.random.RandomState(3)
    values = (rng.randint(0, 200, (45, 38)) + (rng.rand(45, 38) if dtype[0] == "f" else 0)).astype(dtype)
    if dtype[0] in "fi":
        values[3, 4] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(values, compression, predictor, tile, order))
    cells, grid, epsg = geotiff.open_raster(spark, f"{tmp_path}/a.tif")
    assert (grid, epsg) == (raster.Grid(577_800.0, 4_623_600.0, 30.0, 30.0, 45, 38), 32618)
    got = {(r["row"], r["col"]): r["v"] for r in cells.collect()}
    assert got == {(r, c): None if values[r, c] == -9999 else float(values[r, c]) for r in range(45) for c in range(38)}


def test_geotiff_round_trip_and_errors(spark, tmp_path):
    cells = spark.range(100 * 30).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.when(F.col("id") % 11 != 0, F.col("id").cast("double")).alias("v"))
    grid = raster.Grid(-74.0, 42.0, 0.001, 0.002, 100, 30)
    path = geotiff.write_raster(cells.where("row % 70 != 5"), grid, 4326, f"{tmp_path}/o.tif")
    again, g, epsg = geotiff.open_raster(spark, path)
    assert (g, epsg) == (grid, 4326)
    want = {(r["row"], r["col"]): r["v"] if r["row"] % 70 != 5 else None for r in cells.collect()}
    assert {(r["row"], r["col"]): r["v"] for r in again.collect()} == want
    with pytest.raises(FileNotFoundError):
        geotiff.open_raster(spark, f"{tmp_path}/none.tif")
    (tmp_path / "x.tif").write_bytes(b"not a raster")
    with pytest.raises(ValueError):
        geotiff.read_header(f"{tmp_path}/x.tif")


def test_windows_equal_brute_force(spark, monkeypatch):
    """All four windows, over tile borders, edges and holes."""
    monkeypatch.setattr(raster, "TILE", 20)
    rng = np.random.RandomState(4)
    v = rng.rand(70, 65) * 100
    v[rng.rand(70, 65) < 0.0008] = np.nan
    cells = spark.createDataFrame([(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(70) for c in range(65)], "row int, col int, v double")
    grid = raster.Grid(1000.0, 5000.0, 10.0, 20.0, 70, 65)
    places = [(i, 1000 + 10 * float(rng.uniform(-2, 67)), 5000 - 20 * float(rng.uniform(-2, 72))) for i in range(150)] + [(900, None, 4500.0)]
    points = spark.createDataFrame(places, "row long, x double, y double")
    got = {r["row"]: r for r in raster.window_stats(points, cells, grid, "row").collect()}
    assert len(got) == 151
    seen = 0
    for i, x, y in places[:-1]:
        r, c = math.floor((5000 - y) / 20), math.floor((x - 1000) / 10)
        for n in (3, 9, 15, 31):
            h = n // 2
            w = v[r - h : r + h + 1, c - h : c + h + 1] if min(r - h, c - h) >= 0 else np.zeros((0, 0))
            names = raster._window_kinds(n)
            if w.shape != (n, n) or np.isnan(w).any():
                assert all(got[i][k] is None for k in names)
                continue
            seen += 1
            tpi = v[r, c] - w.mean()
            assert [got[i][k] for k in names] == pytest.approx([w.mean(), w.max() - w.min(), w.std(), tpi, max(0.0, -tpi)])
            if n == 3:
                slope = math.degrees(math.atan(math.hypot((w[2, 1] - w[0, 1]) / 40, (w[1, 2] - w[1, 0]) / 20)))
                assert got[i]["slope_degrees"] == pytest.approx(slope)
    assert seen > 150 and all(got[900][k] is None for k in raster._window_kinds(3))


def test_elevation_is_merged_and_cropped(spark, tmp_path):
    """Two tiles of one degree each, fetched through a stand-in for the archive."""
    asked = []

    def opener(url, timeout):
        asked.append(url)
        tile = url.rsplit("_", 1)[-1].removesuffix(".tif")
        lat, lon = int(tile[1:3]), -int(tile[4:7])
        cells = spark.range(20 * 20).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit(float(-lon)).alias("v"))
        path = geotiff.write_raster(cells, raster.Grid(lon, lat + 1, 0.05, 0.05, 20, 20), 4269, f"{tmp_path}/made/{tile}.tif")
        with open(path, "rb") as f:
            return io.BytesIO(f.read())

    ring = [[-74.1, 41.5], [-73.8, 41.5], [-73.8, 41.7], [-74.1, 41.5]]
    boundary = vector.read_vector(spark, write_collection(tmp_path / "b.geojson", [({}, {"type": "Polygon", "coordinates": [ring]})]))
    done = elevation.fetch_elevation(spark, boundary, f"{tmp_path}/dem.tif", f"{tmp_path}/tiles", opener=opener)
    assert done["tiles"] == ["n41w075", "n41w074"] and (done["width"], done["height"]) == (6, 4) and len(asked) == 2
    cells, grid, _ = geotiff.open_raster(spark, done["dem"])
    assert grid.x0 == pytest.approx(-74.1) and grid.y0 == pytest.approx(41.7)
    assert {(r["col"], r["v"]) for r in cells.collect()} == {(0, 75.0), (1, 75.0), *((c, 74.0) for c in range(2, 6))}
    assert elevation.fetch_elevation(spark, boundary, f"{tmp_path}/dem.tif", f"{tmp_path}/tiles", opener=opener)["skipped"] and len(asked) == 2
    assert json.loads((tmp_path / "dem_metadata.json").read_text())["tiles"] == done["tiles"]


# --- Components ---


@pytest.mark.parametrize("sent", [200_000, 0])
def test_components_with_hubs(spark, monkeypatch, sent):
    from terralane.operators import graph

    monkeypatch.setattr(graph, "HUB_LINKS", 20)
    monkeypatch.setattr(graph, "SENT_HUBS", sent)
    rng = random.Random(2)
    links = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2060)] + [(1399, 2000), (7, 7), (None, 3), (8000, 8001)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    parent = {n: n for e in links if None not in e for n in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    linked = {n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
