"""GeoTIFF rasters as tables of cells, and back: a Spark data source with a partition for each run of blocks."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.raster import Grid

SCHEMA = "row int, col int, v double"
#: Cells that a partition reads at most, but for a single larger block.
CELLS_PER_PARTITION = 4_000_000
# Tags, field sizes and geographic keys of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass(frozen=True)
class Header:
    grid: Grid
    epsg: int | None
    dtype: str
    compression: int
    predictor: int
    no_data: float | None
    block: tuple[int, int]  # rows and columns of a block
    blocks: tuple[tuple[int, int, int, int], ...]  # place and size in the file, first row and column

    def shape(self, row: int, col: int) -> tuple[int, int]:
        """Rows and columns of the block as stored; only the last strip is cut."""
        tiled = self.block[1] != self.grid.width
        return (self.block[0] if tiled else min(self.block[0], self.grid.height - row), self.block[1])


def read_header(path: str) -> Header:
    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
            raise ValueError(f"not a TIFF file: {path}")
        f.seek(struct.unpack(order + "I", start[4:])[0])
        (count,) = struct.unpack(order + "H", f.read(2))
        entries, tags = f.read(12 * count), {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
            if kind not in FIELD:
                continue
            size = struct.calcsize("<" + FIELD[kind]) * n
            raw = entries[12 * i + 8 : 12 * i + 12]
            if size > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size)
            tags[tag] = raw[:size].rstrip(b"\0").decode("ascii") if kind == 2 else struct.unpack(order + FIELD[kind] * n, raw[:size])
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"a raster has one band: {path}")
    if PIXEL_SCALE not in tags or TIE_POINT not in tags:
        raise ValueError(f"the raster says not where it lies: {path}")
    height, width = tags[HEIGHT][0], tags[WIDTH][0]
    col, row, _, x, y, _ = tags[TIE_POINT][:6]
    xres, yres = tags[PIXEL_SCALE][:2]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = next((codes[k] for k in (PROJECTED_KEY, GEOGRAPHIC_KEY) if 0 < codes.get(k, 0) < 32767), None)
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
    if TILES in tags:
        block, places, sizes = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]), tags[TILES], tags[TILE_BYTES]
    else:
        block, places, sizes = (min(tags.get(ROWS_PER_STRIP, (height,))[0], height), width), tags[STRIPS], tags[STRIP_BYTES]
    across = -(-width // block[1])
    blocks = tuple((p, n, i // across * block[0], i % across * block[1]) for i, (p, n) in enumerate(zip(places, sizes, strict=True)))
    no_data = float(tags[NO_DATA]) if tags.get(NO_DATA, "").strip() else None
    compression = tags.get(COMPRESSION, (NONE,))[0]
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"unsupported compression {compression}: {path}")
    return Header(Grid(x - col * xres, y + row * yres, xres, yres, height, width), epsg, f"{order}{kind}{tags[BITS][0] // 8}", compression, tags.get(PREDICTOR, (1,))[0], no_data, block, blocks)


def unpacked(data: bytes) -> bytes:
    """Bytes of an LZW run: codes of 9 to 12 bits, highest bit first, with 256 to start anew and 257 at the end."""
    table, out, prior = [bytes([i]) for i in range(256)] + [b"", b""], [], b""
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            prior, width = b"", 9
            continue
        if not prior:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prior + prior[:1]
            table.append(prior + entry[:1])
        out.append(entry)
        prior = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def block_values(h: Header, data: bytes, row: int, col: int) -> np.ndarray:
    """A block's values, null as NaN, cut to the raster."""
    rows, cols = h.shape(row, col)
    if h.compression == LZW:
        data = unpacked(data)
    elif h.compression != NONE:
        data = zlib.decompress(data)
    kind = np.dtype(h.dtype)
    if h.predictor == 3:  # bytes of the values by significance, each row a running sum
        flat = np.cumsum(np.frombuffer(data, np.uint8)[: rows * cols * kind.itemsize].reshape(rows, -1), axis=1, dtype=np.uint8)
        v = np.ascontiguousarray(flat.reshape(rows, kind.itemsize, cols).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols)
    else:
        v = np.frombuffer(data, kind)[: rows * cols].reshape(rows, cols)
        if h.predictor == 2:
            v = np.cumsum(v, axis=1, dtype=kind.newbyteorder("="))
    v = v[: h.grid.height - row, : h.grid.width - col].astype(np.float64)
    return v if h.no_data is None else np.where(v == h.no_data, np.nan, v)


class _Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        h = read_header(self.path)
        step = max(1, CELLS_PER_PARTITION // (h.block[0] * h.block[1]))
        return [_Blocks(i, min(i + step, len(h.blocks))) for i in range(0, len(h.blocks), step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        h = read_header(self.path)
        with open(self.path, "rb") as f:
            for place, size, row, col in h.blocks[partition.first : partition.last]:
                f.seek(place)
                v = block_values(h, f.read(size), row, col)
                rows, cols = np.indices(v.shape, np.int32)
                flat = v.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(rows.reshape(-1) + np.int32(row)), pa.array(cols.reshape(-1) + np.int32(col)), pa.array(flat, mask=np.isnan(flat))], ["row", "col", "v"])


class RasterSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: row, col, v of a one-band file, null without data."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)


def open_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid, int]:
    """(cells, grid, coordinate system) of a file; a missing file and one without a coordinate system are errors."""
    if not os.path.exists(path.removeprefix("file://")):
        raise FileNotFoundError(f"no raster file at {path}")
    h = read_header(path)
    if h.epsg is None:
        raise ValueError(f"no coordinate system in {path}")
    spark.dataSource.register(RasterSource)
    return spark.read.format("geotiff").load(path), h.grid, h.epsg


def write_raster(cells: DataFrame, grid: Grid, epsg: int, path: str, no_data: float = -9999.0, rows_per_strip: int = 64) -> str:
    """Write cells as a file of deflated strips of 32-bit floats.  It is one file by its nature: a strip at a time passes the driver."""
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part, places, sizes = f"{path}.{uuid.uuid4().hex}.part", [], []
    strips = -(-grid.height // rows_per_strip)
    geographic = epsg in (4326, 4269)

    def of(strip: int, found: list) -> bytes:
        n = min(rows_per_strip, grid.height - strip * rows_per_strip)
        v = np.full((n, grid.width), no_data, "<f4")
        for r, c, x in found:
            v[r - strip * rows_per_strip, c] = no_data if x is None else x
        return zlib.compress(v.tobytes())

    with open(part, "wb") as out:
        out.write(b"II" + struct.pack("<HI", 42, 0))
        rows = cells.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).select("row", "col", "v").orderBy("row")
        held, strip = [], 0

        def finish(upto: int) -> None:
            nonlocal strip, held
            while strip < upto:
                data = of(strip, held)
                places.append(out.tell())
                sizes.append(len(data))
                out.write(data)
                held, strip = [], strip + 1

        for r in rows.toLocalIterator():
            finish(r["row"] // rows_per_strip)
            held.append((r["row"], r["col"], r["v"]))
        finish(strips)
        keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, epsg)
        text = f"{no_data:g}".encode() + b"\0"
        tags = [
            (WIDTH, 4, (grid.width,)), (HEIGHT, 4, (grid.height,)), (BITS, 3, (32,)), (COMPRESSION, 3, (DEFLATE,)), (262, 3, (1,)), (STRIPS, 4, places), (SAMPLES, 3, (1,)), (ROWS_PER_STRIP, 4, (rows_per_strip,)),
            (STRIP_BYTES, 4, sizes), (SAMPLE_FORMAT, 3, (3,)), (PIXEL_SCALE, 12, (grid.xres, grid.yres, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0)), (GEO_KEYS, 3, keys), (NO_DATA, 2, text),
        ]
        entries = []
        for tag, kind, values in tags:
            raw = values if kind == 2 else struct.pack("<" + FIELD[kind] * len(values), *values)
            if len(raw) > 4:
                at = out.tell()
                out.write(raw)
                raw = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        at = out.tell()
        out.write(struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0))
        out.seek(4)
        out.write(struct.pack("<I", at))
    os.replace(part, path)
    return path
