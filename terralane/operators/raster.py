"""Rasters as tables of cells, sampled and summarised around points.

A raster is a table (row, col, v) with null for no data, and a :class:`Grid` that says where its cells lie.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import WINDOWS


@dataclass(frozen=True)
class Grid:
    """North-up cells: x0, y0 is the upper left corner, sizes are positive."""

    x0: float
    y0: float
    xres: float
    yres: float
    height: int
    width: int

    def row(self, y: Column) -> Column:
        return F.floor((self.y0 - y) / self.yres).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.xres).cast("int")


def sample(points: DataFrame, cells: DataFrame, grid: Grid, name: str) -> DataFrame:
    """Add the value of the cell a point lies in; null outside or without data."""
    at = points.withColumns({"_r": grid.row(F.col("y")), "_c": grid.col(F.col("x"))})
    return at.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias(name)), ["_r", "_c"], "left").drop("_r", "_c")


#: Rows and columns of the square of cells that one task looks at for the points in it.
TILE = 256


def _window_kinds(n: int) -> list[str]:
    return [f"elevation_mean_{n}x{n}_m", f"elevation_relief_{n}x{n}_m", f"terrain_roughness_{n}x{n}_m", f"topographic_position_{n}x{n}_m", f"valley_depth_{n}x{n}_m"]


def window_stats(points: DataFrame, cells: DataFrame, grid: Grid, row_id: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Add, for each window of n x n cells around a point's cell, mean, relief, roughness, position and valley depth, and slope.

    Cells go to the square tile they lie in and, near its border, to the neighbours too; a tile and its halo become one array,
    and all its spots are looked up at once.  Only tiles that hold points are made, and of points that share a cell one.  A
    window over the edge of the raster or with a missing cell gives nulls.
    """
    at = points.withColumns({"_r": grid.row(F.col("y")), "_c": grid.col(F.col("x"))})
    half = max(windows) // 2
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    spots = at.select("_r", "_c").where("_r is not null and _c is not null").distinct().withColumns({"tr": tile("_r"), "tc": tile("_c")})
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / TILE).cast("int"), F.floor((F.col(c) + half) / TILE).cast("int")))
    dealt = cells.where("v is not null").select("row", "col", F.col("v").cast("double").alias("v"), reach("row").alias("tr")).select("*", reach("col").alias("tc"))
    dealt = dealt.join(spots.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    names = [k for n in windows for k in _window_kinds(n)] + (["slope_degrees"] if 3 in windows else [])
    side, yres, xres = TILE + 2 * half, grid.yres, grid.xres

    def look(here: pa.Table, around: pa.Table) -> pa.Table:
        r, c = (np.asarray(here[k]) for k in ("_r", "_c"))
        out: dict[str, np.ndarray] = {k: np.full(len(r), np.nan) for k in names}
        if len(r):
            top, left = (int(here[k][0].as_py()) * TILE - half for k in ("tr", "tc"))
            square = np.full((side, side), np.nan)
            square[np.asarray(around["row"]) - top, np.asarray(around["col"]) - left] = np.asarray(around["v"])
            r, c = r - top, c - left
            mid = square[r, c]
            for n in windows:
                h = n // 2
                view = np.lib.stride_tricks.sliding_window_view(square, (n, n))
                for a in range(0, len(r), 4096):
                    part = slice(a, a + 4096)
                    w = view[r[part] - h, c[part] - h].reshape(-1, n * n)
                    mean = w.mean(axis=1)  # NaN where a cell is missing, as are all that follow
                    tpi = mid[part] - mean
                    for k, v in zip(_window_kinds(n), (mean, w.max(axis=1) - w.min(axis=1), w.std(axis=1), tpi, np.maximum(0.0, -tpi)), strict=True):
                        out[k][part] = v
                    if n == 3:
                        dy, dx = (w[:, 7] - w[:, 1]) / (2 * yres), (w[:, 5] - w[:, 3]) / (2 * xres)
                        out["slope_degrees"][part] = np.where(np.isnan(mean), np.nan, np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))))
        return pa.table({"_r": here["_r"], "_c": here["_c"]} | {k: pa.array(v, mask=np.isnan(v)) for k, v in out.items()})

    schema = ", ".join(["_r int", "_c int", *(f"{k} double" for k in names)])
    stats = spots.groupBy("tr", "tc").cogroup(dealt.groupBy("tr", "tc")).applyInArrow(look, schema)
    kept = [c for c in points.columns if c not in names]
    return at.select(*kept, "_r", "_c").join(stats, ["_r", "_c"], "left").select(*kept, *names)


def crop(cells: DataFrame, grid: Grid, min_x: float, min_y: float, max_x: float, max_y: float) -> tuple[DataFrame, Grid]:
    """Cells whose area meets the bounds, numbered anew, and their grid."""
    r0, r1 = math.floor((grid.y0 - max_y) / grid.yres + 1e-9), math.ceil((grid.y0 - min_y) / grid.yres - 1e-9)
    c0, c1 = math.floor((min_x - grid.x0) / grid.xres + 1e-9), math.ceil((max_x - grid.x0) / grid.xres - 1e-9)
    r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, grid.height), min(c1, grid.width)
    kept = cells.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    return kept, Grid(grid.x0 + c0 * grid.xres, grid.y0 - r0 * grid.yres, grid.xres, grid.yres, max(r1 - r0, 0), max(c1 - c0, 0))


def merged(tiles: list[tuple[DataFrame, Grid]]) -> tuple[DataFrame, Grid]:
    """One raster of tiles with the same cell size whose cells are in line: the first tile with data wins."""
    first = tiles[0][1]
    x0, y0 = min(g.x0 for _, g in tiles), max(g.y0 for _, g in tiles)
    right, low = max(g.x0 + g.width * g.xres for _, g in tiles), min(g.y0 - g.height * g.yres for _, g in tiles)
    grid = Grid(x0, y0, first.xres, first.yres, round((y0 - low) / first.yres), round((right - x0) / first.xres))
    out = None
    for i, (cells, g) in enumerate(tiles):
        if not math.isclose(g.xres, first.xres, rel_tol=1e-9) or not math.isclose(g.yres, first.yres, rel_tol=1e-9):
            raise ValueError("tiles have cells of different sizes")
        moved = cells.select(F.lit(i).alias("tile_order"), (F.col("row") + round((y0 - g.y0) / first.yres)).alias("row"), (F.col("col") + round((g.x0 - x0) / first.xres)).alias("col"), "v")
        out = moved if out is None else out.unionByName(moved)
    return mosaic(out), grid


def tile_ids(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> list[str]:
    """One-degree tiles that cover the bounds, by latitude then longitude; an upper bound on a tile's border is not in the next."""
    rows = range(math.floor(min_lat), math.floor(max_lat - 1e-9) + 1)
    cols = range(math.floor(min_lon), math.floor(max_lon - 1e-9) + 1)
    return [tile_name(lat, lon) for lat in rows for lon in cols]


def tile_name(lat: int, lon: int) -> str:
    """A tile is named by its lower left corner: hemisphere and two digits of latitude, hemisphere and three of longitude."""
    return f"{'n' if lat >= 0 else 's'}{abs(lat):02d}{'e' if lon >= 0 else 'w'}{abs(lon):03d}"


def tile_url(tile: str, resolution: str = "1", base: str | None = None) -> str:
    """Where the public elevation archive keeps a tile."""
    root = (base or f"https://prd-tnm.s3.amazonaws.com/StagedProducts/Elevation/{resolution}/TIFF/current").rstrip("/")
    return f"{root}/{tile}/USGS_{resolution}_{tile}.tif"


def mosaic(tiles: DataFrame) -> DataFrame:
    """(row, col, v) of overlapping tiles (tile_order, row, col, v): the first tile with data wins."""
    return tiles.groupBy("row", "col").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("tile_order")).otherwise(F.lit(1 << 30))).alias("v"))
