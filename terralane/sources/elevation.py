"""Elevation tiles of the public archive: chosen by bounds, fetched once, merged and cropped."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import to_utm
from ..operators import raster
from . import geotiff, regions, vector

BUFFER_DEGREES = 0.02


def bounds_in(spark: SparkSession, bounds: tuple[float, float, float, float], epsg: int) -> tuple[float, float, float, float]:
    """Bounds in longitude and latitude as those of their corners in another system."""
    zone = vector.zone_of(epsg)
    if zone is None:
        return bounds
    w, s, e, n = bounds
    x, y = to_utm(F.col("x"), F.col("y"), zone)
    corners = spark.createDataFrame([(w, s), (w, n), (e, s), (e, n)], "x double, y double").select(x.alias("x"), y.alias("y"))
    r = corners.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(r)


def fetch_elevation(spark: SparkSession, boundary: DataFrame, out: str, folder: str, resolution: str = "1", base: str | None = None, buffer: float = BUFFER_DEGREES, overwrite: bool = False, opener: Callable = urllib.request.urlopen) -> dict:
    """Write the elevations over a boundary layer as one GeoTIFF file, with a JSON file about it beside; nothing if it is there.

    Tiles are chosen by the boundary's bounds and a buffer; the file is cut to the bounds themselves.
    """
    about = f"{out.rsplit('.', 1)[0]}_metadata.json"
    if os.path.exists(out) and not overwrite:
        return {"dem": out, "metadata": about if os.path.exists(about) else None, "skipped": True}
    west, south, east, north = vector.extent(vector.to_lon_lat(boundary))
    b = max(0.0, buffer)
    tiles = raster.tile_ids(west - b, south - b, east + b, north + b)
    if not tiles:
        raise ValueError(f"no elevation tiles for the bounds {(west, south, east, north)}")
    urls = [raster.tile_url(t, resolution, base) for t in tiles]
    files = [regions.fetched(u, folder, opener=opener) for u in urls]
    opened = [geotiff.open_raster(spark, f) for f in files]
    epsg = opened[0][2]
    cells, grid = raster.merged([(c, g) for c, g, _ in opened])
    cells, grid = raster.crop(cells, grid, *bounds_in(spark, (west, south, east, north), epsg))
    geotiff.write_raster(cells, grid, epsg, out)
    found = {"resolution": resolution, "downloaded_at_unix": time.time(), "bounds_wgs84": [west - b, south - b, east + b, north + b], "tiles": tiles, "tile_paths": files, "tile_urls": urls, "dem": out, "crs": f"EPSG:{epsg}", "width": grid.width, "height": grid.height}
    vector.write_file(about, iter([json.dumps(found, indent=2)]))
    return {"dem": out, "metadata": about, "tiles": tiles, "tile_count": len(tiles), "width": grid.width, "height": grid.height}
