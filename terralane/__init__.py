"""Spark-first ranking of field sites from road, stream, terrain and report data."""
