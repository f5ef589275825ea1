"""How well predictions find actual sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_or, number, text
from .spatial import grid_join, nearest


def threshold_evaluation(predictions: DataFrame, known: DataFrame, threshold: float = 0.7, radius: float = 30.0, row: str = "row", known_id: str = "known_row") -> DataFrame:
    """One row: predictions at the threshold, the share near a known site, and the share of known sites near one."""
    high = predictions.where(F.col("culvert_probability") >= threshold).select(row, "x", "y")
    pairs = grid_join(high, known.select(known_id, "x", "y"), radius)
    hits = pairs.agg(F.countDistinct(f"l_{row}").alias("p"), F.countDistinct(f"r_{known_id}").alias("k"))
    counts = high.agg(F.count("*").alias("high")).join(known.agg(F.count("*").alias("known")), F.lit(True)).join(hits, F.lit(True))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(F.col("high").alias("high_priority_predictions"), F.col("known").alias("known_culverts"), share("p", "high").alias("precision_at_threshold"), F.when(F.col("high") > 0, share("k", "known")).otherwise(0.0).alias("known_culvert_recall_at_threshold"))


def unknown_pool(df: DataFrame) -> DataFrame:
    """Without known matches and reported sites; a missing status or source stays."""
    if "discovery_status" in df.columns:
        df = df.where(~F.col("discovery_status").eqNullSafe("known_field_match"))
    if "source" in df.columns:
        df = df.where(~F.col("source").eqNullSafe("field_report_observed_culvert"))
    if "is_known_field_match" in df.columns:
        df = df.where(F.coalesce(number("is_known_field_match"), F.lit(0.0)).cast("long") != 1)
    return df


def success(predictions: DataFrame, actual: DataFrame, max_distance: float = 15.0, exclude_known: bool = True, rank_limit: int | None = None, row: str = "row", actual_row: str = "actual_row") -> DataFrame:
    """Per actual site its nearest prediction: actual_id, nearest_candidate_id, nearest_distance_m, hit."""
    pool = unknown_pool(predictions) if exclude_known else predictions
    if rank_limit and "discovery_rank" in pool.columns:
        pool = pool.where(number("discovery_rank") <= rank_limit)
    if pool.isEmpty() or actual.isEmpty():
        raise ValueError("no predictions or actual sites remain")
    near = nearest(actual, pool.select(row, "x", "y", "candidate_id"), actual_row, row)
    ids = [F.nullif(F.trim(text(col_or(near, f"l_{c}", ""))), F.lit("")) for c in ("culvert_id", "field_culvert_id", "observation_id", "candidate_id")]
    return near.select(F.col(f"l_{actual_row}").alias(actual_row), F.coalesce(*ids, F.col(f"l_{actual_row}").cast("string")).alias("actual_id"), F.col("r_candidate_id").alias("nearest_candidate_id"), F.col("d").alias("nearest_distance_m"), (F.col("d") <= max_distance).alias("hit"))


def success_summary(matches: DataFrame) -> DataFrame:
    hit = F.col("hit").cast("int")
    miss = F.when(~F.col("hit"), F.struct("actual_row", "actual_id", "nearest_candidate_id", "nearest_distance_m"))
    return matches.agg(F.count("*").alias("actual_culverts"), F.sum(hit).alias("hits_within_distance"), F.avg(hit).alias("success_rate"), F.avg("nearest_distance_m").alias("mean_nearest_distance_m"), F.array_sort(F.collect_list(miss)).alias("misses"))
