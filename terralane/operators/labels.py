"""Training labels from known sites and from crews' denials, with their ties broken in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_or, flag_is_one, number, text
from .spatial import grid_join, nearest

# Which kind of candidate a known site prefers, and how much a label weighs.
SOURCE_PRIORITY = {"field_report_observed_culvert": 0, "exact_road_stream_intersection": 1, "nearest_road_stream_approach": 2, "route_interval_sample": 3}
OTHER_PRIORITY = 5
WEIGHT_UNLABELED, WEIGHT_REPORT, WEIGHT_OBSERVED, WEIGHT_DENIED, WEIGHT_MISSED = 0.25, 6.0, 24.0, 12.0, 16.0
OBSERVATION_FILE, MISSED_NOTE = "field_observations.geojson", "confirmed culvert was"
METADATA = {"report_date": "nearest_field_report_date", "route": "nearest_field_report_route", "culvert_id": "nearest_field_report_culvert_id", "source_file": "nearest_field_report_source_file"}


def source_priority(df: DataFrame) -> Column:
    if "source" not in df.columns:
        return F.lit(OTHER_PRIORITY)
    out = F.lit(OTHER_PRIORITY)
    for name, rank in SOURCE_PRIORITY.items():
        out = F.when(F.col("source") == name, rank).otherwise(out)
    return out


def best_matches(candidates: DataFrame, known: DataFrame, radius: float, row: str = "row", known_id: str = "known_row") -> DataFrame:
    """(known_row, row, d): for each known site the candidate within ``radius`` that is first by distance, source and row."""
    pairs = grid_join(known.select(known_id, "x", "y"), candidates.select(row, "x", "y", source_priority(candidates).alias("prio")), radius)
    best = pairs.groupBy(F.col(f"l_{known_id}").alias(known_id)).agg(F.min(F.struct("d", "r_prio", f"r_{row}")).alias("b"))
    return best.select(known_id, F.col(f"b.r_{row}").alias(row), F.col("b.d").alias("d"))


def label_known(candidates: DataFrame, known: DataFrame, radius: float = 10.0, row: str = "row", known_id: str = "known_row") -> DataFrame:
    """Add dist_to_known_culvert_m, is_culvert (one candidate per known site) and the nearest known site's metadata."""
    kept = candidates.columns
    near = nearest(candidates.select(row, "x", "y"), known, row, known_id)
    meta = near.select(F.col(f"l_{row}").alias(row), F.col("d").alias("dist_to_known_culvert_m"), *[text(F.col(f"r_{c}") if c in known.columns else F.lit("")).alias(name) for c, name in METADATA.items()])
    chosen = best_matches(candidates, known, radius, row, known_id).select(row).distinct().withColumn("_hit", F.lit(1))
    return candidates.join(meta, row, "left").join(chosen, row, "left").select(*kept, "dist_to_known_culvert_m", F.coalesce("_hit", F.lit(0)).alias("is_culvert"), *METADATA.values())


def label_denied(candidates: DataFrame, negatives: DataFrame, radius: float = 10.0, row: str = "row", negative_id: str = "negative_row") -> DataFrame:
    """Add field_denied, dist_to_denied_culvert_m, nearest_denied_observation_id and _notes; a denied candidate is no positive.

    A negative that names the candidate counts at any distance, the last of several, and its miss_distance_m replaces the
    distance if it has one.  Else the nearest negative counts within ``radius`` unless it is a missed prediction.
    """
    base = candidates if "is_culvert" in candidates.columns else candidates.withColumn("is_culvert", F.lit(0))
    fields = {c: col_or(negatives, c) for c in ("candidate_id", "miss_distance_m", "label", "observation_id", "notes")}
    n = negatives.select(negative_id, "x", "y", *[text(v).alias(c) if c != "miss_distance_m" else number(v).alias(c) for c, v in fields.items()])
    near = nearest(base.select(row, "x", "y"), n, row, negative_id).select(F.col(f"l_{row}").alias(row), "d", F.trim("r_label").alias("_label"), F.col("r_observation_id").alias("_oid"), F.col("r_notes").alias("_notes"))
    named = n.where("candidate_id != ''").groupBy("candidate_id").agg(F.max_by(F.struct("observation_id", "notes", "miss_distance_m"), negative_id).alias("e"))
    key = text(col_or(base, "candidate_id", ""))
    out = base.withColumn("_cid", key).join(near, row, "left").join(named.withColumnRenamed("candidate_id", "_nid"), F.col("_cid") == F.col("_nid"), "left")
    exact = F.col("_nid").isNotNull()
    mark = F.coalesce(exact | ((F.col("d") <= radius) & (F.col("_label") != "missed_prediction")), F.lit(False))
    pick = lambda own, other: F.when(mark, F.when(exact, F.col(own)).otherwise(F.col(other))).otherwise("")
    return out.select(
        *[c for c in base.columns if c != "is_culvert"],
        F.when(mark, 0).otherwise(F.col("is_culvert")).alias("is_culvert"),
        mark.cast("int").alias("field_denied"),
        F.when(exact, F.coalesce("e.miss_distance_m", "d")).otherwise(F.col("d")).alias("dist_to_denied_culvert_m"),
        text(pick("e.observation_id", "_oid")).alias("nearest_denied_observation_id"),
        text(pick("e.notes", "_notes")).alias("nearest_denied_notes"),
    )


def sample_weights(df: DataFrame) -> DataFrame:
    """Add training_sample_weight: denials weigh over positives, positives from crews over those from reports, over the rest."""
    positive, denied = flag_is_one(df, "is_culvert"), flag_is_one(df, "field_denied")
    observed = F.lit(False)
    for c in ("field_report_source_file", "nearest_field_report_source_file"):
        if c in df.columns:
            observed = observed | F.contains(F.lower(text(c)), F.lit(OBSERVATION_FILE))
    missed = F.contains(F.lower(text("nearest_denied_notes")), F.lit(MISSED_NOTE)) if "nearest_denied_notes" in df.columns else F.lit(False)
    weight = F.when(denied & missed, WEIGHT_MISSED).when(denied, WEIGHT_DENIED).when(positive & observed, WEIGHT_OBSERVED).when(positive, WEIGHT_REPORT).otherwise(WEIGHT_UNLABELED)
    return df.withColumn("training_sample_weight", weight)
