"""Crews' feedback applied to the published queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, text
from ..functions.geometry import haversine
from ..functions.ranking import global_rank
from .spatial import grid_join

# Fixed values.
MATCH_RADIUS_M, CONFIRMED_SCORE, MISSED_SCORE = 10.0, 98.0, 15.0
CONFIRMED_TEXT = "confirmed field observation; retraining label collected"
DENIED_TEXT = "field observation says no culvert; deprioritized for retraining"
UNCERTAIN_TEXT = "field observation uncertain"
DEGREE_M = 111_194.9  # metres a degree of latitude on the sphere


def append_text(current: Column, addition: Column) -> Column:
    """With '; ' between, unless it is said already."""
    now = F.trim(F.substring(text(current), 1, 600))
    return F.when(now == "", addition).when(F.contains(now, addition), now).otherwise(F.concat(now, F.lit("; "), addition))


def feedback_bucket(score: Column) -> Column:
    return F.when(score > 75, "very_high").when(score > 55, "high").when(score > 35, "medium").otherwise("low")


def nearest_by_haversine(observations: DataFrame, features: DataFrame, radius: float = MATCH_RADIUS_M) -> DataFrame:
    """(observation_id, candidate_id, d): the nearest feature on the sphere within the radius; ties go to the lower rank.

    Cells are degrees of the radius on the parallel farthest from the equator, so longitude never hides a neighbour.
    """
    widest = observations.agg(F.max(F.abs("latitude"))).first()[0] or 0.0
    import math

    cell = radius / DEGREE_M / max(math.cos(math.radians(min(widest + 1, 89.0))), 0.01) * 1.01
    a = observations.select("observation_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    b = features.select("candidate_id", F.col("rank").alias("rank"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    pairs = grid_join(a, b, cell * 1.5).withColumn("m", haversine(F.col("l_y"), F.col("l_x"), F.col("r_y"), F.col("r_x"))).where(F.col("m") <= radius)
    return pairs.groupBy(F.col("l_observation_id").alias("observation_id")).agg(F.min(F.struct("m", "r_rank", "r_candidate_id")).alias("b")).select("observation_id", F.col("b.r_candidate_id").alias("candidate_id"), F.col("b.m").alias("d"))


def targets(features: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missed, direct): which candidate each observation caps as missed, and which it applies to, by id or else nearest."""
    near_id = F.coalesce(F.nullif(F.trim("missed_candidate_id"), F.lit("")), F.nullif(F.trim("nearest_candidate_id"), F.lit("")))
    distance = F.coalesce(number("missed_candidate_distance_m"), number("nearest_candidate_distance_m"))
    ids = features.select("candidate_id")
    missed = observations.where("status = 'confirmed_culvert'").select("observation_id", "observed_at", near_id.alias("candidate_id"), distance.alias("missed_m")).where(F.col("missed_m") > MATCH_RADIUS_M).join(ids, "candidate_id")
    named = observations.select("observation_id", "candidate_id").where("candidate_id != ''").join(ids, "candidate_id")
    rest = observations.join(named.select("observation_id"), "observation_id", "left_anti")
    return missed, named.unionByName(nearest_by_haversine(rest, features).select("candidate_id", "observation_id"))


def apply(features: DataFrame, observations: DataFrame) -> DataFrame:
    """The queue after feedback.  Observations apply newest first, so of several on one feature the oldest has the last word
    on its status, a denial ends its score, and a miss caps it; a confirmed site without a feature becomes one.
    """
    missed, direct = targets(features, observations)
    told = direct.join(observations.select("observation_id", "status", "observed_at", "field_culvert_id"), "observation_id")
    last = told.groupBy("candidate_id").agg(F.min_by(F.struct("status", "observation_id", "field_culvert_id"), F.struct("observed_at", F.col("observation_id"))).alias("o"), F.max((F.col("status") == "confirmed_culvert").cast("int")).alias("ever"))
    caps = missed.groupBy("candidate_id").agg(F.min_by(F.struct("observation_id", "missed_m"), F.struct("observed_at", "observation_id")).alias("m"))
    out = features.join(last, "candidate_id", "left").join(caps, "candidate_id", "left")
    status, score = F.col("o.status"), F.coalesce(number("discovery_score"), F.lit(0.0))
    confirmed, denied, capped = status == "confirmed_culvert", status == "no_culvert", F.col("m").isNotNull()
    capped_score = F.when(capped, F.least(score, F.lit(MISSED_SCORE))).otherwise(score)
    said = F.when(capped, append_text(F.col("evidence_summary"), F.format_string("field-confirmed culvert was %.1f m away; not counted as a hit", F.col("m.missed_m")))).otherwise(F.col("evidence_summary"))
    out = out.withColumns(
        {
            "discovery_score": F.when(denied, 0.0).when(confirmed, F.greatest(capped_score, F.lit(CONFIRMED_SCORE))).otherwise(capped_score),
            "discovery_status": F.when(denied, "field_denied").when(confirmed, "confirmed_field_observation").when(capped, "field_missed_prediction").otherwise(F.coalesce(F.nullif("discovery_status", F.lit("")), F.when(status.isNotNull(), "field_uncertain"))),
            "is_known_field_match": F.when(denied, 0).when(confirmed, 1).otherwise(F.col("is_known_field_match")),
            "evidence_summary": F.when(denied, DENIED_TEXT).when(confirmed, append_text(said, F.lit(CONFIRMED_TEXT))).when(status.isNotNull(), append_text(said, F.lit(UNCERTAIN_TEXT))).otherwise(said),
            "field_feedback_observation_id": F.coalesce("o.observation_id", "m.observation_id"),
        }
    ).drop("o", "m", "ever")
    return rerank(out.unionByName(inserted(observations, direct), allowMissingColumns=True))


def inserted(observations: DataFrame, direct: DataFrame) -> DataFrame:
    """A feature for each confirmed observation that meets none."""
    new = observations.where("status = 'confirmed_culvert'").join(direct.select("observation_id"), "observation_id", "left_anti")
    cid = F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in ("field_culvert_id", "candidate_id", "observation_id")])
    return new.select(
        cid.alias("candidate_id"), F.lit(100.0).alias("discovery_score"), F.lit("confirmed_field_observation").alias("discovery_status"), F.lit(1).alias("is_known_field_match"), F.lit(CONFIRMED_TEXT).alias("evidence_summary"),
        "longitude", "latitude", F.lit(0).cast("long").alias("rank"), F.col("observation_id").alias("field_feedback_observation_id"),
    )


def rerank(df: DataFrame, tie_break: str = "candidate_id") -> DataFrame:
    """Denied sites last, known ones after unknown, then by score; ties keep their former rank."""
    denied, known = (F.col("discovery_status") == "field_denied").cast("int"), (F.coalesce("is_known_field_match", F.lit(0)) == 1).cast("int")
    score = F.coalesce(number("discovery_score"), F.lit(0.0))
    lead = score - 1000 * known - 10000 * F.coalesce(denied, F.lit(0))
    out = global_rank(df.withColumn("_lead", lead), F.col("_lead"), [F.col("rank"), F.col(tie_break)], "discovery_rank").drop("_lead")
    return out.withColumns({"priority_rank": F.col("discovery_rank"), "priority_bucket": feedback_bucket(score)})
