"""Ranking for field work: unknown sites first, by model and evidence together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket, clip, col_or, flag_is_one, number, text
from ..functions.ranking import global_rank, pct_ranks
from ..storage import materialize
from .scoring import WEAK_EVIDENCE, search_url

# What summaries say.
DENIED_TEXT = "field observation says no culvert within 10 m; removed from priority queue"
KNOWN_TEXT = "known field-report match; use for model validation"
AGREE_TEXT = "model and GIS evidence agree"
MODEL_TEXT = "model-led undiscovered candidate"
EVIDENCE_TEXT = "GIS evidence-led undiscovered candidate"
LOW_TEXT = "undiscovered candidate; lower confidence"


def attach_probability(evidence: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """Left join of culvert_probability on candidate_id; of repeated ids the first by ``order`` counts.

    Where a table has no candidate_id, tables of equal length are joined by the place of their rows, in ``order`` if both have
    it, else as they are stored; others get no probability.
    """
    if "culvert_probability" not in predictions.columns:
        return evidence
    base = evidence.drop("culvert_probability")
    if "candidate_id" in base.columns and "candidate_id" in predictions.columns:
        by = F.col(order) if order else F.monotonically_increasing_id()
        first = predictions.withColumn("_o", by).groupBy("candidate_id").agg(F.min_by("culvert_probability", "_o").alias("culvert_probability"))
        return base.join(first, "candidate_id", "left")
    if base.count() != predictions.count():
        return base
    named = order if order and order in base.columns and order in predictions.columns else None

    def placed(df: DataFrame) -> DataFrame:
        kept, _ = materialize(df.withColumn("_o", F.col(named) if named else F.monotonically_increasing_id()), "placed")
        return global_rank(kept, F.lit(0.0), [F.col("_o")], "_place").drop("_o")

    return placed(base).join(placed(predictions).select("_place", "culvert_probability"), "_place").drop("_place")


def masks(df: DataFrame, known_radius_m: float) -> tuple[Column, Column]:
    """(denied, known): by flag, or by distance; a denied flag column hides the denied distance; denied sites are not known."""
    near = lambda c: F.coalesce(number(c) <= known_radius_m, F.lit(False)) if c in df.columns else F.lit(False)
    denied = flag_is_one(df, "field_denied") if "field_denied" in df.columns else near("dist_to_denied_culvert_m")
    return denied, (flag_is_one(df, "is_culvert") | near("dist_to_known_culvert_m")) & ~denied


def blended(evidence: Column, model: Column, evidence_weight: float, model_weight: float) -> Column:
    weighted = (evidence_weight * evidence + model_weight * model) / (evidence_weight + model_weight)
    return clip(0.55 * F.sqrt(evidence * model) + 0.25 * evidence + 0.20 * weighted, 0, 1)


def summary_text(df: DataFrame) -> Column:
    base = text(col_or(df, "evidence_summary"))
    strong, led = F.col("model_probability_score") >= 70, F.col("evidence_score")
    return (
        F.when(F.col("discovery_status") == "field_denied", DENIED_TEXT)
        .when(F.col("discovery_status") == "known_field_match", KNOWN_TEXT)
        .when((base != "") & (base != WEAK_EVIDENCE), base)
        .when(strong & (led >= 45), AGREE_TEXT)
        .when(strong, MODEL_TEXT)
        .when(led >= 55, EVIDENCE_TEXT)
        .when(base != "", base)
        .otherwise(LOW_TEXT)
    )


def discovery_ranking(df: DataFrame, predictions: DataFrame | None = None, evidence_weight: float = 0.40, model_weight: float = 0.60, known_radius_m: float = 75.0, missing_probability_as_zero: bool = True, tie_break: str = "candidate_id") -> DataFrame:
    """Blend evidence with the model's percentile and rank unknown sites first.

    With two or more probabilities a site without one takes part with model rank 0 (``missing_probability_as_zero``; else it
    falls back to its evidence); with one or none, the probability itself is the model's rank.
    """
    if evidence_weight < 0 or model_weight < 0 or evidence_weight + model_weight <= 0:
        raise ValueError("discovery weights must not be negative and must sum to more than zero")
    if df.isEmpty():
        raise ValueError("the evidence table has no rows")
    out = attach_probability(df, predictions) if predictions is not None else df
    scaled = lambda c, s: clip(number(c) / s, 0, 1) if c in out.columns else F.lit(None).cast("double")
    out = out.withColumns({"_e": scaled("culvert_likelihood_score", 100.0), "_p": scaled("culvert_probability", 1.0)})
    if out.where("_p is not null").limit(2).count() > 1:
        out = pct_ranks(out, {"_m": F.col("_p")})
        if missing_probability_as_zero:
            out = out.withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    else:
        out = out.withColumn("_m", F.col("_p"))
    denied, known = masks(out, known_radius_m)
    zero = F.lit(0.0)
    mixed = F.coalesce(F.when(F.col("_m").isNotNull(), blended(F.col("_e"), F.col("_m"), evidence_weight, model_weight)).otherwise(F.col("_e")), F.col("_e"), zero)
    gone = lambda v, also_known=False: F.when(denied | known if also_known else denied, zero).otherwise(v)
    out = out.withColumns(
        {
            "is_known_field_match": known.cast("int"),
            "discovery_status": F.when(denied, "field_denied").when(known, "known_field_match").otherwise("undiscovered_candidate"),
            "evidence_score": gone(100 * F.coalesce("_e", zero)),
            "model_probability_score": gone(100 * F.coalesce("_p", zero)),
            "model_rank_score": gone(100 * F.coalesce("_m", zero)),
            "discovery_score": gone(100 * mixed, True),
        }
    ).drop("_e", "_p", "_m")
    return ranked(out, tie_break)


def ranked(out: DataFrame, tie_break: str = "candidate_id") -> DataFrame:
    """Order by known, then score and likelihood falling, nulls last; number, bucket and describe."""
    likelihood = number("culvert_likelihood_score") if "culvert_likelihood_score" in out.columns else F.lit(None).cast("double")
    # One falling number with known sites below all others: scores are within 0 and 100.
    lead = F.col("discovery_score") - 1000 * F.col("is_known_field_match")
    out, _ = materialize(out.withColumns({"_lead": lead, "_likelihood": likelihood}), "discovery")
    n = out.count()
    out = global_rank(out, F.col("_lead"), [F.col("_likelihood").desc_nulls_last(), F.col(tie_break)], "discovery_rank").drop("_lead", "_likelihood")
    out = out.withColumns(
        {
            "priority_rank": F.col("discovery_rank"),
            "priority_percentile": 1 - (F.col("discovery_rank") - 1) / F.lit(max(n, 1)),
            "priority_bucket": bucket(F.col("discovery_score")),
            "evidence_summary": summary_text(out),
        }
    )
    return out if "google_earth_url" in out.columns else out.withColumn("google_earth_url", search_url(out))


