"""Review queue rows for extracted records, and what reviewers answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_or, number, text
from .reports import in_state

# Fixed values.
REJECTED = ("false", "0", "no", "reject", "rejected")
REVIEW_KEYS = ("review", "reviewed", "llm_response", "response")
INSTRUCTION = "Check the extracted coordinate and ids against the context. Accept, correct or reject."


def review_id(df: DataFrame) -> Column:
    """First 16 hex digits of SHA-1 over five fields joined by a bar."""
    fields = [text(col_or(df, c, "")) for c in ("source_file", "report_date", "latitude", "longitude", "raw_coordinate_text")]
    return F.substring(F.sha1(F.concat_ws("|", *fields).cast("binary")), 1, 16)


def review_queue(df: DataFrame) -> DataFrame:
    """A nested row per record: review_id, task, instruction, source, extracted, expected_response_schema."""
    clean = lambda c: F.trim(text(col_or(df, c, ""))).alias(c)
    label = F.coalesce(F.nullif(F.trim(text(col_or(df, "label", ""))), F.lit("")), F.lit("field_observed_culvert"))
    confidence = F.coalesce(F.nullif(number(col_or(df, "label_confidence")), F.lit(0.0)), F.lit(0.85))
    answer = {"accepted": "boolean", "latitude": "number or null", "longitude": "number or null", "route": "string", "culvert_id": "string", "label_confidence": "number from 0 to 1", "reason": "short string"}
    return df.select(
        review_id(df).alias("review_id"),
        F.lit("culvert_field_report_label_review").alias("task"),
        F.lit(INSTRUCTION).alias("instruction"),
        F.struct(*[text(col_or(df, c, "")).alias(c) for c in ("source_file", "report_date", "context_text", "raw_coordinate_text")]).alias("source"),
        F.struct(number(col_or(df, "latitude")).alias("latitude"), number(col_or(df, "longitude")).alias("longitude"), clean("route"), clean("nysdot_region"), clean("culvert_id"), label.alias("label"), confidence.alias("label_confidence")).alias("extracted"),
        F.struct(*[F.lit(v).alias(k) for k, v in answer.items()]).alias("expected_response_schema"),
    )


def reviewed_records(lines: DataFrame, null_rejects: bool = True) -> DataFrame:
    """Accepted records of answered rows (JSON lines in ``value``): corrected values first, confidence within [0, 1].

    With ``null_rejects`` an answer of null for a coordinate rejects the row; else the extracted one stands.
    """
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    base = F.coalesce(*[F.when(has(f"$.{k}"), k) for k in REVIEW_KEYS], F.lit(""))
    rows = lines.withColumn("_k", base)

    def said(name: str) -> tuple[Column, Column]:
        """(value in the answer, whether the answer has the name at all)."""
        value, there = get(f"$.{name}"), has(f"$.{name}")
        for k in REVIEW_KEYS:
            value, there = F.when(F.col("_k") == k, get(f"$.{k}.{name}")).otherwise(value), F.when(F.col("_k") == k, has(f"$.{k}.{name}")).otherwise(there)
        return value, there

    def best(name: str) -> Column:
        value, there = said(name)
        other = F.coalesce(get(f"$.extracted.{name}"), F.when(~has("$.extracted"), get(f"$.{name}")))
        return F.when(there, value).otherwise(other) if null_rejects else F.coalesce(value, other)

    source = lambda n: F.trim(text(F.coalesce(get(f"$.source.{n}"), F.when(~has("$.source"), get(f"$.{n}")))))
    accepted = F.coalesce(said("accepted")[0], get("$.accepted"), F.lit("true"))
    confidence = F.coalesce(number(best("label_confidence")), F.lit(0.9))
    out = rows.where(~F.lower(accepted).isin(*REJECTED)).select(
        source("source_file").alias("source_file"), source("report_date").alias("report_date"), F.trim(text(best("nysdot_region"))).alias("nysdot_region"), F.trim(text(best("route"))).alias("route"),
        number(best("latitude")).alias("latitude"), number(best("longitude")).alias("longitude"), source("raw_coordinate_text").alias("raw_coordinate_text"), F.trim(text(best("culvert_id"))).alias("culvert_id"), source("context_text").alias("context_text"),
        F.coalesce(F.nullif(F.trim(text(said("label")[0])), F.lit("")), F.lit("llm_reviewed_field_observed_culvert")).alias("label"), F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))).alias("label_confidence"),
        F.trim(text(get("$.review_id"))).alias("llm_review_id"), F.trim(text(said("reason")[0])).alias("llm_review_reason"),
    )
    return out.where(in_state(F.col("latitude"), F.col("longitude")))
