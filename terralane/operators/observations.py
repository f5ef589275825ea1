"""Crews' observations as labels: confirmed sites, denials and missed predictions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_or, first_non_empty, number, text

# Fixed values.
SOURCE_FILE, PREDICTION_PREFIX = "field_observations.geojson", "cand_"
STATUSES = ("confirmed_culvert", "no_culvert", "uncertain")
LIMITS = {"observation_id": 80, "observed_at": 48, "candidate_id": 120, "road_name": 180, "stream_name": 180, "notes": 2000, "source": 80, "priority_bucket": 40, "field_culvert_id": 80, "layout_source": 80, "layout_scan_summary": 600, "nearest_candidate_id": 120, "missed_candidate_id": 120}
NUMBERS = ("prediction_score", "priority_rank", "nearest_candidate_distance_m", "missed_candidate_distance_m", "inferred_from_candidate")


def field(df: DataFrame, name: str) -> Column:
    return text(col_or(df, name, ""))


def site_id(df: DataFrame) -> Column:
    """The crew's own id, else the candidate's, else the observation's."""
    named = first_non_empty(field(df, "field_culvert_id"), field(df, "candidate_id"), field(df, "observation_id"))
    return F.when(named == "", "field_observation").otherwise(named)


def dedupe(df: DataFrame, order: str) -> DataFrame:
    """The first row by ``order`` of each site: by its own id, else its place to six decimals, else the observation's id."""
    own, oid = F.trim(field(df, "field_culvert_id")), F.trim(field(df, "observation_id"))
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.format_string("point:%.6f:%.6f", F.col("x"), F.col("y")))
    key = F.when(own != "", F.concat(F.lit("field:"), own)).otherwise(F.coalesce(place, F.when(oid != "", F.concat(F.lit("observation:"), oid)), F.concat(F.lit("row:"), F.col(order).cast("string"))))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    return df.withColumn("_key", key).withColumn("_first", first).where("_first = 1").drop("_key", "_first")


def _label(df: DataFrame, order: str, label: str, culvert_id: Column, extra: dict[str, Column]) -> DataFrame:
    shared = {"report_date": F.substring(field(df, "observed_at"), 1, 10), "route": field(df, "road_name"), "culvert_id": culvert_id, "source_file": F.lit(SOURCE_FILE), "label": F.lit(label), "label_confidence": F.lit(1.0)}
    shared |= {c: field(df, c) for c in ("observation_id", "field_culvert_id", "layout_source", "notes")}
    return df.select(F.col(order), "x", "y", *[v.alias(k) for k, v in (shared | extra).items()])


def confirmed_sites(df: DataFrame, order: str = "row") -> DataFrame:
    confirmed = dedupe(df.where("status = 'confirmed_culvert'"), order)
    return _label(confirmed, order, "confirmed_field_observation", site_id(confirmed), {})


def denied_sites(df: DataFrame, order: str = "row") -> DataFrame:
    denied = df.where("status = 'no_culvert'")
    return _label(denied, order, "no_culvert", site_id(denied), {"candidate_id": field(denied, "candidate_id"), "miss_distance_m": F.lit(None).cast("double")})


def missed_predictions(df: DataFrame, threshold_m: float = 10.0, order: str = "row") -> DataFrame:
    """Predictions that a confirmed site lies farther than the threshold from: they are negatives, with a note that says so."""
    confirmed = dedupe(df.where("status = 'confirmed_culvert'"), order)
    cid = first_non_empty(field(confirmed, "missed_candidate_id"), field(confirmed, "nearest_candidate_id"))
    far = number(first_non_empty(field(confirmed, "missed_candidate_distance_m"), field(confirmed, "nearest_candidate_distance_m")))
    missed = confirmed.withColumns({"_cid": cid, "_far": far}).where(F.startswith(F.lower("_cid"), F.lit(PREDICTION_PREFIX)) & (F.col("_far") > threshold_m))
    note = F.concat(F.when(field(missed, "notes") == "", "").otherwise(F.concat(field(missed, "notes"), F.lit("; "))), F.format_string("confirmed culvert was %.1f m from this prediction", F.col("_far")))
    return _label(missed, order, "missed_prediction", F.col("_cid"), {"candidate_id": F.col("_cid"), "miss_distance_m": F.col("_far"), "notes": note})


def negatives(df: DataFrame, threshold_m: float = 10.0, order: str = "row") -> DataFrame:
    return denied_sites(df, order).unionByName(missed_predictions(df, threshold_m, order))


def merge_known(base: DataFrame | None, df: DataFrame, exclude_confirmed: bool = False, order: str = "row") -> DataFrame:
    """Known sites: the base layer and, unless excluded, confirmed observations."""
    new = confirmed_sites(df, order)
    if base is None:
        return new
    return base if exclude_confirmed else base.unionByName(new, allowMissingColumns=True)


def validated(df: DataFrame, null_is_zero: bool = False) -> DataFrame:
    """Observations within the globe, trimmed and cut to their lengths; an unknown status is 'uncertain'.

    ``null_is_zero`` reads missing numbers as 0, as loosely typed clients do.
    """
    lat, lon = number("latitude"), number("longitude")
    cut = lambda c: F.trim(F.substring(F.trim(field(df, c)), 1, LIMITS[c])) if c in LIMITS else field(df, c)
    missing = F.lit(0.0) if null_is_zero else F.lit(None).cast("double")
    new = {c: cut(c) for c in LIMITS}
    new["source"] = F.when(new["source"] == "", "field_review").otherwise(new["source"])
    new["status"] = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("uncertain")
    new |= {c: F.coalesce(number(F.trim(field(df, c))), missing) for c in NUMBERS}
    return df.where(lat.between(-90, 90) & lon.between(-180, 180)).withColumns(new | {"latitude": lat, "longitude": lon})


def upsert(log: DataFrame, order: str = "arrival", deleted: str | None = None) -> DataFrame:
    """The last row by arrival of each observation_id; an id whose last row is a tombstone is gone."""
    columns = [c for c in log.columns if c != "observation_id"]
    last = log.groupBy("observation_id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("observation_id", "r.*")
    return last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else last


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: 24 hex digits that identify the set of observations, whatever their order.

    The digest is SHA-256 over the observations' fields in sorted order, so it is one pass over a sorted table: one task, which
    sorts with spilling and reads on, holding a batch at a time.  Observations are what people report, so that is enough.
    """
    fields = [field(df, c) for c in ("observation_id", "status", "observed_at", "field_culvert_id", "candidate_id", "longitude", "latitude")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, first = hashlib.sha256(), True
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    found.update(text.encode() if first else b"|" + text.encode())
                    first = False
        yield pa.RecordBatch.from_pydict({"fingerprint": [found.hexdigest()[:24]]})

    nothing = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("r"))  # so that an empty set has a digest too
    return df.select(F.concat_ws(":", *fields).alias("r")).unionByName(nothing).repartition(1).sortWithinPartitions("r").mapInArrow(digest, "fingerprint string")
