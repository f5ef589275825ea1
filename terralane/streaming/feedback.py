"""The feedback loop as streams: observations upserted into a snapshot, and a debounced trigger for retraining."""

from __future__ import annotations

import hmac
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import MAP_EARTH_RADIUS_M
from ..operators.observations import LIMITS, NUMBERS, upsert, validated
from ..storage import materialize, scratch

MIN_INTERVAL_SECONDS = 900
INPUT_SCHEMA = ", ".join([*(f"{c} string" for c in LIMITS), "status string", *(f"{c} double" for c in NUMBERS), "latitude double", "longitude double", "deleted boolean"])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON-line observation files in order of arrival; a line with deleted = true takes an observation back."""
    return spark.readStream.schema(INPUT_SCHEMA).json(path).withColumns({"file_time": F.col("_metadata.file_modification_time"), "file_name": F.col("_metadata.file_name")})


def merge_batch(snapshot: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The snapshot after a batch: per id the last row by observed_at and then arrival; tombstones stay in it, so that a
    replayed or late row cannot bring back what was deleted after it.
    """
    log = batch if snapshot is None else snapshot.unionByName(batch, allowMissingColumns=True)
    order = F.struct("observed_at", "file_time", "file_name", "file_row")
    return upsert(log.withColumn("_order", order), "_order").drop("_order")


#: Parts of a snapshot, by the hash of the observation's id; a batch rewrites only those that it touches.
SNAPSHOT_PARTS, SNAPSHOTS_KEPT = 64, 3


def upsert_stream(stream: DataFrame, folder: str, publish: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, available_now: bool = True, parts: int = SNAPSHOT_PARTS) -> StreamingQuery:
    """Keep the snapshot in ``folder`` up to date.  A batch that runs again writes the same parts again.

    A snapshot is a manifest, batch-N, that names a folder for each part.  A batch writes new folders for the parts its rows
    fall into and a manifest that keeps the others; folders that only manifests before the last few name are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("file_row", F.monotonically_increasing_id())
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        rows = validated(batch.where(~gone)).unionByName(batch.where(gone), allowMissingColumns=True)
        at = F.pmod(F.xxhash64("observation_id"), F.lit(parts)).cast("int")
        with scratch(spark):
            rows, _ = materialize(rows.withColumn("_part", at), "observations")
            touched = sorted(r[0] for r in rows.select("_part").distinct().collect())  # at most ``parts``
            manifest = latest_manifest(spark, folder, number - 1)
            before = {p: manifest[str(p)] for p in touched if str(p) in manifest}
            found = spark.read.parquet(*before.values()) if before else None
            made = merge_batch(found, rows.drop("_part"))
            target = f"{folder}/parts/batch-{number}"
            made.withColumn("part", at).repartition("part").write.mode("overwrite").partitionBy("part").parquet(target)
        manifest = manifest | {str(p): f"{target}/part={p}" for p in touched}
        write_manifest(spark, folder, number, manifest)
        if publish is not None:
            publish(live(latest_snapshot(spark, folder, number)), number)
        prune(spark, folder, number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _files(spark, folder)
    at = path(f"{folder}/manifests")
    return sorted(int(f.getPath().getName().split("-")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("batch-")) if fs.exists(at) else []


def write_manifest(spark: SparkSession, folder: str, number: int, manifest: dict[str, str]) -> None:
    """Written beside and renamed, so that a manifest is whole or not there."""
    path, fs = _files(spark, folder)
    fs.mkdirs(path(f"{folder}/manifests"))
    own, final = path(f"{folder}/manifests/writing-{number}"), path(f"{folder}/manifests/batch-{number}")
    out = fs.create(own, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(own, final)


def latest_manifest(spark: SparkSession, folder: str, at_most: int) -> dict[str, str]:
    """The folder of each part after the last batch that is not later than ``at_most``; empty before the first."""
    found = [n for n in _manifests(spark, folder) if n <= at_most]
    if not found:
        return {}
    path, fs = _files(spark, folder)
    at = path(f"{folder}/manifests/batch-{found[-1]}")
    source = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
    finally:
        source.close()


def latest_snapshot(spark: SparkSession, folder: str, at_most: int = 1 << 62) -> DataFrame | None:
    """All observations after a batch, tombstones included; None before the first."""
    manifest = latest_manifest(spark, folder, at_most)
    return spark.read.parquet(*manifest.values()) if manifest else None


def prune(spark: SparkSession, folder: str, number: int, kept: int = SNAPSHOTS_KEPT) -> None:
    """Delete manifests before the last ``kept`` and the folders that no other names."""
    path, fs = _files(spark, folder)
    batches = [n for n in _manifests(spark, folder) if n <= number]
    if len(batches) <= kept:
        return
    named = {at for n in batches[-kept:] for at in latest_manifest(spark, folder, n).values()}
    for n in batches[:-kept]:
        for at in latest_manifest(spark, folder, n).values():
            if at not in named:
                fs.delete(path(at), True)
        fs.delete(path(f"{folder}/manifests/batch-{n}"), False)


def live(snapshot: DataFrame) -> DataFrame:
    """Observations that are not taken back."""
    return snapshot.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted", "file_time", "file_name", "file_row")


@dataclass(frozen=True)
class Decision:
    status: str
    next_allowed: float | None = None


def decide(state: dict | None, fingerprint: str, now: float, persisted: bool = True, configured: bool = True, force: bool = False, min_interval: float = MIN_INTERVAL_SECONDS) -> Decision:
    """What to do about a retrain: not_persisted, not_configured, unchanged, debounced, or request.

    A failed dispatch lifts both the check for changes and the wait, as does ``force``.
    """
    if not persisted:
        return Decision("not_persisted")
    if not configured:
        return Decision("not_configured")
    if not force and state and state.get("status") != "failed":
        if state.get("fingerprint") == fingerprint:
            return Decision("unchanged")
        last = state.get("requested_at")
        if last is not None and min_interval > 0 and now - last < min_interval:
            return Decision("debounced", last + min_interval)
    return Decision("request")


def trigger(state: dict | None, fingerprint: str, now: float, dispatch: Callable[[dict], bool], **options) -> tuple[dict | None, Decision]:
    """Decide, dispatch if due, and return the new state with what came of it (queued or failed)."""
    made = decide(state, fingerprint, now, **options)
    if made.status != "request":
        return state, made
    status = "queued" if dispatch({"observation_fingerprint": fingerprint, "requested_at": now}) else "failed"
    return {"requested_at": now, "fingerprint": fingerprint, "status": status}, Decision(status)


DECISIONS = "region string, at timestamp, fingerprint string, status string"


def _decided(region: str, held: dict | None, rows: pd.DataFrame, min_interval: float) -> tuple[dict | None, pd.DataFrame]:
    out = []
    for at, fingerprint in zip(rows["at"], rows["fingerprint"], strict=True):
        held, made = trigger(held, fingerprint, at.timestamp(), lambda _: True, min_interval=min_interval)
        out.append((region, at, fingerprint, made.status))
    return held, pd.DataFrame(out, columns=["region", "at", "fingerprint", "status"])


def retrain_log(changes: DataFrame, min_interval: float = MIN_INTERVAL_SECONDS) -> DataFrame:
    """What would have been decided about each change of a log (region, at, fingerprint), in order of time and fingerprint."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "fingerprint"], kind="stable")
        return _decided(group["region"].iloc[0], None, group, min_interval)[1]

    return changes.select("region", "at", "fingerprint").groupBy("region").applyInPandas(step, DECISIONS)  # one region's changes


def retrain_requests(changes: DataFrame, min_interval: float = MIN_INTERVAL_SECONDS) -> DataFrame:
    """A stream of (region, at, fingerprint) to one of decisions, a debounce state for each region.

    State is a small JSON text per region in Spark's state store, so a restart goes on where it stopped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        held, out = _decided(key[0], held, pd.concat(list(batches)).sort_values(["at", "fingerprint"], kind="stable"), min_interval)
        state.update((json.dumps(held),))
        yield out

    return changes.groupBy("region").applyInPandasWithState(step, DECISIONS, "state string", "append", "NoTimeout")


# The least move, and the least time between two lists, of a display that follows a device.
LEAST_MOVE_M, LIST_EVERY_S = 4.0, 0.65

POSITIONS = "device string, at timestamp, latitude double, longitude double, accuracy double, lists boolean"


def accepted(held: dict | None, at: float, latitude: float, longitude: float, accuracy: float) -> tuple[dict | None, bool]:
    """A device's state after a position, and whether the position counts.

    It does if there was none before, if it is LEAST_MOVE_M or more from the last one that did, or is more accurate than
    that.  ``listed_at`` is when a list was last drawn for one, at most every LIST_EVERY_S.
    """
    if held is not None:
        p1, p2 = math.radians(held["latitude"]), math.radians(latitude)
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(longitude - held["longitude"]) / 2) ** 2
        moved = 2 * MAP_EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))
        if moved < LEAST_MOVE_M and accuracy >= held["accuracy"]:
            return held, False
    lists = held is None or at - held["listed_at"] >= LIST_EVERY_S
    return {"latitude": latitude, "longitude": longitude, "accuracy": accuracy, "listed_at": at if lists else held["listed_at"]}, True


def _follow(held: dict | None, rows: pd.DataFrame) -> tuple[dict | None, list[tuple]]:
    out = []
    for r in rows.itertuples():
        at = r.at.timestamp()
        before = held
        held, counts = accepted(held, at, r.latitude, r.longitude, math.inf if pd.isna(r.accuracy) else r.accuracy)
        if counts:
            out.append((r.device, r.at, r.latitude, r.longitude, r.accuracy, before is None or held["listed_at"] == at))
    return held, out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["device", "at", "latitude", "longitude", "accuracy", "lists"])


def throttled_positions(positions: DataFrame) -> DataFrame:
    """Positions (device, at, latitude, longitude, accuracy) that count, by :func:`accepted`, and whether a list is drawn.

    Each is compared with the last of its device that counted, however many did not in between.  Rows without a place are left
    out; an unknown accuracy is the worst; of rows at one time the order is by place.
    """
    known = positions.select("device", "at", "latitude", "longitude", "accuracy").where("latitude IS NOT NULL AND longitude IS NOT NULL AND at IS NOT NULL")

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        return _frame(_follow(None, group.sort_values(["at", "latitude", "longitude"], kind="stable"))[1])

    return known.groupBy("device").applyInPandas(follow, POSITIONS)  # one device's track


def throttle_stream(positions: DataFrame) -> DataFrame:
    """The same of a stream in order of arrival, with the last position that counted as each device's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "latitude", "longitude"], kind="stable")
        held, out = _follow(held, rows.dropna(subset=["at", "latitude", "longitude"]))
        if held is not None:
            state.update((json.dumps(held),))
        yield _frame(out)

    return positions.select("device", "at", "latitude", "longitude", "accuracy").groupBy("device").applyInPandasWithState(step, POSITIONS, "state string", "append", "NoTimeout")


def scheduled_check(state: dict | None, fingerprint: str, now: float, dispatch: Callable[[dict], bool], authorization: str = "", secret: str | None = None, production: bool = False, force: bool = False, **options) -> tuple[int, dict | None, dict]:
    """A timer's call: (HTTP status, new state, answer).

    In production a secret must be set; where one is, the caller has to show it.  ``force`` skips the check for changes and
    the wait.
    """
    if not secret and production:
        return 500, state, {"error": "a secret must be configured for scheduled retraining"}
    if secret and not hmac.compare_digest(authorization.encode(), f"Bearer {secret}".encode()):
        return 401, state, {"error": "Unauthorized"}
    state, made = trigger(state, fingerprint, now, dispatch, force=force, **options)
    return 200, state, {"status": "ok", "retraining": {"status": made.status, "next_allowed": made.next_allowed}}
