"""The published queue and crews' observations over HTTP: handlers over tables, and a small server for one machine.

Handlers are plain functions of a method, a path and a body, so any front end can call them.  Findings are computed by the
engine's operators; what is sent is the published, so bounded, part.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from .operators import export, feedback, observations, serving
from .sources import vector
from .streaming.feedback import INPUT_SCHEMA, scheduled_check, trigger

MOST_BYTES = 1_000_000
OBSERVATION_FIELDS = [f.split(" ")[0] for f in INPUT_SCHEMA.split(", ")]

Answer = tuple[int, dict, dict]


def collection(features: list[dict]) -> dict:
    return {"type": "FeatureCollection", "features": features}


def checked(found: object) -> dict:
    """A feature collection as it was pulled from elsewhere; anything else is an error."""
    if not isinstance(found, dict) or found.get("type") != "FeatureCollection" or not isinstance(found.get("features"), list):
        raise ValueError("observations are not a GeoJSON FeatureCollection")
    return found


def pull_observations(out: str, source: str, opener: Callable | None = None, timeout: float = 30.0) -> int:
    """Fetch an observation collection from a file or an address, check it, write it to ``out``; how many there are."""
    if "://" in source and not source.startswith("file://"):
        import urllib.request

        request = urllib.request.Request(source, headers={"Accept": "application/geo+json, application/json"})
        with (opener or urllib.request.urlopen)(request, timeout=timeout) as answer:
            text = answer.read().decode("utf-8")
    else:
        with open(source.removeprefix("file://"), encoding="utf-8") as f:
            text = f.read()
    found = checked(json.loads(text))
    vector.write_file(out, iter([json.dumps(found, indent=2) + "\n"]))
    return len(found["features"])


@dataclass
class Service:
    """State of one deployment: the base queue, a file of observations, and caches of what is published from both.

    ``base`` has the columns of a published queue with rank, longitude and latitude.  ``dispatch`` asks for a retrain.
    """

    spark: SparkSession
    base: DataFrame
    folder: str
    dispatch: Callable[[dict], bool] | None = None
    secret: str | None = None
    production: bool = False
    tasks: dict[str, Callable[[], object]] = field(default_factory=dict)
    now: Callable[[], float] = time.time
    active: str | None = None
    _write: threading.Lock = field(default_factory=threading.Lock)
    _task: threading.Lock = field(default_factory=threading.Lock)

    # --- Stored documents ---

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _load(self, name: str) -> dict | None:
        try:
            with open(self._path(name), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _store(self, name: str, value: dict) -> None:
        vector.write_file(self._path(name), iter([json.dumps(value, indent=2, default=str)]))

    def observations(self) -> dict:
        found = self._load("field_observations.geojson")
        return checked(found) if found is not None else collection([])

    # --- Published data ---

    def table(self, found: dict) -> DataFrame:
        rows = [tuple(_as_kind(f.get("properties", {}).get(c), c) for c in OBSERVATION_FIELDS) for f in found["features"]]
        return self.spark.createDataFrame(rows, INPUT_SCHEMA)

    def published(self, refresh: bool = False) -> tuple[dict, dict]:
        """(findings, summary) after feedback; kept until the base queue or the observations change."""
        base = serving.base_fingerprint(self.base, "rank").first()["fingerprint"]
        kept = self._load("published.json")
        if not refresh and kept and kept.get("base_fingerprint") == base:
            return kept["findings"], kept["summary"]
        found = self.observations()
        log = self.table(found)
        queue = feedback.apply(self.base, log) if found["features"] else self.base
        rows = vector.feature_json(vector.of_points(queue).select(*vector.OWN, *export.published(queue).columns).orderBy("row"))
        features = sorted((json.loads(r["value"]) for r in rows.toLocalIterator()), key=lambda f: (f["properties"].get("discovery_rank") or 1 << 60, str(f["properties"].get("candidate_id"))))
        summary = export.summary(queue).first().asDict() | serving.status_counts(log).first().asDict()
        summary = json.loads(json.dumps(summary, default=str)) | {"base_fingerprint": base}
        self._store("published.json", {"base_fingerprint": base, "findings": collection(features), "summary": summary})
        return collection(features), summary

    def retrain(self, **options) -> dict:
        found = observations.fingerprint(self.table(self.observations())).first()["fingerprint"]
        state, made = trigger(self._load("retrain.json"), found, self.now(), self.dispatch or (lambda _: False), configured=self.dispatch is not None, **options)
        if state is not None:
            self._store("retrain.json", state)
        return {"status": made.status, "next_allowed": made.next_allowed}

    # --- Changes ---

    def save(self, payload: dict) -> dict:
        """Validate an observation and put it in place of the one with its id, or last."""
        row = self.spark.createDataFrame([tuple(_as_kind(payload.get(c), c) for c in OBSERVATION_FIELDS)], INPUT_SCHEMA)
        valid = observations.validated(row).first()
        if valid is None:
            raise ValueError("latitude and longitude must be on the globe")
        properties = {k: v for k, v in valid.asDict().items() if k != "deleted"}
        if not properties["observation_id"]:
            raise ValueError("an observation needs an observation_id")
        feature = {"type": "Feature", "properties": properties, "geometry": {"type": "Point", "coordinates": [valid["longitude"], valid["latitude"]]}}
        with self._write:
            found = self.observations()["features"]
            at = next((i for i, f in enumerate(found) if f["properties"].get("observation_id") == properties["observation_id"]), len(found))
            self._store("field_observations.geojson", collection([*found[:at], feature, *found[at + 1 :]]))
        return feature

    def delete(self, observation_id: str) -> None:
        if not observation_id:
            raise ValueError("an observation id is required")
        with self._write:
            found = self.observations()["features"]
            left = [f for f in found if f["properties"].get("observation_id") != observation_id]
            if len(left) == len(found):
                raise ValueError(f"no observation {observation_id}")
            self._store("field_observations.geojson", collection(left))

    def run_task(self, name: str) -> Answer:
        """Run a named task unless one is running: then 409, with its name."""
        if name not in self.tasks:
            return 404, {"error": "Not found"}, {}
        if not self._task.acquire(blocking=False):
            return 409, {"error": "another task is running", "active_task": self.active}, {}
        try:
            self.active = name
            return 200, {"status": "completed", "task": name, "result": self.tasks[name]()}, {}
        except Exception as failed:  # noqa: BLE001  a task's failure is its answer
            return 500, {"status": "failed", "task": name, "error": str(failed)}, {}
        finally:
            self.active = None
            self._task.release()

    def health(self) -> dict:
        def about(name: str) -> dict:
            path = self._path(name)
            return {"exists": True, "bytes": os.path.getsize(path), "updated_at": os.path.getmtime(path)} if os.path.exists(path) else {"exists": False}

        return {"status": "ok", "active_task": self.active, "data": {n.split(".")[0]: about(n) for n in ("published.json", "field_observations.geojson", "retrain.json")}, "tasks": sorted(self.tasks)}

    # --- Requests ---

    def handle(self, method: str, target: str, body: bytes = b"", headers: dict[str, str] | None = None) -> Answer:
        """(status, JSON answer, headers) of a request."""
        url = urlparse(target)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        allowed = {"/api/observations": ("GET", "POST", "DELETE"), "/api/findings": ("GET",), "/api/summary": ("GET",), "/api/health": ("GET",), "/api/cron/retrain": ("GET", "POST")}
        if url.path.startswith("/api/run-"):
            return self.run_task(url.path.removeprefix("/api/run-")) if method == "POST" else (405, {"error": "Method not allowed."}, {"allow": "POST"})
        if url.path not in allowed:
            return 404, {"error": "Not found"}, {}
        if method not in allowed[url.path]:
            return 405, {"error": "Method not allowed."}, {"allow": ", ".join(allowed[url.path])}
        if len(body) > MOST_BYTES:
            return 400, {"error": "Request body is too large."}, {}
        if url.path == "/api/health":
            return 200, self.health(), {}
        if url.path == "/api/findings":
            return 200, self.published()[0], {}
        if url.path == "/api/summary":
            return 200, self.published()[1], {}
        if url.path == "/api/cron/retrain":
            found = observations.fingerprint(self.table(self.observations())).first()["fingerprint"]
            shown = {k.lower(): v for k, v in (headers or {}).items()}.get("authorization", "")
            status, state, answer = scheduled_check(self._load("retrain.json"), found, self.now(), self.dispatch or (lambda _: False), shown, self.secret, self.production, query.get("force") == "1", configured=self.dispatch is not None)
            if status == 200 and state is not None:
                self._store("retrain.json", state)
            return status, answer, {}
        if method == "GET":
            return 200, self.observations(), {}
        try:
            if method == "DELETE":
                self.delete(query.get("id", "")[:80])
                status, said = 200, {"status": "deleted", "observation_id": query["id"]}
            else:
                payload = json.loads(body or b"{}")
                if not isinstance(payload, dict):
                    raise ValueError("an observation is a JSON object")
                status, said = 201, {"status": "saved", "feature": self.save(payload)}
        except ValueError as wrong:
            return 400, {"error": str(wrong)}, {}
        findings, summary = self.published(refresh=True)
        return status, said | {"observations": self.observations(), "findings": findings, "summary": summary, "retraining": self.retrain()}, {}


_KINDS = dict(f.split(" ") for f in INPUT_SCHEMA.split(", "))


def _as_kind(value: object, name: str) -> object:
    """A JSON value as its column's kind; what cannot be read is missing."""
    if value is None:
        return None
    kind = _KINDS[name]
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if kind == "boolean":
        return bool(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def server(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server for one machine; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(min(int(self.headers.get("content-length") or 0), MOST_BYTES + 1))
            status, payload, extra = service.handle(self.command, self.path, body, dict(self.headers))
            data = json.dumps(payload, default=str).encode()
            self.send_response(status)
            for k, v in {"content-type": "application/json; charset=utf-8", "cache-control": "no-store", "content-length": str(len(data)), **extra}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_PUT = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
