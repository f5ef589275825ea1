"""Quality by importance resampling (operator 6).

Two generative models over hashed word n-grams, one of labelled good documents (the target) and one of all documents (raw),
give each document a log importance ratio.  Adding Gumbel noise, fixed by the document's id, and keeping the k highest is a
sample of k documents without replacement with probabilities in proportion to the ratios.  k is the share of labelled rows that
are of good quality, times the number of documents.

Both models have BUCKETS counts whatever the corpus, so the weights are safe to send to every executor.  The models' counts
cover all documents; the target's are fitted on at most FIT_ROWS labels, chosen by the hash of their id, while the share covers all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, remove
from . import words

BUCKETS = 1 << 16
FIT_ROWS = 50_000
#: Pseudo-counts that pull a rare bucket's ratio towards 1.
SHRINK = 5.0
SEED = 17
#: Steps into which a range of keys is cut when the k-th highest is looked for.
STEPS = 4096


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, buckets, row of each, rows) of blocks: words cut at punctuation, as they are, and pairs of neighbours."""
    for block in words.blocks(column, lower=False, by_class=True):
        h, row = block.hashes, block.rows()
        inside = row[1:] == row[:-1]
        found = np.concatenate([h, words.pair(h[:-1], h[1:])[inside]]) % np.uint64(BUCKETS)
        yield block.first, found.astype(np.int64), np.concatenate([row, row[1:][inside]]), len(block)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, target) of all labelled ids; rows without a label or id are left out.

    Good: quality 1; target: good and not toxic.  An id that is labelled more than once counts by its lowest quality and
    highest toxicity.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return rows.select("doc_id", (F.col("q") == 1).alias("good"), ((F.col("q") == 1) & (F.col("t") == 0)).alias("target"))


def label_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """At most ``fit_rows`` rows of :func:`labelled`."""
    return labelled(labels).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows)


def good_share(docs: DataFrame, labels: DataFrame) -> float:
    """The share of all labelled documents here that are good (1 if none is labelled)."""
    share = docs.select("doc_id").join(labelled(labels), "doc_id").agg(F.avg(F.col("good").cast("int"))).first()[0]
    return 1.0 if share is None else float(share)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and :func:`good_share`."""
    sample, path = materialize(label_sample(labels, fit_rows), "labels")
    # At most fit_rows rows.
    flagged = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = np.asarray(batch.column(1).fill_null(False))
            for first, bucket, row, _ in features(batch.column(0)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[row + first]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": target[at]})

    counts = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most BUCKETS rows
    remove(docs.sparkSession, path)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(counts["bucket"]).astype(int)
    raw[at], target[at] = np.asarray(counts["raw"]), np.asarray(counts["target"])
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + SHRINK) / (expected + SHRINK)), good_share(docs, labels)


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Standard Gumbel noise from 52 bits of the id's hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """*keep, n_features, log_ratio of each whole text; 0 and 0 for null and empty ones.  A text that is kept is sent once."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_features", T.LongType()), T.StructField("log_ratio", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers
    columns = [*keep, *([] if text in keep else [text])]
    at = columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in words.tidy(batches):
            for first, bucket, row, n in features(batch.column(at)):
                total, size = np.bincount(row, weights=w[bucket], minlength=n), np.bincount(row, minlength=n)
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(size.astype(np.int64)), pa.array(total)], schema.names)

    return docs.select(*columns).mapInArrow(add, schema)


def kth_highest(table: DataFrame, key: str, k: int) -> float:
    """The k-th highest key (-inf if there are fewer), by counts over ever narrower ranges; keys are never sorted or gathered."""
    low, high, left = -np.inf, np.inf, k
    ends = table.agg(F.min(key), F.max(key), F.count(key)).first()
    if ends[2] < k or k <= 0:
        return -np.inf if k > 0 else np.inf
    low, high = ends[0], ends[1]
    while low < high:
        step = (high - low) / STEPS
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(step)), F.lit(STEPS - 1))
        rows = table.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()  # at most STEPS rows
        for r in sorted(rows, key=lambda r: -r["cell"]):
            if r["n"] >= left:
                low, high = r["a"], r["b"]
                break
            left -= r["n"]
    return low


def _threshold(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[np.ndarray, DataFrame, str, float]:
    """The weights, each row's scores (written, without texts) and their path, and the last key that is kept."""
    weights, share = fit(docs, labels, fit_rows)
    scored, path = materialize(_keyed(score(docs, weights, ("doc_id",))), "importance")
    return weights, scored, path, kth_highest(scored, "gumbel_key", int(round(share * scored.count())))


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.withColumn("gumbel_key", F.col("log_ratio") + gumbel("doc_id"))


def select(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, n_features, log_ratio, gumbel_key and kept of every row of ``docs``.

    Without labelled documents all ratios are 1 and all rows are kept; an empty table gives no rows.  Rows that tie with the
    last one kept are kept too, so repeated rows share one verdict.  Null ids share one noise value; null and empty texts have
    ratio 1, long ones are counted and scored whole; labels without an id or a quality count for nothing; other columns are
    not read.
    """
    _, scored, _, last = _threshold(docs, labels, fit_rows)
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(last)).select("doc_id", "n_features", "log_ratio", "gumbel_key", "kept")


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`select` keeps, with all their columns, whatever these are called.

    Nulls, ties, repeated rows, long texts and empty tables are as there.  Texts are scored once for the threshold and once
    more to be filtered, so that no copy of them is written.
    """
    weights, _, path, last = _threshold(docs, labels, fit_rows)
    remove(docs.sparkSession, path)
    places = {f"c{i}": c for i, c in enumerate(docs.columns)}
    wide = docs.select("doc_id", *[F.col(f"`{c}`").alias(k) for k, c in places.items()])
    scored = _keyed(score(wide, weights, ("doc_id", *places), f"c{docs.columns.index('text')}"))
    return scored.where(F.col("gumbel_key") >= F.lit(last)).select(*[F.col(k).alias(c) for k, c in places.items()])
