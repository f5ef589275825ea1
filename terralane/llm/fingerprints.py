"""Quartile bucket digests of documents (operator 10).

Each run of three bytes is hashed to one of 128 buckets, as are the first and third of it with the fourth.  A bucket's code,
0 to 3, says in which quartile of the document's own bucket counts its count lies.  The digest is the codes, two bits each in
hexadecimal, behind two digits for the length on a logarithmic scale.  Digests of similar texts differ in few codes, and the
score between digests is bounded: 1 for equal ones, 0 at or beyond the difference that unrelated codes have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, remove, shuffle_partitions
from .words import joined, mix, row_slices

BUCKETS = 128
#: Growth of length that adds one to the length digit pair.
LENGTH_STEP = 1.1
#: Mean difference of a code between unrelated digests (codes are 0..3, a quarter of the buckets each): 1.25.
UNRELATED = 1.25
LENGTH_WEIGHT = 0.02

_TABLES = (mix(np.arange(1, 769, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint16).reshape(3, 256)


def _buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    h = _TABLES[0][a] + np.uint16(3) * _TABLES[1][b] + np.uint16(salt)
    h ^= h >> np.uint16(7)
    h = h * np.uint16(0x9E3B) + _TABLES[2][c]
    h ^= h >> np.uint16(9)
    h = h * np.uint16(0x2C1B)
    return (h >> np.uint16(9)).astype(np.int64)


def bucket_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts by row and bucket, bytes by row) of blocks of rows."""
    for first, stop in row_slices(column):
        data, offsets = joined(column.slice(first, stop - first))
        n = stop - first
        size = np.diff(offsets) - 1  # a space stands behind each text
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        left = np.repeat(offsets[1:] - 1, np.diff(offsets)) - np.arange(len(data))  # bytes from here to the text's end
        counts = np.zeros(n * BUCKETS, np.int64)
        for salt, places in enumerate(((0, 1, 2), (0, 2, 3))):
            at = np.flatnonzero(left > places[-1])
            if len(at):
                bucket = _buckets(*(data[at + p] for p in places), salt)
                counts += np.bincount(row[at] * BUCKETS + bucket, minlength=n * BUCKETS)
        yield first, counts.reshape(n, BUCKETS), size


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes by row and bucket, length digits by row, and the digests as strings."""
    codes, lengths = [np.zeros((0, BUCKETS), np.uint8)], [np.zeros(0, np.int64)]
    for _, counts, size in bucket_counts(column):
        order = np.sort(counts, axis=1)
        q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes.append((counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8))
        lengths.append(np.minimum(255, np.floor(np.log1p(size) / np.log(LENGTH_STEP))).astype(np.int64))
    code, length = np.concatenate(codes), np.concatenate(lengths)
    quads = code.reshape(len(code), BUCKETS // 4, 4)
    packed = (quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]).astype(np.uint8)
    return code, length, [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(length.tolist(), packed, strict=True)]


def likeness(code_a: np.ndarray, length_a: np.ndarray, code_b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """1 - difference, in [0, 1]: summed differences of codes against those of unrelated digests, plus the lengths'."""
    codes = np.abs(code_a.astype(np.int16) - code_b).sum(axis=1) / (BUCKETS * UNRELATED)
    return np.clip(1 - codes - LENGTH_WEIGHT * np.abs(length_a - length_b), 0, 1)


def parse(digest: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and length of one digest, as rows for :func:`likeness`."""
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(1, -1), raw[:1].astype(np.int64)


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the digest of each whole text (null: of an empty one); equal texts have equal digests."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(digests(batch.column(0))[2], pa.string())], schema.names)

    return df.select(F.col(text).alias("_text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]).mapInArrow(add, schema)


def _range_of(key: Column, bounds: Column) -> Column:
    """How many bounds are not above a key, less one: by steps of about the root of their number, then within a step."""
    step = F.ceil(F.sqrt(F.size(bounds))).cast("int")
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    coarse = below(F.transform(F.sequence(F.lit(0), F.size(bounds) - 1, step), lambda i: F.get(bounds, i))) - 1
    return (coarse * step + below(F.slice(bounds, coarse * step + 1, step)) - 1).cast("int")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, role, doc_id, text) dealt by ranges of the id and sorted, so that each row's next follows it.

    The first row of each range is also sent, with role 1, behind the last row of the range before (of the first range: behind
    the last of all).  Ids may be of any type that can be ordered; null ids come first; rows of one id come in order of their
    text's hash, which also cuts ranges, so that an id of many rows fills several.
    """
    spark = df.sparkSession
    tie = F.xxhash64("text")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.col("tie").alias("tie"))
    parts = shuffle_partitions(spark)
    keys, keys_path = materialize(docs.select("doc_id", tie.alias("tie")), "range-keys")
    dealt = keys.select(key.alias("key")).repartitionByRange(parts, "key")
    firsts = dealt.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("key").alias("first"))  # one row per range
    bounds, _ = materialize(firsts.agg(F.array_sort(F.collect_set("first")).alias("bounds")), "range-bounds")
    remove(spark, keys_path)
    # One row, of one bound per range.
    keyed = docs.withColumn("tie", tie).crossJoin(F.broadcast(bounds)).withColumn("part", _range_of(key, F.col("bounds")))
    heads = bounds.select(F.size("bounds").alias("n"), F.posexplode("bounds").alias("at", "head"))
    heads = heads.select("head", F.pmod(F.col("at") - 1, F.col("n")).cast("int").alias("h_part"))
    sent = keyed.withColumn("key", key).join(F.broadcast(heads), F.col("key") == F.col("head"), "left")
    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("role"))
    copies = F.when(F.col("h_part").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("h_part").alias("to"), F.lit(1).alias("role"))))
    rows = sent.select("doc_id", "text", "tie", F.explode(copies).alias("c")).select(F.col("c.to").alias("part"), F.col("c.role").alias("role"), "doc_id", "tie", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role", "doc_id", "tie").select("part", "role", "doc_id", "text")


def edited_likeness(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each document, of an edited copy and of the next document, and how alike they are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document by
    ascending id (after the last: the first; a lone document is its own next).  Null texts are empty, long ones are taken whole.
    Ids of any type that can be ordered, nulls first; rows of one id stand in order of their text's hash.  Repeated rows stay,
    an empty table gives no rows, other columns are not read.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    id_type = df.schema[doc_id].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_type, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last row seen, whose next may be in the coming batch
        for whole in batches:
            for a, b in row_slices(whole.column(3)):
                batch = whole.slice(a, b - a)
                if waiting is not None:
                    batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
                out = rows_of(batch)
                if out is not None:
                    yield out
                waiting = batch.slice(batch.num_rows - 1)

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        part, role = (np.asarray(batch.column(i)) for i in (0, 1))
        n = batch.num_rows
        done = np.flatnonzero((role[:-1] == 0) & (part[1:] == part[:-1])) if n > 1 else np.zeros(0, int)
        if not len(done):
            return None
        column = pc.fill_null(batch.column(3), "")
        texts = column.to_pylist()
        code, length, found = digests(column)
        edited = []
        for i in done.tolist():
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        e_code, e_length, e_found = digests(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(2).take(pa.array(done)),
                pa.array([len(texts[i]) for i in done.tolist()], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([found[i] for i in done.tolist()]),
                pa.array(e_found),
                pa.array(likeness(code[done], length[done], e_code, e_length)),
                pa.array(likeness(code[done], length[done], code[done + 1], length[done + 1])),
            ],
            names,
        )

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return with_next(df, doc_id, text).mapInArrow(compare, schema)
