"""Best-fit packing of token sequences by a plan over lengths (operator 7).

1. Each text is encoded once; only its pieces' lengths and checksums leave Python, and that small table is written to the
   shared folder.
2. The histogram of piece lengths has at most ``max_len`` entries whatever the corpus, so best-fit decreasing runs on counts:
   equal sequences are handled as one group with a multiplicity.
3. A piece takes the slot that the plan gives to its rank within its length.  Ranks come from counts by (length, part of the
   table), so that no length, however common, is numbered by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .tokens import byte_slices, default_tokenizer_path, encoder
from .words import tidy

#: Rows of a plan (48 bytes each) up to which it is sent to every executor.
BROADCAST_ROWS = 500_000
PLAN_SCHEMA = "length long, first long, stop long, sequence long, per_sequence long, place long"


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for a first one that takes the remainder."""
    first = n % max_len or max_len
    return [(0, first), *((s, max_len) for s in range(first, n, max_len))]


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` behind them: piece, start, length, ids_crc32.  A null text is empty."""
    path = path or default_tokenizer_path()
    id_type = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in tidy(batches):
            for at, stop in byte_slices(batch.column(1)):
                rows, out = [], []
                ids, bounds = enc.batch(batch.column(1).slice(at, stop - at).to_pylist())
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                for k in range(stop - at):
                    n = int(bounds[k + 1] - bounds[k])
                    for p, (start, length) in enumerate(cut(n + 1, max_len)):
                        here = int(bounds[k]) + start
                        last = start + length > n  # this piece has the end id
                        check = zlib.crc32(raw[4 * here : 4 * (here + length - last)])
                        rows.append(at + k)
                        out.append((p, start, length, zlib.crc32(end, check) if last else check))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    schema.names,
                )

    return df.select(doc_id, text).mapInArrow(encode, schema)


def plan(counts: dict[int, int], max_len: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Rows (length, first, stop, sequence, per_sequence, place): pieces of that length with rank in [first, stop) go, in order,
    ``per_sequence`` to each sequence from ``sequence`` on, the first of them at ``place``.

    Sequences with the same room form groups (first sequence, number).  A piece goes to the tightest room that holds it, and
    the room that is left then is tighter still, so each sequence of the tightest group is filled before the next is touched.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(max_len + 1, bool)
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = int(np.argmax(rooms[length:])) + length
            if rooms[fit]:
                first, n = groups[fit].pop()
                if not groups[fit]:
                    rooms[fit] = False
            else:
                fit = max_len
                n = -(-left // (fit // length))
                first, opened = opened, opened + n
            each = fit // length
            whole = min(n, left // each)
            parts = [(first, whole, each)] if whole else []
            if whole < n and left - whole * each:
                parts.append((first + whole, 1, left - whole * each))
            for start, number, per in parts:
                rows.append((length, rank, rank + number * per, start, per, max_len - fit))
                rank, left = rank + number * per, left - number * per
                room = fit - per * length
                if room:
                    groups.setdefault(room, []).append((start, number))
                    rooms[room] = True
            used = sum(number for _, number, _ in parts)
            if used < n:
                groups.setdefault(fit, []).append((first + used, n - used))
                rooms[fit] = True
    return rows


def place(found: DataFrame, order: list[str], max_len: int = 2048) -> DataFrame:
    """Give each row of ``found`` (column ``length``) a sequence_id and offset.  ``found`` gets written and read again."""
    spark: SparkSession = found.sparkSession
    kept = found.columns
    table, _ = materialize(found.withColumn("_part", F.spark_partition_id()), "pieces")
    by_part = table.groupBy("length", "_part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("length", "_part").orderBy(*order)
    ranked = table.withColumn("_row", F.row_number().over(within)).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_from") + F.col("_row") - 1)
    rows = plan(histogram, max_len)
    slots = spark.createDataFrame(rows, PLAN_SCHEMA)
    if len(rows) <= BROADCAST_ROWS:  # some hundred thousand at the very most at 2048 ids; beyond, Spark's own choice of join
        slots = F.broadcast(slots)
    at = F.col("_rank") - F.col("first")
    return (
        ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("stop")))
        .select(*[ranked[c] for c in kept], (F.col("sequence") + F.floor(at / F.col("per_sequence"))).alias("sequence_id"), (F.col("place") + at % F.col("per_sequence") * ranked["length"]).alias("offset"))
    )


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` ids; one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Repeated rows and null ids are packed like others, a null
    or empty text is its end id alone, a long text is encoded whole, an empty table gives no rows, other columns of ``df`` are
    not read.
    """
    found = pieces(df, doc_id, text, max_len, end_id, path)
    return place(found, [F.col(doc_id).asc_nulls_first(), "piece", "ids_crc32"], max_len)
