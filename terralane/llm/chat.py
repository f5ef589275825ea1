r"""Chat formatting by columnar byte assembly (operator 1).

A turn is written ``### ROLE: TEXT</turn>\n``.  Inside roles and texts a backslash stands before every backslash and before
every string that could be read as markup, so that any content reads back as it was.

Conversations are dealt by id and sorted by turn within their part of the table; formatting then streams over Arrow batches.
A conversation that spans batches continues in further chunks, so memory holds a batch at a time, never a conversation.  Its
turns' digest runs over the whole in order, so a very long one is one task's work, but never one task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
TEXT_MARKS = ("</turn>", "### ")
ROLE_MARKS = (":",)
TRAINED_ROLE = "assistant"

#: Bytes that one assembly holds at most, but for a single longer turn.
BLOCK_BYTES = 2 << 20

_TURN = re.compile(rb"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def escape(column: pa.Array, marks: tuple[str, ...]) -> pa.Array:
    """Reversible: a backslash before each backslash and each mark."""
    column = pc.replace_substring(column, "\\", "\\\\")
    for mark in marks:
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and offsets, both from 0."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out[at[i]:]``, all segments at once."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of consecutive turns in one buffer; bounds of the turns; start and end of each turn's content."""
    role, role_at = _bytes_of(escape(roles, ROLE_MARKS))
    text, text_at = _bytes_of(escape(texts, TEXT_MARKS))
    n = len(roles)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, AFTER_ROLE, CLOSE)]
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    lengths = len(fixed[0]) + role_n + len(fixed[1]) + text_n + len(fixed[2])
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    starts = bounds[:-1]
    out = np.empty(int(bounds[-1]), np.uint8)
    role_to = starts + len(fixed[0])
    text_to = role_to + role_n + len(fixed[1])
    close_to = text_to + text_n
    for at, mark in zip((starts, role_to + role_n, close_to), fixed, strict=True):
        out[at[:, None] + np.arange(len(mark))] = mark
    _scatter(out, role_to, role, role_at)
    _scatter(out, text_to, text, text_at)
    assert n == len(starts)
    return out, bounds, text_to, close_to


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED_ROLE) -> DataFrame:
    """Format conversations: conv_id, chunk, formatted (bytes), loss_start, loss_end (byte spans of the trained role's contents).

    Turns come by number, nulls first, then by role and text, so ties and repeated rows have one order and each stays.  A null
    role or text is empty; every row with a null id is a conversation of its own, so such rows are dealt anywhere; other
    columns are not read; an empty table gives no rows.  Most conversations have one chunk, 0; a longer one, and one with a
    very long turn, has further ones, numbered in order, none of which cuts a turn.
    """
    schema = T.StructType(
        [T.StructField("conv_id", df.schema[conv_id].dataType), T.StructField("chunk", T.LongType()), T.StructField("formatted", T.BinaryType())]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("loss_start", "loss_end")]
    )

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64)
        part, start = np.cumsum(size) // BLOCK_BYTES, 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = object(), 0
        for batch in (b for whole in batches for b in blocks(whole)):
            ids = batch.column(0).to_pylist()
            buffer, bounds, begin, end = assemble(pc.fill_null(batch.column(1), ""), pc.fill_null(batch.column(2), ""))
            learns = np.asarray(pc.fill_null(pc.equal(batch.column(1), trained), False))
            firsts = [i for i in range(len(ids)) if i == 0 or ids[i] is None or ids[i] != ids[i - 1]]
            rows: list[list] = [[], [], [], [], []]
            for a, b in zip(firsts, [*firsts[1:], len(ids)], strict=True):
                chunk = chunk + 1 if ids[a] == last and last is not None else 0
                last = ids[a]
                mine = np.flatnonzero(learns[a:b]) + a
                for column, value in zip(rows, (ids[a], chunk, buffer[bounds[a] : bounds[b]].tobytes(), (begin[mine] - bounds[a]).tolist(), (end[mine] - bounds[a]).tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in rows[3:])], schema.names
            )

    turns = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    spread = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # rows of a null id have nothing to meet
    dealt = turns.repartition("conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(write, schema)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts as they were before formatting."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at} of a formatted conversation")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def digest(chunks: DataFrame, in_order: bool = False) -> DataFrame:
    """Read formatted chunks back: one row of counts and digests for each conversation.

    ``in_order``: the chunks come straight from :func:`format_chat`; those of a table that was stored are dealt and sorted
    again.  Chunks of a null id are conversations each, an empty table gives no rows, texts and roles may be empty.
    """
    if not in_order:
        chunks = chunks.repartition("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())).sortWithinPartitions("conv_id", "chunk")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def done(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows], strict=True))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            id_type, out = batch.schema.field(0).type, []
            for key, chunk, raw, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk == 0:
                    if held is not None:
                        out.append(held)
                    held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(raw):
                    held[1] += 1
                    held[2].update(role + b"\n" + text + b"\n")
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(raw[a:b])
                    held[3] += len(text.decode())
                    held[4].update(text)
                held[5] += len(raw.decode())
            if out:
                yield done(out)
        if held is not None:
            yield done([held])

    kinds = {"conv_id": chunks.schema["conv_id"].dataType, "n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    return chunks.mapInArrow(read, T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), ':', '\:')) + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ')) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM e) GROUP BY conv_id, own
"""
