"""Token counts and ids of whole texts (operator 4), and the encoder that packing shares.

The vocabulary file is a ``tokenizers`` JSON file and a parameter.  A byte-level BPE file whose ids are its merge order is
run by tiktoken, which gives the same ids several times faster; any other file is run by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one encoding batch holds, and over which a text is encoded in parts.
BATCH_BYTES = 4 << 20
PART_CHARS = 1 << 20

# The public pre-tokenizer pattern of byte-level BPE vocabularies, and the same without its look-ahead, which
# only matters where two white-space characters meet.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: Stands between the texts of a batch, as a special token of its own; a text with its first character is encoded alone.
SEPARATOR = "\0|\0"

_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"\S(?=\s)")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this is the way back."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks by token if the file is a byte-level BPE whose ids follow the merges, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added)
    )
    if not plain:
        return None
    letters, special = _byte_letters(), {t["content"] for t in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if ids != list(range(256, 256 + len(merges))):
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Ids of a text without begin, end or added special tokens; special strings inside a text are one id, as by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        self._slow = None
        if ranks is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._slow = Tokenizer.from_file(path)
            self._slow.no_truncation()
            self._slow.no_padding()
            return
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = tuple(special)
        self._end = 1 + max([*ranks.values(), *special.values()])
        self._own, every = set(special), special | {SEPARATOR: self._end}
        self._joined = [tiktoken.Encoding("joined", pat_str=pattern, mergeable_ranks=ranks, special_tokens=every) for pattern in (PLAIN_PATTERN, BYTE_LEVEL_PATTERN)]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit numbers."""
        if self._slow is not None:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        found = [self._encode(part) for part in parts(text, self._special)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after the other, and their bounds.

        Texts go through the library together, with a special token between them, which ends a text as its real end does.
        Long texts, cut at safe places, and the rare text with a zero character go alone.
        """
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if self._slow is not None:
            for i, e in enumerate(self._slow.encode_batch([x or "" for x in texts], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.uint32)
        else:
            together: tuple[list[int], list[int]] = ([], [])
            for i, x in enumerate(texts):
                if not x:
                    continue
                if len(x) > PART_CHARS or "\0" in x:
                    found[i] = self.ids(x)
                else:
                    together[_TWO_SPACES.search(x) is not None].append(i)
            for encoding, rows in zip(self._joined, together, strict=True):
                if rows:
                    ids = encoding.encode_to_numpy(SEPARATOR.join([texts[i] for i in rows]), allowed_special="all")
                    stops = np.append(np.flatnonzero(ids == self._end), len(ids))
                    starts = np.concatenate([[0], stops[:-1] + 1])
                    for i, a, b in zip(rows, starts.tolist(), stops.tolist(), strict=True):
                        found[i] = ids[a:b]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.concatenate(found) if found else np.zeros(0, np.uint32), bounds

    def _encode(self, part: str) -> np.ndarray:
        """Ids of a text that is encoded alone, in which the separator is ordinary text."""
        return self._joined[_TWO_SPACES.search(part) is not None].encode_to_numpy(part, allowed_special=self._own, disallowed_special=())


def parts(text: str, special: tuple[str, ...] = (), size: int | None = None) -> list[str]:
    """Cut a long text where no token can span the cut: before white space that follows something else."""
    size = size or PART_CHARS
    if len(text) <= size or any(re.search(r"\s", s) for s in special):
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about equal bytes; a longer text stands alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(df: DataFrame, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Add the UTF-8 bytes and tokens of each whole text (null counts as empty: 0 and 0).

    Empty tables give no rows; repeated rows are counted each; columns named like the new ones are replaced.  Texts are
    encoded in batches of about equal bytes, long ones in parts cut where no token can span the cut.  Only lengths leave
    Python: the text column goes in with a row's other columns untouched.
    """
    path = path or default_tokenizer_path()
    kept = [f for f in df.schema.fields if f.name not in (n_bytes, n_tokens, text)]
    schema = T.StructType([*kept, T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start, stop in byte_slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                counts = np.diff(enc.batch(part.column(0).to_pylist())[1])
                size = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(part.column(0)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], size, pa.array(counts, pa.int64())], schema.names)

    plain = df.select(F.col(text), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])  # names with dots do not go into Arrow functions
    return plain.mapInArrow(count, schema)


def over_limit(counts: DataFrame, limit: int = 1024, n_tokens: str = "n_tokens") -> DataFrame:
    return counts.withColumn("over_limit", F.col(n_tokens) > limit)
