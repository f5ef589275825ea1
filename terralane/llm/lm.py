"""Language-model scores from an Elias-Fano n-gram trie (operator 5).

Training runs over the documents once for each level, and moves no text:

1. Words of training texts are counted in each task and dealt by the leading bits of their hash; each shard of the vocabulary
   is written to the shared folder as an Elias-Fano sequence of hashes, whose order numbers the words, with exact counts.
2. For each further level up to ``order``, grams are counted in each task as (context, word), where a context is a gram of the
   level above, found in what is written already.  They go in Elias-Fano form to the shard that holds their place in the order
   of (context, word), and are written as contexts, monotone pointers to their successors, and successors numbered relative to
   their context in one rising sequence, each with its discounted probability on a scale of 65,535 steps.

A gram's number is how many tokens come before it in its level's order, so one number serves as its name, as its place, and,
with its neighbour's, as its count.  Shards cut a level where the contexts' running counts pass equal shares, so the successors
of a very frequent context fill several shards; how many successors such a context has is added up from the shards' ends.  The
number of shards grows with the tokens, so each is of bounded size.  Scoring maps the files into memory and looks up a block's
distinct grams at once, level by level, each relative to its context.

The model interpolates: P_n(w | u) = max(c(u w) - D, 0) / c(u) + D f(u) / c(u) P_n-1(w | u less its first word), f(u) being the
number of different words seen behind u, down to P_1(w) = (c(w) + 1) / (N + V + 1).  Steps of the scale round down, so the
probabilities of all words behind a context never add up to more than 1.  A text begins in the context of its end token.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, remove, shuffle_partitions
from . import words
from .eliasfano import Sequence, encode, pack, unpack

#: Words in the longest gram.
ORDER = 3
DISCOUNT = 0.75
#: log10 probabilities from -SCALE_FLOOR to 0 in STEPS equal steps; the last step stands for 0.
SCALE_FLOOR, STEPS = 16.0, 65_535
TOKENS_PER_SHARD = 16_000_000
#: Entries that a task's counts may hold before they are merged.
MERGE_AT = 3_000_000
#: Blocks of words that are looked up together.
TOGETHER = 4
#: Bytes of shards that a worker keeps of a store that it cannot map.
HELD_BYTES = 256 << 20
END = np.uint64(0)
U64 = np.uint64

_scale = 10.0 ** (-np.arange(STEPS + 1) * (SCALE_FLOOR / STEPS))
_scale[STEPS] = 0.0


def write_shared(path: str, data: bytes) -> None:
    """Write a file to the shared folder under its name at once, so that a task that runs twice leaves one whole file."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        own = f"{url.path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, url.path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(f"{name}.{(own := uuid.uuid4().hex)}") as out:
        out.write(data)
    store.move(f"{name}.{own}", name)


def map_shared(path: str) -> np.ndarray:
    """A shared file's bytes: memory-mapped, or read whole from a store that has no mapping."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return np.asarray(np.memmap(url.path, np.uint8, "r"))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as source:
        return np.frombuffer(source.read(), np.uint8)


class Files:
    """Open shards of one folder; those that are not mapped are dropped, the longest unused first, beyond HELD_BYTES."""

    def __init__(self, folder: str):
        self.folder, self._open = folder, OrderedDict()

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "_open": OrderedDict()}

    def get(self, name: str) -> dict:
        if name not in self._open:
            block = map_shared(f"{self.folder}/{name}")
            held = 0 if urlparse(self.folder).scheme in ("", "file") else len(block)
            while self._open and held + sum(n for _, n in self._open.values()) > HELD_BYTES:
                self._open.popitem(last=False)
            self._open[name] = (unpack(block), held)
        self._open.move_to_end(name)
        return self._open[name][0]


def token_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, bounds by row): word hashes with END behind each text's."""
    held: list[words.Block] = []

    def together() -> tuple[int, np.ndarray, np.ndarray]:
        h = np.concatenate([b.hashes for b in held])
        n = np.concatenate([np.diff(b.bounds) for b in held])
        h[h == END] = U64(1)
        bounds = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(bounds[-1], END, U64)
        word = np.ones(bounds[-1], bool)
        word[bounds[1:] - 1] = False
        out[word] = h
        return held[0].first, out, bounds

    for block in words.blocks(column, lower=True):
        held.append(block)
        if len(held) == TOGETHER:
            yield together()
            held = []
    if held:
        yield together()


class Counts:
    """Counts by (shard, key), merged now and then; they come out in order.

    ``shards`` times ``span``, the keys that a shard may have, tells whether both fit one 64-bit number; if not, pairs are sorted.
    """

    def __init__(self, shards: int, span: int) -> None:
        self._span = U64(span) if shards * span < 1 << 64 else None
        self._one = shards == 1
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._held = self._merged = 0

    def add(self, shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        names = (keys,) if self._one else (shard.astype(U64) * self._span + keys,) if self._span is not None else (keys, shard)
        self._parts.append((*names, counts))
        self._held += len(keys)
        if self._held > max(MERGE_AT, 2 * self._merged):
            self._merge()

    def _merge(self) -> None:
        if len(self._parts) > 1:
            *names, counts = (np.concatenate(x) for x in zip(*self._parts, strict=True))
            order = np.argsort(names[0]) if len(names) == 1 else np.lexsort(names)
            names, counts = [x[order] for x in names], counts[order]
            new = np.zeros(len(counts), bool)
            new[:1] = True
            for x in names:
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            self._parts = [(*(x[first] for x in names), np.add.reduceat(counts, first) if len(first) else counts)]
        self._held = self._merged = len(self._parts[0][0]) if self._parts else 0

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shards, keys and counts."""
        self._merge()
        if not self._parts:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        *names, counts = self._parts[0]
        if self._one:
            return np.zeros(len(counts), np.int64), names[0], counts
        if self._span is None:
            return names[1], names[0], counts
        shard = names[0] // self._span
        return shard.astype(np.int64), names[0] - shard * self._span, counts


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _payload(keys: np.ndarray, counts: np.ndarray, universe: int, **more: np.ndarray) -> bytes:
    base = int(keys[0])
    small = np.minimum(counts, 255).astype(np.uint8)
    large = np.flatnonzero(counts >= 255)
    return pack(encode(keys - U64(base), universe - base) | {"base": np.array([base], U64), "small": small, "large": large, "value": counts[large], **more})


def _merged(payloads: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    total = Counts(1, 1 << 64)
    for a in payloads:
        counts = a["small"].astype(np.int64)
        counts[a["large"]] = a["value"]
        keys = Sequence(a).decode() + a["base"][0]
        total.add(np.zeros(len(keys), np.int64), keys, counts)
    return total.sorted()[1:]


def _sent(shard: np.ndarray, payload) -> Iterator[pa.RecordBatch]:
    """A row for each shard that occurs in a rising column of shards; ``payload`` makes bytes of a range of it."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])], pa.int64()), "payload": pa.array([payload(a, b)], pa.binary())})


class Vocabulary:
    """The trie's first level: numbers and exact counts of words."""

    def __init__(self, files: Files, sizes: list[int], totals: list[int]):
        self.files, self.shards = files, len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
        self.n_words, self.n_tokens = int(self.first[-1]), int(self.before[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted hashes: numbers, -1 for unknown ones; tokens of all words before; the words' own counts, 0 for unknown ones."""
        number = np.full(len(hashes), -1, np.int64)
        before, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(_word_shard(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b and self.first[s] < self.first[s + 1]:
                part = self.files.get(f"words-{s}.bin")
                at = Sequence(part).find(hashes[a:b])
                hit = np.flatnonzero(at >= 0)
                at = at[hit]
                number[a + hit] = at + self.first[s]
                before[a + hit] = part["upto"][at] + self.before[s]
                count[a + hit] = part["upto"][at + 1] - part["upto"][at]
        return number, before, count


class Level:
    """Grams of ``n`` words over ``tokens`` occurrences of their contexts, dealt into ``shards``."""

    def __init__(self, n: int, files: Files, n_words: int, tokens: int, shards: int, last: bool):
        self.n, self.files, self.n_words, self.tokens, self.last = n, files, n_words, tokens, last
        # A shard's keys, (context from the shard's start) * n_words + word, must fit 64 bits.
        self.shards = max(shards, -(-tokens // TOKENS_PER_SHARD), (tokens * n_words >> 62) + 1)
        self.span = (tokens // self.shards + 3) * n_words
        self.totals = np.zeros(self.shards, np.int64)  # occurrences by shard
        self._before = np.zeros(self.shards + 1, np.int64)
        self._ends, self._ends_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def written(self, totals: dict[int, int], ends: dict[int, int]) -> None:
        """Say what the shards hold: occurrences, and the successors of contexts at the shards' ends."""
        for s, n in totals.items():
            self.totals[s] = n
        self._before = np.concatenate([[0], np.cumsum(self.totals)]).astype(np.int64)
        order = sorted(ends.items())
        self._ends, self._ends_n = np.array([c for c, _ in order], np.int64), np.array([n for _, n in order], np.int64)

    @property
    def occurrences(self) -> int:
        return int(self._before[-1])

    def start(self, shard: np.ndarray) -> np.ndarray:
        return np.floor(shard * (self.tokens / self.shards)).astype(np.int64)

    def place(self, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards in the order of (context, word), by the context's place among all tokens and the word's within it; and keys.

        At most one context begins before its shard does; it is number 0 there.
        """
        at = context + count * (word / max(self.n_words, 1))
        shard = np.minimum((at * (self.shards / max(self.tokens, 1))).astype(np.int64), self.shards - 1)
        return shard, np.maximum(context - self.start(shard) + 1, 0).astype(U64) * U64(self.n_words) + word.astype(U64)

    def write(self, shard: int, payloads: list[dict]) -> tuple[int, list[tuple[int, int]]]:
        """Write one shard; its occurrences, and (context, successors) at its ends."""
        keys, counts = _merged(payloads)
        v = U64(self.n_words)
        relative, word = keys // v, keys % v
        first = np.flatnonzero(np.concatenate([[True], relative[1:] != relative[:-1]]))
        run = np.diff(np.append(first, len(keys)))
        # What follows a context adds up to its count, but for contexts that other shards share; those came with theirs.
        of_context = np.add.reduceat(counts, first)
        for a in payloads:
            for k in (0, -1):
                here = int(np.searchsorted(relative[first], a["edges"][k, 0]))
                of_context[here] = a["edges"][k, 2]
        head = next((int(a["edges"][0, 1]) for a in payloads if a["edges"][0, 0] == 0), -1)
        local = np.repeat(np.arange(len(first), dtype=np.int64), run).astype(U64) * v + word
        arrays = encode(relative[first], self.tokens // self.shards + 3, "c") | encode(np.append(first, len(keys)), len(keys) + 1, "p") | encode(local, len(first) * self.n_words, "s")
        upto = np.concatenate([[0], np.cumsum(counts)])
        if not self.last:  # grams of the last level are no contexts, so need no number
            arrays["upto"] = upto.astype(np.uint32 if upto[-1] < 1 << 32 else np.int64)
        arrays["quantum"] = quantise((counts - DISCOUNT) / np.repeat(of_context, run))
        write_shared(f"{self.files.folder}/level{self.n}-{shard}.bin", pack(arrays))
        base = int(self.start(np.array([shard]))[0])
        name = lambda i: head if relative[first[i]] == 0 else int(relative[first[i]]) - 1 + base
        return int(upto[-1]), [(name(i), int(run[i])) for i in ((0, -1) if len(first) > 1 else (0,))]

    def find(self, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of grams in the order of (context, word), words that are not known being -1: the discounted probability, 0 if
        unseen; the context's successors; the gram's number and count, 0 if unseen or on the last level."""
        p, follow = np.zeros(len(context)), np.zeros(len(context), np.int64)
        before, own = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        shard, key = self.place(context, count, np.maximum(word, 0))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        v = U64(self.n_words)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b or not self.totals[s := int(shard[a])]:
                continue
            part = self.files.get(f"level{self.n}-{s}.bin")
            relative, w = key[a:b] // v, word[a:b]
            first = np.flatnonzero(np.concatenate([[True], relative[1:] != relative[:-1]]))
            at = Sequence(part, "c").find(relative[first])
            here, pointers = np.maximum(at, 0), Sequence(part, "p")
            n = np.where(at >= 0, (pointers.values(here + 1) - pointers.values(here)).astype(np.int64), 0)
            run = np.diff(np.append(first, b - a))
            at, follow[a:b] = np.repeat(at, run), np.repeat(n, run)
            live = np.flatnonzero((at >= 0) & (w >= 0))
            j = Sequence(part, "s").find(at[live].astype(U64) * v + w[live].astype(U64))
            hit, j = a + live[j >= 0], j[j >= 0]
            p[hit] = _scale[part["quantum"][j]]
            if not self.last:
                before[hit] = part["upto"][j] + self._before[s]
                own[hit] = part["upto"][j + 1] - part["upto"][j].astype(np.int64)
        if len(self._ends):
            k = np.minimum(np.searchsorted(self._ends, context), len(self._ends) - 1)
            follow = np.where(self._ends[k] == context, self._ends_n[k], follow)
        return p, follow, before, own


def quantise(p: np.ndarray) -> np.ndarray:
    """Steps of the scale, rounded so that no probability grows."""
    return np.clip(np.ceil(-np.log10(p) * (STEPS / SCALE_FLOOR)), 0, STEPS).astype(np.uint16)


class Trie:
    """A vocabulary and the levels above it."""

    def __init__(self, vocabulary: Vocabulary, levels: list[Level]):
        self.words, self.levels = vocabulary, levels

    def walk(self, tokens: np.ndarray, bounds: np.ndarray, top: int | None = None) -> Walk:
        """Look up all grams of some texts, level by level, up to those of ``top`` words."""
        w = Walk(self.words, tokens, bounds)
        for level in self.levels[: len(self.levels) if top is None else top - 1]:
            w.step(level)
        return w


class Walk:
    """The grams that end at each token of a block: of each level, the distinct ones, found once, and which a token has.

    Distinct grams are numbered within the block, so their keys, (gram of the level before, word), always fit 64 bits.
    """

    def __init__(self, vocabulary: Vocabulary, tokens: np.ndarray, bounds: np.ndarray):
        self._first = bounds[:-1]
        known, self._word = np.unique(tokens, return_inverse=True)
        self._number, self._before, self._count = vocabulary.find(known)
        self._gram = self._word
        self._n = 1
        self.counts = self._count[self._word]
        total = vocabulary.n_tokens + vocabulary.n_words + 1
        self.base = ((self._count + 1) / total)[self._word]
        self.p = self.base

    def _keys(self) -> np.ndarray:
        """Of the next level: (context, word) by token, negative where a text has no such context."""
        context = np.empty_like(self._gram)
        context[1:] = self._gram[:-1]
        context[self._first] = 0 if self._n == 1 else -1  # END is the least hash, so word 0
        return context * len(self._number) + self._word

    def step(self, level: Level) -> None:
        """Go to the next level: interpolate ``p`` and take up the grams found."""
        keys, gram = np.unique(self._keys(), return_inverse=True)
        context, word = keys // len(self._number), keys % len(self._number)
        of_context = np.where(context >= 0, self._count[context], 0)
        live = np.flatnonzero(of_context)
        seen, rest = np.zeros(len(keys)), np.ones(len(keys))
        before, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(live):
            seen[live], follow, before[live], count[live] = level.find(self._before[context[live]], of_context[live], self._number[word[live]])
            rest[live] = DISCOUNT * follow / of_context[live]
        self.p = seen[gram] + rest[gram] * self.p
        self._gram, self._before, self._count, self._n = gram, before, count, self._n + 1

    def grams(self, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next level's distinct grams, in order: shards, keys, how often each occurs, contexts and the contexts' counts."""
        keys = np.sort(self._keys())
        keys = keys[np.searchsorted(keys, 0) :]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(keys)))
        context, word = keys[first] // len(self._number), keys[first] % len(self._number)
        real = np.flatnonzero(self._count[context])  # the first words of a text have no long context
        context, word, times = context[real], word[real], times[real]
        before, count = self._before[context], self._count[context]
        return *level.place(before, count, self._number[word]), times, before, count


def _train_words(docs: DataFrame, text: str, files: Files) -> Vocabulary:
    shards = shuffle_partitions(docs.sparkSession)
    folder = files.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(1, 1 << 64)
        for batch in batches:
            for _, tokens, _ in token_blocks(batch.column(0)):
                keys, counts = np.unique(tokens, return_counts=True)
                total.add(np.zeros(len(keys), np.int64), keys, counts)
        _, keys, counts = total.sorted()
        yield from _sent(_word_shard(keys, shards), lambda a, b: _payload(keys[a:b], counts[a:b], 1 << 64))

    def write(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = _merged([unpack(np.frombuffer(raw, np.uint8)) for raw in table["payload"].to_pylist()])
        write_shared(f"{folder}/words-{s}.bin", pack(encode(keys, 1 << 64) | {"upto": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)}))
        return pa.table({"shard": pa.array([s], pa.int64()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    rows = docs.select(text).mapInArrow(count, "shard long, payload binary").groupBy("shard").applyInArrow(write, "shard long, n long, tokens long").collect()  # one row per shard
    n, tokens = {r["shard"]: r["n"] for r in rows}, {r["shard"]: r["tokens"] for r in rows}
    return Vocabulary(files, [n.get(s, 0) for s in range(shards)], [tokens.get(s, 0) for s in range(shards)])


def _train_level(docs: DataFrame, text: str, model: Trie, level: Level) -> None:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(level.shards, level.span)
        edges: dict[int, list] = {}  # by shard, its first and last context: (number in the shard, name, count)
        v = U64(level.n_words)
        for batch in batches:
            for _, tokens, bounds in token_blocks(batch.column(0)):
                shard, keys, times, context, of_context = model.walk(tokens, bounds, level.n - 1).grams(level)
                total.add(shard, keys, times)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
                for a, b in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist(), strict=True):
                    if a <= b:
                        low, high = ((int(keys[i] // v), int(context[i]), int(of_context[i])) for i in (a, b))
                        held = edges.setdefault(int(shard[a]), [low, high])
                        held[0], held[1] = min(held[0], low), max(held[1], high)
        shard, keys, counts = total.sorted()
        yield from _sent(shard, lambda a, b: _payload(keys[a:b], counts[a:b], int(keys[b - 1]) + 1, edges=np.array(edges[int(shard[a])], np.int64).reshape(-1)))

    def write(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        payloads = [unpack(np.frombuffer(raw, np.uint8)) for raw in table["payload"].to_pylist()]
        total, ends = level.write(s, [a | {"edges": a["edges"].reshape(2, 3)} for a in payloads])
        return pa.table({"shard": pa.array([s] * len(ends), pa.int64()), "total": [total] * len(ends), "context": [c for c, _ in ends], "successors": [n for _, n in ends]})

    schema = "shard long, total long, context long, successors long"
    rows = docs.select(text).mapInArrow(count, "shard long, payload binary").groupBy("shard").applyInArrow(write, schema).collect()  # two rows per shard
    ends: dict[int, int] = {}
    for r in rows:
        ends[r["context"]] = ends.get(r["context"], 0) + r["successors"]
    level.written({r["shard"]: r["total"] for r in rows}, ends)


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Trie:
    """Count grams of up to ``order`` words of ``docs`` and write each level to the shared folder.  ``remove_model`` deletes it."""
    spark = docs.sparkSession
    files = Files(new_path(spark, "trie"))
    vocabulary = _train_words(docs, text, files)
    model, tokens = Trie(vocabulary, []), vocabulary.n_tokens
    for n in range(2, order + 1):
        level = Level(n, files, vocabulary.n_words, tokens, shuffle_partitions(spark), n == order)
        if not tokens:
            break
        _train_level(docs, text, model, level)
        model.levels.append(level)
        tokens = level.occurrences
    return model


def remove_model(docs: DataFrame, model: Trie) -> None:
    """Delete a model's files once nothing scores by it any more."""
    remove(docs.sparkSession, model.words.files.folder)


def score(docs: DataFrame, model: Trie, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """*keep, n_tokens, n_known, train_tokens, base_score, score of each whole text (null: empty, so its end token alone)."""
    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kept, "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tokens, bounds in token_blocks(batch.column(0)):
                found = model.walk(tokens, bounds)
                n = np.diff(bounds)
                rest = batch.slice(row, len(n))
                known, base, own = (np.add.reduceat(x, bounds[:-1]) for x in ((found.counts > 0).astype(np.int64), np.log10(found.base), np.log10(found.p)))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), model.words.n_tokens)), pa.array(base), pa.array(own)], names)

    return docs.select(F.col(text), *keep).mapInArrow(add, schema)


def held_out(doc_id: str = "doc_id", of: int = 7, which: int = 2):
    """Whether the CRC-32 of the id as text leaves remainder ``which``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == which


def scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the documents that are not held out, and score all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Null and empty texts have one token, their end.
    Repeated rows train and are scored each; other columns are not read; an empty table gives no rows; without training
    documents every probability is 1.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    return score(docs, train(docs.where("not held_out"), order=order), ("doc_id", "held_out"))
