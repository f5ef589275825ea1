"""Near-duplicate documents by SetSketch registers (operator 8).

1. A document's set of shingles becomes ``REGISTERS`` registers: exponentially spaced minima, truncated to a byte.  Registers
   of a union are the maxima of the parts' registers, so sketches merge; two sets' registers agree about as often as their
   Jaccard similarity says.  Equal sets are found by a digest of the set and go on as one representative.
2. Bands of ``BAND`` registers are hashed.  Documents that share a band are candidates: at similarity 0.8 all 42 bands differ
   with probability about 3e-6, and less often the more similar they are.
3. A document is paired with a few representatives of its bands' groups only, so a group of thousands gives a few pairs for each
   member.  A joint maximum-likelihood estimate of the registers drops hopeless pairs, and the rest are verified on the full
   sets of shingles.
4. Verified links are joined to components.  Where a group still spans components, its members outside the group's main
   component are compared with all members of other components, in blocks of bounded size, until a link joins the two; such
   links are verified too.  So no two components stay apart that share a link, and copies are never expanded into all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..storage import materialize, remove, scratch
from . import words

REGISTERS, BAND = 256, 6
#: A register says how many times the unit shrinks by this factor before it reaches the smallest value.
BASE = 1.1
#: What registers start from, so that a lone element's largest values still fit (36 = BASE ** 38).
OFFSET = 40
#: Estimates under this share of the wanted similarity are not verified: at 256 registers, 4 standard deviations below.
SLACK = 0.875
BLOCK_ROWS = 1000
#: Classes in groups of several rows (three numbers each) up to which they are sent to every executor.
SENT_CLASSES = 1_000_000
#: Similarity from 32-bit hashes is within this of the true one.
UNSURE = 0.005
#: Orders by which a group's representatives are chosen: class ids xor each of these.
ORDERS = (0, 0x3C6EF372FE94F82B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC908)

_LEVEL_ENDS = -np.log1p(-np.arange(1, REGISTERS) / REGISTERS)  # register i's value lies in the i-th equally likely slice
_LEVELS = np.concatenate([[0.0], _LEVEL_ENDS, [np.inf]])
#: A fixed shuffle of the registers.
_SHUFFLE = np.argsort(words.mix(np.arange(REGISTERS, dtype=np.uint64)))


def _exponential(u: np.ndarray, level: int) -> np.ndarray:
    """Values of a unit exponential, given that they fall into the level-th of REGISTERS equally likely slices."""
    p = (level + (u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / REGISTERS
    return -np.log1p(-p)


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row the smallest values by register, shape (rows, REGISTERS); inf for a row without elements.

    An element gives each register one value, one from each slice of the exponential in rising order, its registers permuted
    by the element.  The permutation is two rounds of a step modulo REGISTERS and a fixed shuffle: steps alone would spread a
    small set's values evenly over the bands.  Slice by slice, until no later value can be below any register of the row.
    """
    rows = len(bounds) - 1
    low = np.full(rows * REGISTERS, np.inf)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    first, step = words.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), words.mix(hashes ^ np.uint64(0x14057B7EF767814F))
    part = lambda h, bits: (h >> np.uint64(bits) & np.uint64(REGISTERS - 1)).astype(np.int64)
    place, stride, turn, spread = part(first, 0), part(step, 0) | 1, part(first, 8), part(step, 8) | 1
    live = np.arange(len(hashes))
    for level in range(REGISTERS):
        if not len(live):
            break
        h = hashes[live] + np.uint64((level * 0x9E3779B97F4A7C15) & words._MASK)
        value = _exponential(words.mix(h), level)
        at = _SHUFFLE[(place[live] + level * stride[live]) & (REGISTERS - 1)]
        at = row[live] * REGISTERS + _SHUFFLE[(turn[live] + at * spread[live]) & (REGISTERS - 1)]
        np.minimum.at(low, at, value)
        most = low.reshape(rows, REGISTERS).max(axis=1)
        live = live[most[row[live]] > _LEVELS[level + 1]]
    return low.reshape(rows, REGISTERS)


def registers(low: np.ndarray) -> np.ndarray:
    """Minima as bytes: higher for smaller minima, 0 for none; registers of a union are the larger ones."""
    with np.errstate(divide="ignore"):
        k = np.floor(1 + OFFSET - np.log(np.maximum(low, 1e-300)) / math.log(BASE))
    return np.where(np.isinf(low), 0, np.clip(k, 1, 255)).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of a are above, below and equal to those of b.

    With u = |A - B| / |A u B| and v = |B - A| / |A u B|, a register of a is above with probability p(u), where p(x) =
    -log_b(1 - x (b-1)/b) for the register base b, below with p(v), equal otherwise.  Known sizes leave one unknown, J; the
    likelihood is maximised over a grid of J.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    share = size_a / (size_a + size_b)
    best, top = np.zeros(len(a)), np.full(len(a), -np.inf)
    slope = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * slope) / math.log(BASE)

    limit = np.minimum(size_a / size_b, size_b / size_a)
    for j in np.linspace(0.0, 1.0, 101):
        jj = np.minimum(j, limit)
        u, v = share - (1 - share) * jj, (1 - share) - share * jj
        pa_, pb = np.clip(p(u), 1e-9, 1), np.clip(p(v), 1e-9, 1)
        pe = np.clip(1 - pa_ - pb, 1e-9, 1)
        got = above * np.log(pa_) + below * np.log(pb) + equal * np.log(pe)
        better = got > top
        best[better], top[better] = jj[better], got[better]
    return best


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, bounds by row) of blocks.  Fewer words than k: all words as one shingle."""
    for block in words.blocks(column, lower=True):
        h, b = block.hashes, block.bounds
        n = np.diff(b)
        row = block.rows()
        if k == 1 or not len(h):
            shingle, where = h, row
        else:
            run = h[: max(len(h) - k + 1, 0)].copy()
            for j in range(1, k):
                run = words.pair(run, h[j : len(h) - k + 1 + j])
            full = np.arange(len(run)) + k <= b[row[: len(run)] + 1]
            shingle, where = run[full], row[: len(run)][full]
            short = np.flatnonzero((n > 0) & (n < k))
            if len(short):
                whole = h[b[short]].copy()
                for j in range(1, k - 1):
                    more = n[short] > j
                    whole[more] = words.pair(whole[more], h[b[short[more]] + j])
                shingle, where = np.concatenate([shingle, words.mix(whole ^ n[short].astype(np.uint64))]), np.concatenate([where, short])
        order = np.lexsort((shingle, where))
        shingle, where = shingle[order], where[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (where[1:] != where[:-1])
        shingle, where = shingle[new], where[new]
        yield block.first, shingle, np.searchsorted(where, np.arange(len(block) + 1))


def _salted(shingle: np.ndarray, salt: int) -> np.ndarray:
    return words.mix(shingle ^ np.uint64(salt * 0x632BE59BD9B4E019 & words._MASK))


def set_digest(shingle: np.ndarray) -> int:
    """First half of a set's digest: the sum of its elements' hashes, as a signed number."""
    return int(_salted(shingle, 1).sum(dtype=np.uint64).view(np.int64))


def sketches(df: DataFrame, k: int, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (two halves of the set's 128-bit digest, null if empty), registers, *keep.

    A text that is kept is sent once.
    """
    kept = [df.schema[c] for c in keep]
    own = [df.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "d1", "d2")), T.StructField("registers", T.BinaryType())]
    schema = T.StructType([*own, *kept])
    columns = ["doc_id", *keep, *([] if text in keep else [text])]
    at = columns.index(text)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.tidy(batches):
            for first, shingle, bounds in shingle_sets(batch.column(at), k):
                n = np.diff(bounds)
                rows = len(n)
                reg = registers(minima(shingle, bounds))
                halves = []
                for salt in (1, 2):
                    total = np.zeros(len(shingle) + 1, np.uint64)
                    np.cumsum(_salted(shingle, salt), out=total[1:])
                    halves.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64), mask=n == 0))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *halves, pa.array([r.tobytes() for r in reg], pa.binary()), *part.columns[1 : 1 + len(keep)]], schema.names)

    return df.select(*columns).mapInArrow(make, schema)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of registers."""
    count = REGISTERS // BAND
    cut = reg[:, : count * BAND].reshape(len(reg), count, BAND)
    key = np.zeros((len(reg), count), np.uint64)
    for j in range(BAND):
        key = key << np.uint64(8) | cut[:, :, j]
    return words.mix(key ^ (np.arange(count, dtype=np.uint64) << np.uint64(56))).view(np.int64)


def bands(classes: DataFrame) -> DataFrame:
    """(cls, band): a hash for each band of a class's registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, REGISTERS)
            key = band_keys(reg)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), key.shape[1])), pa.array(key.reshape(-1))], ["cls", "band"])

    return classes.select("cls", "registers").mapInArrow(make, "cls long, band long")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with one representative of all its groups, for each of ORDERS.

    ``members``: (band, cls).  A group's representative is its first class by the order, and of a class's groups' the first
    again counts, so a class gets at most as many pairs as there are orders, however large its groups are.
    """
    heads = members.groupBy("band").agg(*[F.min(F.col("cls").bitwiseXOR(F.lit(o))).alias(f"h{i}") for i, o in enumerate(ORDERS)])
    mine = [F.min(F.when(F.col(f"h{i}").bitwiseXOR(F.lit(o)) != F.col("cls"), F.col(f"h{i}"))).alias(f"h{i}") for i, o in enumerate(ORDERS)]
    best = members.join(heads, "band").groupBy("cls").agg(*mine)
    head = F.explode(F.array(*[F.col(f"h{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(ORDERS)])).alias("head")
    pairs = best.select("cls", head).where("head is not null")
    return pairs.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose similarity, estimated from the registers, is at least ``least``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, REGISTERS) for i in (4, 5))
                sa, sb = (np.asarray(batch.column(i)).astype(float) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(similarity(ra, rb, sa, sb) >= least))

    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n_shingles").alias(f"size_{s}"), F.col("registers").alias(f"registers_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "size_a", "size_b", "registers_a", "registers_b").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole shingle sets have 100 * intersection >= percent * union.

    Texts are those of :func:`class_texts`.  Should a class's smallest id be repeated with other texts, a text counts only if
    its set is the class's.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.tidy(batches):
            for start, stop in words.row_slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                sets: list[np.ndarray] = []
                for column in (part.column(2), part.column(3)):
                    for _, shingle, bounds in shingle_sets(column, k):
                        sets += np.split(shingle, bounds[1:-1])
                n = part.num_rows
                wanted = [part.column(i).to_pylist() for i in (4, 5)]
                good = []
                for i, (x, y) in enumerate(zip(sets[:n], sets[n:], strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    same = 100 * common >= percent * (len(x) + len(y) - common)
                    good.append(same and set_digest(x) == wanted[0][i] and set_digest(y) == wanted[1][i])
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda s: texts.select(F.col("cls").alias(s), F.col("text").alias(f"text_{s}"), F.col("d1").alias(f"d_{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b", "d_a", "d_b").mapInArrow(keep, "a long, b long").distinct()


def class_texts(df: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, d1, text) of the smallest document of each of these classes (cls, rep, d1), once per different text."""
    texts = df.select("doc_id", "text").join(classes, F.col("doc_id") == F.col("rep"))
    return texts.groupBy("cls", "d1", F.xxhash64("text").alias("_t")).agg(F.first("text").alias("text")).drop("_t")


def short_sets(texts: DataFrame, k: int) -> DataFrame:
    """(cls, shingles): each class's sorted shingle hashes, cut to 32 bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for first, shingle, bounds in shingle_sets(batch.column(2), k):
                rows = [i for i in range(len(bounds) - 1) if set_digest(shingle[bounds[i] : bounds[i + 1]]) == wanted[first + i]]
                cut = [np.unique((shingle[bounds[i] : bounds[i + 1]] >> np.uint64(32)).astype(np.uint32)).tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + i for i in rows], pa.int64())), pa.array(cut, pa.binary())], ["cls", "shingles"])

    return texts.select("cls", "d1", "text").mapInArrow(make, "cls long, shingles binary").dropDuplicates(["cls"])


def across(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may join different components of one band's group.

    ``groups``: (band, cls, component) of groups with several components.  Members outside the group's largest component are
    dealt into blocks, as are all members; each block of the first meets each of the second in a group of bounded size.  A
    pair is looked at in the first band that it shares.  Pairs whose registers allow it are compared by their sets of 32-bit
    hashes, likeliest first; once one is surely linked, others that would join the same two components are left, as they
    change nothing.  Pairs too close to tell come out too; all are verified on full sets later.
    """
    least = percent / 100 * SLACK
    counts = groups.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    rows = groups.join(main, "band").select("band", "cls", "component", (F.col("component") != F.col("m.component")).alias("odd"), "all", (F.col("all") - F.col("m.n")).alias("odds"))
    cells = lambda c: F.ceil(F.col(c) / BLOCK_ROWS)
    home = lambda c: F.pmod(F.xxhash64("cls"), cells(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), (cells(c) - 1).cast("int"))
    as_member = rows.select("band", F.explode(every("odds")).alias("i"), home("all").alias("j"), "cls", "component", F.lit(0).alias("side"))
    as_odd = rows.where("odd").select("band", home("odds").alias("i"), F.explode(every("all")).alias("j"), "cls", "component", F.lit(1).alias("side"))
    dealt = as_member.unionByName(as_odd).join(classes.select("cls", "n_shingles", "registers").join(sets, "cls"), "cls")
    need = int(REGISTERS * least * 0.9)  # registers agree at least about as often as the similarity says
    count = REGISTERS // BAND

    def compare(table: pa.Table) -> pa.Table:
        side, cls, comp, size, band = (np.asarray(table[c]) for c in ("side", "cls", "component", "n_shingles", "band"))
        reg = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint8).reshape(len(cls), REGISTERS)
        own = [np.frombuffer(x, np.uint32) for x in table["shingles"].to_pylist()]
        members = np.flatnonzero(side == 0)
        here = band_keys(reg[members[:1]]) == band[0] if len(members) else np.zeros((1, count), bool)
        before = int(np.argmax(here)) * BAND  # registers of the bands before this one
        root = {int(c): int(c) for c in np.unique(comp)}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for x in np.flatnonzero(side == 1).tolist():
            other = members[comp[members] != comp[x]]
            equal = reg[other] == reg[x]
            fits = equal.sum(axis=1) >= need
            other, equal = other[fits], equal[fits]
            if before:
                other = other[~equal[:, :before].reshape(len(other), before // BAND, BAND).all(axis=2).any(axis=1)]
            if not len(other):
                continue
            n = len(other)
            like = similarity(np.broadcast_to(reg[x], (n, REGISTERS)), reg[other], np.full(n, float(size[x])), size[other].astype(float))
            for y in other[np.argsort(-like, kind="stable")][: int((like >= least).sum())].tolist():
                if top(int(comp[x])) == top(int(comp[y])):
                    continue
                common = len(np.intersect1d(own[x], own[y], assume_unique=True))
                share = common / (len(own[x]) + len(own[y]) - common)
                if share >= percent / 100 - UNSURE:
                    a.append(min(cls[x], cls[y]))
                    b.append(max(cls[x], cls[y]))
                if share >= percent / 100 + UNSURE:
                    root[top(int(comp[x]))] = top(int(comp[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def class_components(df: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have verified links."""
    spark = df.sparkSession
    with scratch(spark) as kept:
        banded, banded_path = materialize(bands(classes), "bands")
        shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        members, members_path = materialize(banded.join(shared, "band"), "members")
        remove(spark, banded_path)
        tested, _ = materialize(estimated(stars(members), classes, percent / 100 * SLACK), "pairs")
        # Texts are dealt by id once, those of classes with a band in common; what follows reads these.
        shared = members.select("cls").distinct()
        texts, _ = materialize(class_texts(df, classes.select("cls", "rep", "d1").join(shared, "cls", "left_semi")), "class-texts")
        links, _ = materialize(verified(tested, texts, k, percent), "links")
        found, path = materialize(components(links), "components")
        # Groups that still span components: their members outside the main one, against all others.
        several = members.join(found, F.col("cls") == F.col("node"), "left").select("band", "cls", F.coalesce("component", "cls").alias("component"))
        spans = several.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
        groups, _ = materialize(several.join(spans, "band", "left_semi"), "spanning")
        remove(spark, members_path)
        if not groups.isEmpty():
            inside = texts.join(groups.select("cls").distinct(), "cls", "left_semi")
            sets, sets_path = materialize(short_sets(inside, k), "sets")
            pairs, _ = materialize(across(groups, classes, sets, percent), "cross-pairs")
            remove(spark, sets_path)
            if not pairs.isEmpty():
                more, _ = materialize(verified(pairs, texts, k, percent), "cross-links")
                found, path = materialize(components(links.unionByName(more)), "components")
        kept.add(path)
    return found


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their k-word shingle sets.

    Returns *keep, doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included), kept (doc_id =
    component_id) and one (true for a single row of each group, one that is kept; the rows' order in storage breaks ties
    between repeated rows).  Documents without words or text are linked with nothing.  Rows of a null id take part only
    through rows of the same set that have one; otherwise their component is null and they are kept.  Repeated rows have one
    component; a doc_id repeated with other texts may have several.  Long texts are shingled whole.  An empty table gives no
    rows, columns of other names are left out unless named in ``keep``, where the result's own names may not stand.
    """
    if clash := set(keep) & {"n_shingles", "component_id", "kept", "one"}:
        raise ValueError(f"the result has columns of these names already: {', '.join(sorted(clash))}")
    places = {f"c{i}": c for i, c in enumerate(c for c in keep if c != "doc_id")}
    out = _grouped(df.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for p, c in places.items()]), k, percent, tuple(places))
    return out.select(*[F.col(p).alias(c) for p, c in places.items()], "doc_id", "n_shingles", "component_id", "kept", "one")


def representatives(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of :func:`near_duplicates`, and all rows in no group, with all their columns, whatever these are called."""
    places = {f"c{i}": c for i, c in enumerate(df.columns)}
    out = _grouped(df.select("doc_id", *[F.col(f"`{c}`").alias(p) for p, c in places.items()]), k, percent, tuple(places), f"c{df.columns.index('text')}")
    return out.where("one").select(*[F.col(p).alias(c) for p, c in places.items()])


def _grouped(df: DataFrame, k: int, percent: int, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """From doc_id, the text and the kept columns: doc_id, *keep, n_shingles, component_id, kept, one."""
    spark = df.sparkSession
    with scratch(spark) as left:
        table, path = materialize(sketches(df, k, keep, text).withColumn("_n", F.monotonically_increasing_id()), "sketches")
        left.add(path)
        table = table.withColumn("cls", F.when(F.col("d1").isNotNull(), F.xxhash64("d1", "d2", "n_shingles")))
        grouped = table.where("d1 is not null").groupBy("cls")
        first = lambda c: F.first(c).alias(c)
        classes, _ = materialize(grouped.agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), *map(first, ("d1", "n_shingles", "registers"))).where("rep is not null"), "classes")
        found = class_components(df.select("doc_id", F.col(text).alias("text")), classes, k, percent)
        comp = F.coalesce("component", "cls").alias("component")
        mapped = classes.select("cls", "rep", "rows").join(found, F.col("cls") == F.col("node"), "left").select("cls", "rep", "rows", comp)
        # Only groups of several rows need a name; a row that is alone in its group stands for itself.
        names = mapped.groupBy("component").agg(F.min("rep").alias("component_id"), F.min_by("cls", F.struct("rep", "cls")).alias("head"), F.sum("rows").alias("rows")).where("rows > 1")
        names, _ = materialize(names.drop("rows"), "names")
        # The row that stands for a group: the first of its head class's rows with the group's id.
        heads = table.select("cls", "doc_id", "_n").join(names.select(F.col("head").alias("cls"), "component_id"), "cls").where("doc_id = component_id")
        firsts = heads.groupBy("cls").agg(F.min("_n").alias("first_row"))
        named, path = materialize(mapped.select("cls", "component").join(names.drop("head"), "component").select("cls", "component_id").join(firsts, "cls", "left").withColumn("named", F.lit(True)), "named")
        left.add(path)
        if named.count() <= SENT_CLASSES:  # then rows with their texts stay where they are; beyond, Spark's own choice of join
            named = F.broadcast(named)
    out = table.join(named, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    one = F.when(F.col("named").isNull(), True).otherwise(F.coalesce(F.col("_n") == F.col("first_row"), F.lit(False)))
    return out.select("doc_id", *keep, "n_shingles", "component_id", kept.alias("kept"), one.alias("one"))


#: Rows of near_duplicates(k=2, percent=80) for tables whose ids are unique.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept, m.doc_id = component_id AS one FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
