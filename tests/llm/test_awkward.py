"""Corpus operators by brute force where SQL can't say them, on clashing names, odd ids and texts beyond a block."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terralane.llm import chat, classifier, dedup, fingerprints, licenses, lm, mixing, packing, quality, tokens, words
from terralane.storage import scope

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def say(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", ",", "42", "é"]) for _ in range(n))


# --- 6 Classifier by brute force ---


def word_hash(word: str) -> int:
    return int(next(words.blocks(pa.array([word]), lower=False)).hashes[0])


def buckets_of(text: str | None) -> list[int]:
    """Words cut where letters, digits and other scripts meet ASCII punctuation, and neighbouring pairs, as buckets."""
    found = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0d]+", text or "")
    h = [word_hash(w) for w in found]
    pairs = [int(words.pair(np.array([a], np.uint64), np.array([b], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x % classifier.BUCKETS for x in h + pairs]


def gumbel_of(doc_id: int | None) -> float:
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    u = ((xxhash.xxh64_intdigest(struct.pack("<i", classifier.SEED), seed) >> 12) + 0.5) / 2**52
    return -math.log(-math.log(u))


def test_importance_sampling_equals_brute_force(spark):
    rng = random.Random(21)
    texts = [(i, say(rng, rng.randint(1, 60)) + ("!!!" if i % 3 == 0 else "")) for i in range(480)]
    texts += [(480, None), (481, ""), (None, "no id at all"), (None, "x y z"), texts[5], texts[5], (482, texts[9][1]), (483, texts[9][1])]
    labels = [(i, int(i % 3 != 0), int(i % 7 == 0)) for i in range(200)] + [(5, 0, 0), (None, 1, 0), (9, None, 0), (7000, 1, 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    quality_of, toxic_of = {}, {}
    for i, q, t in labels:
        if i is not None and q is not None:
            quality_of[i], toxic_of[i] = min(q, quality_of.get(i, q)), max(t, toxic_of.get(i, t))
    raw, target = Counter(), Counter()
    for i, text in texts:
        found = buckets_of(text)
        raw.update(found)
        if quality_of.get(i) == 1 and not toxic_of[i]:
            target.update(found)
    scale = sum(target.values()) / sum(raw.values())
    weight = {b: math.log((target[b] + classifier.SHRINK) / (n * scale + classifier.SHRINK)) for b, n in raw.items()}
    rows = [(i, len(buckets_of(x)), sum(weight[b] for b in buckets_of(x))) for i, x in texts]
    keys = [r + gumbel_of(i) for i, _, r in rows]
    named = [quality_of[i] for i, _ in texts if i in quality_of]
    last = sorted(keys, reverse=True)[round(sum(named) / len(named) * len(texts)) - 1]
    want = Counter((i, n, round(r, 6), round(k, 6), k >= last) for (i, n, r), k in zip(rows, keys, strict=True))
    got = classifier.select(docs, table).collect()
    assert Counter((r["doc_id"], r["n_features"], round(r["log_ratio"], 6), round(r["gumbel_key"], 6), r["kept"]) for r in got) == want
    assert classifier.sampled(docs, table).count() == sum(r["kept"] for r in got)


# --- 10 Fingerprints by brute force ---


def brute_digest(text: str) -> tuple[list[int], int, str]:
    t, data = fingerprints._TABLES.tolist(), text.encode()
    counts = [0] * 128
    for at in range(len(data)):
        for salt, places in enumerate(((0, 1, 2), (0, 2, 3))):
            if at + places[-1] < len(data):
                a, b, c = (data[at + p] for p in places)
                h = (t[0][a] + 3 * t[1][b] + salt) & 0xFFFF
                h = ((h ^ h >> 7) * 0x9E3B + t[2][c]) & 0xFFFF
                counts[((h ^ h >> 9) * 0x2C1B & 0xFFFF) >> 9] += 1
    order = sorted(counts)
    q = [order[31], order[63], order[95]]
    codes = [sum(n > x for x in q) for n in counts]
    length = min(255, math.floor(math.log1p(len(data)) / math.log(1.1)))
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4))
    return codes, length, f"{length:02x}{packed.hex()}"


def brute_likeness(a: str, b: str) -> float:
    (ca, la, _), (cb, lb, _) = brute_digest(a), brute_digest(b)
    return min(1.0, max(0.0, 1 - sum(abs(x - y) for x, y in zip(ca, cb, strict=True)) / (128 * 1.25) - 0.02 * abs(la - lb)))


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)", "date"])
def test_fingerprints_equal_brute_force(spark, kind):
    rng = random.Random(22)
    texts = [None, "", "é", "日本語テキスト", *(say(rng, rng.randint(0, 80)) for _ in range(56))]
    ids = rng.sample(range(1000, 9000), len(texts))
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "n long, text string")
    table = table.select((F.date_add(F.lit("2000-01-01"), F.col("n").cast("int")) if kind == "date" else F.col("n").cast(kind)).alias("doc_id"), "text", F.lit(1).alias("part"), F.lit("x").alias("tie"))
    order = sorted(((str(r["doc_id"]) if kind in ("string", "date") else int(r["doc_id"]), r["text"] or "") for r in table.collect()))
    want = {}
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        want[str(key)] = (len(text), brute_digest(text)[2], brute_digest(edited)[2], round(brute_likeness(text, edited), 9), round(brute_likeness(text, following), 9))
    got = fingerprints.edited_likeness(table.repartition(5)).collect()
    assert {str(r["doc_id"]): (r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got} == want


def test_many_rows_of_one_id_fill_several_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    dealt = fingerprints.with_next(rows)
    assert dealt.where("doc_id IS NULL AND role = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert dealt.where("role = 0").count() == 4000
    assert fingerprints.edited_likeness(rows).count() == 4000


# --- Clashing names ---

CLASHES = (
    "copies target last source_size _s hash size row time n_shingles registers d1 d2 one first_row cls band component_id kept _row _n _w _l n_words word_len symbol_pm word_len_most base_failed keep_text "
    "n_features log_ratio gumbel_key part role tie c at piece start length ids_crc32 sequence_id offset _part _rank n_tokens n_bytes over_limit score base_score held_out chunk formatted n_chars fingerprint near_next license"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(23)
    base = say(rng, 90)
    rows = [(i, say(rng, 80), "en", rng.choice("ab")) for i in range(40)] + [(40, base, "en", "a"), (41, base, "en", "b"), (42, base + " end", None, None), (43, None, "en", "a"), (44, "", "en", "a"), (None, "no id", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES} | {"a.b": F.lit("dot")}).cache()


def test_stages_keep_clashing_columns(spark, clashing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == clashing.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for r in docs.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES) and r["a.b"] == "dot"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() > 0


def test_operators_ignore_clashing_columns(spark, clashing):
    plain = clashing.select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for run in (
        mixing.mix, licenses.scan, lm.scores, lambda d: classifier.select(d, labels), packing.pack, dedup.near_duplicates, quality.apply_rules, fingerprints.edited_likeness,
        lambda d: tokens.over_limit(tokens.token_counts(d)).select("doc_id", "n_bytes", "n_tokens", "over_limit"),
    ):
        a, b = (sorted(str(r) for r in run(d).drop("sequence_id", "offset").collect()) for d in (clashing, plain))
        assert a == b
    turns = plain.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    a, b = (sorted(str(r) for r in chat.digest(chat.format_chat(d)).collect()) for d in (turns, turns.withColumns({c: F.lit(1) for c in ("chunk", "formatted", "loss_start", "n_turns")})))
    assert a == b
    with pytest.raises(ValueError, match="kept"):
        dedup.near_duplicates(clashing, keep=("kept",))


# --- Ids and conversations ---


def test_rows_without_a_conversation_are_dealt_anywhere(spark):
    df = spark.range(300).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    chunks = chat.format_chat(df)
    assert chunks.count() == 300 and chat.digest(chunks).count() == 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chat.format_chat(df).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stored_chunks_are_read_in_order(spark, tmp_path):
    df = spark.createDataFrame([(c, t, "assistant", f"text {t} " * 50) for c in range(3) for t in range(40)], "conv_id long, turn int, role string, text string")
    whole = sorted(chat.digest(chat.format_chat(df), in_order=True).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chat.format_chat(df).orderBy(F.rand(1)).write.parquet(f"{tmp_path}/chunks")
        assert sorted(chat.digest(spark.read.parquet(f"{tmp_path}/chunks").repartition(4)).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- Mixing at a source's limit ---


def test_a_capped_source_takes_nothing_four_times(spark):
    rows = [(i, "one two three", "small") for i in range(3)] + [(10 + i, None if i % 2 else "", "small") for i in range(40)] + [(100 + i, "w " * 400, "big") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    small = [r for r in got if r["source_size"] == 9]
    assert {r["copies"] for r in small} == {3} and sum(r["taken"] for r in small) == small[0]["target"] == 27
    assert max(Counter(r["doc_id"] for r in mixing.mixed(df).collect()).values()) <= 3


# --- Texts beyond a block ---


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(24)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(3000)) for _ in range(5000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(600_000))
    assert len(text) > words.BLOCK_BYTES
    w = text.split(" ")
    for i in range(0, len(w), 400):
        w[i] = "changed"
    return [(1, text), (2, " ".join(w)), (3, "short one"), (4, text + " Released under the MIT License"), (5, " ".join(vocabulary))]


def test_texts_beyond_a_block(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2)
    plain = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for i, t in long_rows}
    got = {r["doc_id"]: r for r in dedup.near_duplicates(df, 2, 80).collect()}
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, w in plain.items()}
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert [(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(df).collect()] == [(4, "MIT", len(plain[1]))]
    table = df.withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    assert {r["doc_id"]: r["n_words"] for r in quality.apply_rules(table).collect()} == {i: len(w) for i, w in plain.items()}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_features"] for r in classifier.select(df, labels).collect()} == {i: 2 * len(w) - 1 for i, w in plain.items()}
    held = {i for i in plain if zlib.crc32(str(i).encode()) % 7 == 2}
    scored = {r["doc_id"]: r for r in lm.scores(df).collect()}
    assert all((scored[i]["n_tokens"], scored[i]["train_tokens"]) == (len(w) + 1, sum(len(x) + 1 for j, x in plain.items() if j not in held)) for i, w in plain.items())
    found = {r["doc_id"]: r for r in fingerprints.edited_likeness(df).collect()}
    assert {i: r["n_chars"] for i, r in found.items()} == {i: len(t) for i, t in long_rows} and found[3]["fingerprint"] == brute_digest("short one")[2]


# --- Recall of near copies ---


def test_recall_of_near_copies_is_measured(spark):
    """Every pair at similarity 0.8 or more, of sets of 3 to 400 shingles, and none below: recall and precision are 1."""
    rng = random.Random(25)
    rows = []
    for g in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([7, 10, 25, 60, 200, 400]))]
        rows.append((2 * g, " ".join(w)))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 12]) * len(w) // 100 + rng.choice([0, 1])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
        rows.append((2 * g + 1, " ".join(w)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    linked = {g for g in range(150) if 100 * len(sets[2 * g] & sets[2 * g + 1]) >= 80 * len(sets[2 * g] | sets[2 * g + 1])}
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g for g in range(150) if got[2 * g] == got[2 * g + 1]} == linked and 20 < len(linked) < 140


def test_operators_leave_no_tables_behind(spark, clashing):
    """What stays is what the returned plan reads."""
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    from pathlib import Path

    for run, most in ((lambda: mixing.mixed(clashing), 1), (lambda: classifier.sampled(clashing, labels), 0), (lambda: dedup.representatives(clashing), 2), (lambda: quality.passing(clashing), 2), (lambda: fingerprints.edited_likeness(clashing), 1)):
        with scope() as made:
            run().count()
        assert sum(Path(p.removeprefix("file://")).exists() for p in made) <= most
