"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralane.llm import chat, classifier, dedup, fingerprints, licenses, lm, mixing, packing, quality, queries, tokens, words
from terralane.llm.eliasfano import Sequence, encode, pack, unpack

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, band string"


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, odd white space and special strings."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120)
    texts = [None, "", " ", "\n\n", "One", "one TWO", base, base, base.upper(), base + " x", say(2000), "a" * 5000, "  two  spaces\t\ttabs ", "x<|endoftext|>y", "don't  I'LL 're", say(60) + "\n" + say(60), "\n".join([say(8)] * 40)]
    for _ in range(40):
        near = base.split(" ")
        for _ in range(rng.randint(1, 9)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [say(rng.randint(5, 300)) for _ in range(60)] + ["Licensed under the Apache License, Version 2.0.\n" + say(100), say(80) + "\nReleased under the MIT License."]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "c", None]), 0, "k", "b") for i, t in enumerate(texts)]
    return [*out, out[6], out[20], (None, "no id at all", "en", "a", 0, "k", "b"), (None, base, "en", "a", 0, "k", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Words and sequences ---


def test_words_equal_regex():
    texts = ["A b\tc\x0bd", "", None, "  x  ", "é b c", "Z" * 9000]
    seen: dict[int, str] = {}
    for block in words.blocks(pa.array(texts, pa.string())):
        for i in range(len(block)):
            own = split((texts[block.first + i] or "").translate(LOWER))
            hashes = block.hashes[block.bounds[i] : block.bounds[i + 1]].tolist()
            assert len(own) == len(hashes)
            assert all(seen.setdefault(h, w) == w for h, w in zip(hashes, own, strict=True))


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 7), (999, 2**63), (5000, 6000), (3, 2**64)])
def test_elias_fano(n, universe):
    rng = np.random.RandomState(3)
    values = np.unique(rng.randint(0, min(universe, 2**62), n)).astype(np.uint64)
    s = Sequence(unpack(np.frombuffer(pack(encode(values, universe)), np.uint8)))
    assert (s.decode() == values).all() and (s.values(np.arange(len(values))) == values).all()
    probe = np.concatenate([values, rng.randint(0, min(universe, 2**62), 500).astype(np.uint64)])
    assert (s.successor(probe) == np.searchsorted(values, probe)).all()
    assert [i for i in s.find(probe)] == [int(np.searchsorted(values, v)) if v in set(values.tolist()) else -1 for v in probe.tolist()]


# --- 1 Chat ---


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "\\", "###", "### ", "</turn", "</turn></turn>\n", "a\\\\b", "", None, "é\n### user: hi</turn>\n"]
    turns = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["user", "assistant", "a:b\\", None, "assistant"] * 2, odd, strict=True))]
    turns += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn int, role string, text string, chunk string")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    for c in (1, 2, 3, None):
        mine = sorted([t for t in turns if t[0] == c], key=lambda t: t[1])
        formatted = got[c]["formatted"]
        assert list(chat.read_turns(formatted)) == [((r or "").encode(), (x or "").encode()) for _, _, r, x in mine]
        loss = "".join(chat.unescape(formatted[a:b]).decode() for a, b in zip(got[c]["loss_start"], got[c]["loss_end"], strict=True))
        assert loss == "".join(x or "" for _, _, r, x in mine if r == "assistant")
    digest = {r["conv_id"]: r for r in chat.digest(chat.format_chat(df)).collect()}
    assert digest[3]["n_turns"] == 2 and digest[3]["loss_chars"] == 8
    assert digest[2]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for c, _, r, x in turns if c == 2).encode()).hexdigest()
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


def test_chat_chunks_continue(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "assistant", f"text {t} " * 50) for t in range(60)], "conv_id long, turn int, role string, text string")
    whole = chat.digest(chat.format_chat(df)).first()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert chat.format_chat(df).count() > 1
        assert chat.digest(chat.format_chat(df)).first() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- 2 Mixing ---


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_targets_are_poured(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 400), ("e", 0)], "s string, source_size long")
    got = {r["s"]: r["target"] for r in mixing.targets(df, "s").collect()}
    weights, caps = {"a": 1, "b": 2, "c": 3, "e": 1, None: 2}, {"a": 30, "b": 3000, "c": 15, "e": 0, None: 1200}
    full: set = set()
    while True:
        rest, w = 1415 - sum(caps[s] for s in full), sum(v for s, v in weights.items() if s not in full)
        over = {s for s in weights if s not in full and rest * weights[s] / w > caps[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx({s: caps[s] if s in full else rest * weights[s] / w for s in weights})


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    sums: Counter = Counter()
    longest: Counter = Counter()
    for r in got:
        key = (r["target"], r["source_size"])
        sums[key] += r["taken"]
        longest[key] = max(longest[key], r["size"])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
    # Within the largest document; the repeated rows of one id go together.
    assert all(abs(total - target) <= 2 * longest[target, size] for (target, size), total in sums.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert len(got) == docs.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)


# --- 3 Licenses ---


def test_license_scan(docs, rows, empty):
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    want = {(i, name) for i, t, *_ in rows for name, mark in (("Apache-2.0", "Apache License"), ("MIT", "MIT License")) if mark in (t or "")}
    assert got == want and licenses.scan(empty).count() == 0


def _noise(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["red", "blue", "one", "two", "sky"]) for _ in range(n))


def test_every_license_is_found_anywhere(spark):
    """Short notices and whole texts, at any offset, and with other text in their midst."""
    rng = random.Random(1)
    texts = [(f"{name}-{n}", f"{_noise(rng, n)} {text} {_noise(rng, rng.randint(0, 400))}") for name, text in licenses.TEMPLATES.items() for n in (0, 1, 5, 33, 400)]
    for name, text in licenses.TEMPLATES.items():
        w = text.split()
        if len(w) > 60:
            texts.append((f"{name}-cut", " ".join([_noise(rng, 50), *w[: len(w) // 2], _noise(rng, 700), *w[len(w) // 2 :]])))
    got = {r["doc_id"] + "/" + r["license"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert {f"{i}/{i.rsplit('-', 1)[0]}" for i, _ in texts} <= got


def _shingles(text: str) -> set[tuple]:
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_license_scan_equals_brute_force(spark, tmp_path):
    """Some hundred templates of 5 to 2,000 words, texts with all, most or half of one."""
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(3000)]
    for i in range(150):
        (tmp_path / f"t{i}.txt").write_text(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 17, 40, 132, 133, 300, 2000]))))
    templates = licenses.read_templates(str(tmp_path))
    assert len(templates) == 150
    texts = []
    for i in range(200):
        w = rng.choice(list(templates.values())).split()
        for _ in range(int(len(w) * rng.choice([0, 0, 0.02, 0.05, 0.1]))):
            w[rng.randrange(len(w))] = "changed"
        w = w[: int(len(w) * rng.choice([1, 1, 0.85, 0.5]))]
        texts.append((i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 300)), *w, *rng.choices(vocabulary, k=rng.randint(0, 300))])))
    want = set()
    sets = {name: _shingles(text) for name, text in templates.items()}
    for i, text in texts:
        own = _shingles(text)
        want |= {(i, name, round(len(own & s) / len(s), 9)) for name, s in sets.items() if len(own & s) / len(s) >= licenses.CONTAINED}
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates=templates).collect()
    assert {(r["doc_id"], r["license"], round(r["containment"], 9)) for r in got} == want and len(want) > 50


def test_a_whole_license_file_is_found(spark):
    import importlib.metadata

    found = [f for name in ("packaging", "requests") for f in importlib.metadata.files(name) or () if "LICENSE" in f.name and len(text := f.read_text()) > 8000 and "Apache License" in text]
    if not found:
        pytest.skip("no Apache license file among the installed packages")
    text = found[0].read_text()
    docs = [(1, f"{_noise(random.Random(1), 77)} {text} {_noise(random.Random(2), 900)}"), (2, _noise(random.Random(3), 3000)), (3, text[: len(text) // 2])]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates={"Apache-2.0-text": text}).collect()
    assert [(r["doc_id"], r["containment"]) for r in got] == [(1, 1.0)]


# --- 4 Tokens ---


def test_token_counts_equal_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer_path())
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs.select("doc_id", "text")).collect())
    assert got == Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)
    assert tokens.token_counts(empty.select("doc_id", "text")).count() == 0


def test_ids_survive_cutting(monkeypatch):
    e = tokens.encoder(tokens.default_tokenizer_path())
    text = "It's  a  <|endoftext|> test \n\n of 12 cuts.  " * 200
    whole = e.ids(text).tolist()
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    assert e.ids(text).tolist() == whole and e.count(text) == len(whole)
    ids, bounds = e.batch([text, None, "x"])
    assert ids[: bounds[1]].tolist() == whole and bounds.tolist() == [0, len(whole), len(whole), len(whole) + 1]


def _wild_texts() -> list[str]:
    """Random code points of all planes, white space of all kinds, special and separating strings, contractions, digits."""
    rng = random.Random(11)
    bits = ["<|endoftext|>", tokens.SEPARATOR, "\0", "|", "<|", "endoftext|>", "'ll", "'S", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b", "\r\n", "12", "\u0663", "\u00bd", "a", "Zz", "\u00e9", "e\u0301", "\u65e5\u672c", "\U0001f600", "\ufb01", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    for _ in range(600):
        points = (rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]) for _ in range(rng.randint(1, 30)))
        texts.append("".join(map(chr, points)))
    return texts


def test_batches_equal_the_library_on_wild_texts():
    from tokenizers import Tokenizer

    t, e, texts = Tokenizer.from_file(tokens.default_tokenizer_path()), tokens.encoder(tokens.default_tokenizer_path()), _wild_texts()
    ids, bounds = e.batch(texts)
    for i, x in enumerate(texts):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(x)
        assert e.ids(x).tolist() == want


def test_texts_beyond_a_part_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(12)
    text = "".join(rng.choice(["word ", "two  ", "\n\n", "x1 ", "\u00e9t\u00e9 ", "a" * 40 + " ", "<|endoftext|>"]) for _ in range(350_000))
    assert len(text) > tokens.PART_CHARS
    t, e = Tokenizer.from_file(tokens.default_tokenizer_path()), tokens.encoder(tokens.default_tokenizer_path())
    assert e.batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_use_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words, twice", None, "", "<|endoftext|> x"]
    want = [Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    e = tokens.Encoder(path)
    ids, bounds = e.batch(texts)
    assert e.ids(texts[0]).tolist() == want[0]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


# --- 5 Language model ---


def brute_lm(train: list[list[str]], order: int):
    """P(word | the words before it in its text) by plain counting, and the counts of words."""
    grams: list[Counter] = [Counter() for _ in range(order + 1)]
    for w in train:
        full = ["</s>", *w]
        for n in range(1, order + 1):
            grams[n].update(tuple(full[i - n + 1 : i + 1]) for i in range(1 if n < 2 else n - 1, len(full)))
    follow = [Counter(g[:-1] for g in level) for level in grams]
    n, v = sum(grams[1].values()), len(grams[1])

    def p(history: list[str], word: str) -> float:
        out = (grams[1][word,] + 1) / (n + v + 1)
        past = ["</s>", *history]
        for k in range(2, order + 1):
            context = tuple(past[-k + 1 :])
            seen = grams[k - 1][context] if len(context) == k - 1 else 0
            if seen:
                out = max(grams[k][*context, word] - lm.DISCOUNT, 0) / seen + lm.DISCOUNT * follow[k][context] / seen * out
        return out

    return p, grams[1], n, v


@pytest.mark.parametrize(("order", "per_shard"), [(1, 10**7), (2, 10**7), (3, 10**7), (3, 150), (4, 40)])
def test_lm_scores(docs, rows, empty, monkeypatch, order, per_shard):
    """Also with shards so small that frequent contexts fill several."""
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", per_shard)
    toks = [(i, [*split((t or "").translate(LOWER)), "</s>"]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    p, count, n, v = brute_lm([w for i, w in toks if not held(i)], order)
    want = Counter()
    for i, w in toks:
        base = sum(math.log10((count[x,] + 1) / (n + v + 1)) for x in w)
        want[i, held(i), len(w), sum(count[x,] > 0 for x in w), n, round(base, 6)] += 1
        want[i, "score"] = sum(math.log10(p(w[:k], x)) for k, x in enumerate(w))
    for r in lm.scores(docs, order=order).collect():
        assert want[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)]
        if r["doc_id"] is not None:
            assert -0.0005 * r["n_tokens"] <= r["score"] - want[r["doc_id"], "score"] <= 1e-6
    assert lm.scores(empty, order=order).count() == 0


@pytest.mark.parametrize("per_shard", [10**7, 3])
def test_lm_probabilities_sum_to_one_at_most(spark, monkeypatch, per_shard):
    """Read from the model: behind any history, the probabilities of all words and one unknown word."""
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", per_shard)
    texts = ["a b a c a b d", "b a", "a a a a a a a a a a", "c a b d c a b", ""]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p, count, _, _ = brute_lm([[*t.split(), "</s>"] for t in texts], lm.ORDER)

    def own(history: list[str], word: str) -> float:
        _, tokens, bounds = next(lm.token_blocks(pa.array([" ".join([*history, *([word] if word != "</s>" else [])])])))
        return model.walk(tokens, bounds).p[len(history)]

    for history in ([], ["a"], ["a", "b"], ["a", "a"], ["b", "zzz"], ["zzz", "a"], ["zzz", "zzz"], ["c", "a", "b"]):
        found = {w: own(history, w) for w in (*(x for (x,) in count), "unseen")}
        assert all(x == pytest.approx(p(history, w), rel=1e-3) and x <= p(history, w) * (1 + 1e-9) for w, x in found.items())
        assert 0.98 < sum(found.values()) <= 1 + 1e-9
    # Further words never raise a text's probability.
    run = [r["score"] for r in lm.score(spark.createDataFrame([(" ".join("a" * n),) for n in range(1, 8)], "text string"), model, ()).collect()]
    assert len(run) == 7 and all(np.diff(sorted(run, reverse=True)) < 0)


def test_lm_tells_documents_that_occur_twice(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["river", "stone", "hill", "down", "the", "of", "and"]) + str(rng.randrange(12)) for _ in range(120))
    texts = [say() for _ in range(60)]
    twice = texts[:20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + twice)], "doc_id long, text string").coalesce(2)
    mean = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(docs, lm.train(docs)).collect()}
    assert min(mean[i] for i in range(20)) > max(mean[i] for i in range(20, 60))


def test_lm_counts_merge_either_way(monkeypatch):
    rng = np.random.RandomState(2)
    monkeypatch.setattr(lm, "MERGE_AT", 50)
    for span in (1 << 20, 1 << 62):  # shard and key in one number, and apart
        total, want = lm.Counts(1000, span), Counter()
        for _ in range(20):
            shard, key, n = rng.randint(0, 1000, 30), rng.randint(0, 1 << 20, 30) % 7, rng.randint(1, 5, 30)
            total.add(shard, key.astype(np.uint64), n)
            for x in zip(shard.tolist(), key.tolist(), n.tolist(), strict=True):
                want[x[:2]] += x[2]
        got = [tuple(map(int, x)) for x in zip(*total.sorted(), strict=True)]
        assert got == [(*k, n) for k, n in sorted(want.items())]


# --- 6 Classifier ---


def test_classifier(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "down", "hill", "stone"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "now$$$", "click***", "free%%%"]) for _ in range(60))
    texts = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(400, None), (401, ""), (None, good()), (7, good())]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.select(table, labels).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    assert sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in held) >= 0.97 * len(held)
    none = classifier.select(table, labels.limit(0)).collect()
    assert all(r["kept"] for r in none)
    assert classifier.select(table.limit(0), labels).count() == 0


def test_kth_highest(spark):
    values = [random.Random(2).gauss(0, 100) for _ in range(500)] + [7.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 250, 549, 550):
        assert classifier.kth_highest(df, "v", k) == order[k - 1]
    assert classifier.kth_highest(df, "v", 551) == -np.inf and classifier.kth_highest(df, "v", 0) == np.inf


# --- 7 Packing ---


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.choice([7, 20, 64])
        counts = {rng.randint(1, room): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        sequences: dict[int, list] = {}
        for length, first, stop, sequence, per, at in packing.plan(counts, room):
            for i in range(first, stop):
                sequences.setdefault(sequence + (i - first) // per, []).append((at + (i - first) % per * length, length))
        got: Counter = Counter()
        for placed in sequences.values():
            end = 0
            for at, length in sorted(placed):
                assert at == end
                end += length
                got[length] += 1
            assert end <= room
        assert got == Counter(counts)
        left: list[int] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [x for x in left if x >= length]
                if fits:
                    left.remove(min(fits))
                    left.append(min(fits) - length)
                else:
                    left.append(room - length)
        assert len(sequences) == len(left)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer_path())
    size = 256
    want: Counter = Counter()
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        for p, a in enumerate([0, *range(first, len(ids), size)]):
            piece = ids[a : first if a == 0 else a + size]
            want[i, p, a, len(piece), zlib.crc32(piece.tobytes())] += 1
    got = packing.pack(docs, max_len=size).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at: dict[int, list] = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= size
    assert packing.pack(empty).count() == 0


# --- 8 Near duplicates ---


def brute_components(rows: list[tuple], k: int, percent: int) -> dict:
    sets = {}
    for i, t, *_ in rows:
        w = split((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("k", "sent"), [(2, dedup.SENT_CLASSES), (5, dedup.SENT_CLASSES), (5, 0)])
def test_near_duplicates(docs, rows, monkeypatch, k, sent):
    monkeypatch.setattr(dedup, "SENT_CLASSES", sent)
    named = [r for r in rows if r[0] is not None]
    want = brute_components(named, k, 80)
    got = dedup.near_duplicates(docs, k, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    ones = Counter(r["component_id"] for r in got if r["one"] and r["n_shingles"] and r["component_id"] is not None)
    assert ones == Counter({c: 1 for n, c in want.values() if n})
    copy = [r for r in got if r["doc_id"] is None and r["component_id"] is not None]
    assert len(copy) == 1 and copy[0]["component_id"] == 6 and not copy[0]["kept"]


def test_near_duplicates_of_nothing(empty):
    assert dedup.near_duplicates(empty).count() == 0


def test_groups_that_span_components_are_joined(spark, monkeypatch):
    """A chain of documents, each like the next only, with blocks so small that groups are dealt out."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 3)
    w = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(w[3 * i : 3 * i + 100])) for i in range(40)]
    want = brute_components(chain, 2, 80)
    got = dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_registers_merge_and_estimate():
    rng = np.random.RandomState(0)
    pool = rng.randint(0, 2**62, 3000).astype(np.uint64)
    for j in (0.2, 0.5, 0.8, 0.95):
        n, found = 1000, []
        for _ in range(8):
            both = int(2 * n * j / (1 + j))
            pick = rng.permutation(pool)[: 2 * n - both]
            a, b = pick[:n], pick[n - both :]
            sets = np.concatenate([a, b, pick])
            reg = dedup.registers(dedup.minima(sets, np.array([0, len(a), len(a) + len(b), len(sets)])))
            assert (np.maximum(reg[0], reg[1]) == reg[2]).all()
            found.append(dedup.similarity(reg[:1], reg[1:2], np.array([1.0 * len(a)]), np.array([1.0 * len(b)]))[0])
        assert abs(np.mean(found) - j) < 0.05


# --- 9 Quality ---


def test_quality_measures(docs, rows):
    want: Counter = Counter()
    for i, t, *_ in rows:
        w, t = split(t), t or ""
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(grams)
        covered = {j + d for j, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality.apply_rules(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def _say(rng: random.Random, mark: str = "", n: int = 80) -> str:
    return " ".join(rng.choice(["river", "stone", "hill", "down"]) + str(rng.randrange(500)) + mark for _ in range(n))


QUALITY_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("size", "prior"), [(300, quality.PRIOR), (30, 20)])
def test_quality_adapts_to_its_group(spark, empty, size, prior):
    rng = random.Random(3)
    table = [(i, _say(rng, "#" if i % 40 == 0 else ""), "en", "plain", 0) for i in range(size)] + [(1000 + i, _say(rng, "#"), "en", "code", 0) for i in range(size)]
    got = {r["doc_id"]: r["kept"] for r in quality.apply_rules(spark.createDataFrame(table, QUALITY_SCHEMA), prior=prior).collect()}
    assert all(got[i] == (i % 40 != 0) for i in range(size))
    assert all(got[1000 + i] for i in range(size))  # what is usual in its source is no fault
    assert quality.apply_rules(empty).count() == 0


def test_quality_thresholds_follow_quantiles(spark):
    """Thresholds against plain Python: quantiles drawn towards the parent's, then margins, with bins above 1024."""
    rng = random.Random(4)
    values = {("en", "a"): [rng.randrange(300, 700) for _ in range(40)], ("en", None): [rng.randrange(2000, 90_000) for _ in range(25)], ("ja", "b"): [5_000_000] * 12}
    spec = quality.MARGIN["word_len"]
    rows = [(lang, source, *[0] * 3, v, False) for (lang, source), vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_pm long, dup_line_pm long, repeat_pm long, word_len long, base_failed boolean")
    df = df.withColumn("word_len", quality.binned(F.col("word_len")))
    cut = lambda v: v if v < 1024 else v >> v.bit_length() - 10 << v.bit_length() - 10
    at = lambda vs: [sorted(map(cut, vs))[-(-len(vs) * q // 100) - 1] for q in quality.AT]
    mixed = lambda n, own, parent: [(n * x + quality.PRIOR * y) // (n + quality.PRIOR) for x, y in zip(own, parent, strict=True)]
    everything = at([v for vs in values.values() for v in vs])
    got = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.sketch(df)).collect()}
    assert set(got) == set(values)
    for (lang, source), vs in values.items():
        same = [v for (other, _), many in values.items() if other == lang for v in many]
        low, mid, _, high = mixed(len(vs), at(vs), mixed(len(same), at(same), everything))
        r = got[lang, source]
        assert (r["word_len_mid"], r["word_len_most"], r["word_len_least"]) == (mid, high + max(spec[1], spec[0] * (high - mid)), low - max(spec[1], spec[0] * (mid - low)))


def test_quality_thresholds_differ_between_groups(spark):
    rng = random.Random(5)
    table = [(i, " ".join("x" * rng.randint(2 + i % 4, 9) + str(rng.randrange(900)) for _ in range(80)), "en", f"s{i % 4}", 0) for i in range(400)]
    df = spark.createDataFrame(table, QUALITY_SCHEMA)
    limits = quality.thresholds(quality.sketch(quality.with_bins(quality.measured(df)))).collect()
    assert len({r["word_len_most"] for r in limits}) > 1 and len({r["word_len_least"] for r in limits}) > 1


def test_passing_keeps_columns_short_texts_and_odd_names(spark):
    rng = random.Random(6)
    table = [(i, _say(rng, n=20 if i % 10 == 0 else 80), "en", "a", "x", 1, "k") for i in range(100)] + [(100, None, None, None, "x", 1, "k"), (101, "", "en", "a", "x", 1, "k")]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, word_len string, kept long, `a.b` string")
    got = quality.passing(df, least_words=1)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == set(range(100))
    assert {r["doc_id"] for r in quality.passing(df).collect()} == {i for i in range(100) if i % 10}


# --- 10 Fingerprints ---


def test_edited_likeness(docs, rows, empty):
    order = sorted([(i, t or "") for i, t, *_ in rows if i is not None])
    got = fingerprints.edited_likeness(docs.where("doc_id is not null")).collect()
    assert len(got) == len(order)
    want: Counter = Counter()
    for a, (i, t) in enumerate(order):
        following = order[(a + 1) % len(order)][1]
        cut = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 200]) > 0.5
    same = {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)}
    assert len(same) == 1
    assert fingerprints.edited_likeness(docs).count() == len(rows)  # ids that are null come first
    assert fingerprints.edited_likeness(empty).count() == 0
    one = fingerprints.edited_likeness(docs.where("doc_id = 10")).collect()
    assert len(one) == 1


def test_digest_parses():
    code, length, found = fingerprints.digests(pa.array(["some text that is long enough to count", ""]))
    for i in range(2):
        a, n = fingerprints.parse(found[i])
        assert (a == code[i]).all() and n[0] == length[i]
        assert fingerprints.likeness(code[i : i + 1], length[i : i + 1], a, n)[0] == 1


# --- Pipeline and registry ---


def test_registry():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    clean = [(10_000 + i, say(120), "en", rng.choice("ab"), 0) for i in range(60)]
    junk = [(20_000 + i, " ".join(w + "***" for w in say(80).split()), "en", "a", 0) for i in range(10)]
    copies = [(30_000 + i, clean[0][1], "en", "b", 0) for i in range(5)]
    table = clean + junk + copies + [(None, None, None, None, None), (40_000, "", "en", "a", 0)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 20_000), 0) for r in clean[:30] + junk[:5]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    good = {r[0] for r in clean}
    assert not set(kept["quality_rules"]) & {r[0] for r in junk} and good <= set(kept["quality_rules"])
    assert len(good & set(kept["quality_classifier"])) >= 0.9 * len(good)
    assert len(set(kept["near_dedup"]) & {clean[0][0], *(r[0] for r in copies)}) == 1
    assert set(kept["source_mix"]) <= set(kept["near_dedup"]) and set(kept["best_fit_packing"]) == set(kept["source_mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["best_fit_packing"])


def test_ranks_of_vocabulary_are_bytes():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        want = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import json

    with open(tokens.default_tokenizer_path(), encoding="utf-8") as f:
        assert tokens._ranks(json.load(f)) == want
