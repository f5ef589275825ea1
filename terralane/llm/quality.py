"""Quality rules with thresholds adapted to language and source (operator 9), in DataFrame functions only.

Each document's measures are whole numbers: per mille shares and hundredths of a character.  Their counts by (language,
source, bin) are a quantile sketch of fixed bins: sketches merge by adding counts, have a bounded number of bins, and give
quantiles exact to one bin in whatever order rows come.  Bins are exact below 1024 and keep ten leading bits above, so a
script without spaces has bins of its own, however long its "words" are.

A group's quantiles are drawn towards its language's, and those towards all documents', as if ``PRIOR`` documents of the
parent were in the group; there is no size at which another rule takes over.  A measure fails where it lies further beyond its
group's upper quantile (or below its 10 % one) than so many times the distance from the median to that quantile.  That is the
90 % quantile, for symbols the 75 % one, as sources are met of which more than a tenth is markup.  A floor keeps the margin open
where a group's bulk has one value, as where most documents have no symbols at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, remove

#: Documents of the parent group that count into each group's quantiles.
PRIOR = 200
#: The quantiles of the sketch that thresholds are made of, in per cent: lower tail, middle, upper tails.
AT = (10, 50, 75, 90)
#: Measure: (times the distance from the median to the tail, least margin, whether small values fail too, upper tail in AT).
MARGIN = {"symbol_pm": (3, 20, False, 2), "dup_line_pm": (3, 340, False, 3), "repeat_pm": (10, 60, False, 3), "word_len": (5, 30, True, 3)}
#: The base rules; below FULL_WORDS words a document's measures are drawn towards its group's medians.
LEAST_WORDS, MOST_REPEATED_PCT, FULL_WORDS = 50, 50, 50
#: Leading bits that a bin keeps.
BIN_BITS = 10

_WHITE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, each counted once.

    Windows are compared by 64-bit hash.  If all differ the count is 0; else windows are sorted by (hash, place), those equal
    to a neighbour are kept, and the places they cover are added up in order.
    """

    def covered(hashes: Column) -> Column:
        def of(pairs: Column) -> Column:
            def same(p: Column, i: Column, step: int) -> Column:
                return F.coalesce(F.get(pairs, i + step)["h"] == p["h"], F.lit(False))

            places = F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(p, i, -1) | same(p, i, 1)), lambda p: p["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

        return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)

    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each whole text (null: none)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")
    return df.withColumns({"_w": _let(words(t), of_words), "_l": _let(lines, of_lines), "n_symbols": symbols}).withColumns(
        {c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"_l.{c}") for c in ("n_lines", "n_dup_lines")}
    ).drop("_w", "_l")


def _share(part: str, whole: str, times: int) -> Column:
    return F.expr(f"CAST({times} * {part} DIV greatest({whole}, 1) AS INT)")


def binned(value: Column) -> Column:
    """The bin of a whole number that is not negative: itself below 2^BIN_BITS, above it the number with its lower bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - BIN_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def with_bins(df: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add the measures that thresholds hold for, and base_failed."""
    return df.withColumns(
        {
            "symbol_pm": _share("n_symbols", "word_chars", 1000),
            "dup_line_pm": _share("n_dup_lines", "n_lines", 1000),
            "repeat_pm": _share("n_repeat_words", "n_words", 1000),
            "word_len": binned(_share("word_chars", "n_words", 100)),
            "base_failed": (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PCT),
        }
    )


def sketch(measures: DataFrame) -> DataFrame:
    """Counts by (lang, source, measure, bin) of the documents that pass the base rules.  Sketches merge by adding counts."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MARGIN])).alias("x")
    return measures.where(~F.col("base_failed")).select("lang", "source", stacked).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], at: tuple[int, ...] = AT) -> DataFrame:
    """For keys and measure: n and q, the lowest bins that hold these percentages."""
    group = [*keys, "measure"]
    merged = counts.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group)  # one row per bin, of which there is a bounded number
    sums = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return sums.groupBy(*group).agg(F.first("all").alias("n"), F.array(*[F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bin"))) for q in at]).alias("q"))


def _drawn(own: str, n: str, parent: str, prior: int) -> Column:
    """Quantiles of n documents mixed with those of ``prior`` documents of the parent group, rounded down."""
    return F.zip_with(own, parent, lambda x, y: F.floor((x * F.col(n) + y * prior) / (F.col(n) + prior)))


def thresholds(counts: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) of the sketch: <measure>_mid, <measure>_most and word_len_least."""
    counts, path = materialize(counts, "quality-sketch")
    own = quantiles(counts, ["lang", "source"])
    by_lang = quantiles(counts, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("n").alias("l_n"), F.col("q").alias("l_q"))
    of_all = quantiles(counts, []).select(F.col("measure").alias("a_measure"), F.col("q").alias("a_q"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(of_all, F.col("measure") == F.col("a_measure"))
    joined = joined.withColumn("l_q", _drawn("l_q", "l_n", "a_q", prior)).withColumn("q", _drawn("q", "n", "l_q", prior))
    of = lambda i: F.element_at(F.create_map(*[x for m, spec in MARGIN.items() for x in (F.lit(m), F.lit(spec[i]))]), F.col("measure"))
    low, mid, high = F.col("q")[0], F.col("q")[1], F.get("q", of(3))
    most, least = high + F.greatest(of(1), of(0) * (high - mid)), low - F.greatest(of(1), of(0) * (mid - low))
    rows = joined.select("lang", "source", "measure", mid.alias("mid"), most.alias("most"), least.alias("least"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    columns = [pick(m, c) for m in MARGIN for c in ("mid", "most")] + [pick(m, "least") for m, spec in MARGIN.items() if spec[2]]
    limits, _ = materialize(rows.groupBy("lang", "source").agg(*columns), "quality-limits")
    remove(counts.sparkSession, path)
    return limits


def _plain(df: DataFrame, keep: tuple[str, ...], text: str, lang: str, source: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))


def _judged(found: DataFrame, limits: DataFrame) -> DataFrame:
    """Add kept: the base rules, and each measure within its group's thresholds (any, if the group has none).

    A document of n < FULL_WORDS words says little of its own, so its measure counts as n parts of itself and the rest of its
    group's median.
    """
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = found.join(limits, found["lang"].eqNullSafe(F.col("_lang")) & found["source"].eqNullSafe(F.col("_source")), "left")
    weight = F.least(F.col("n_words"), F.lit(FULL_WORDS))
    off = lambda m: (F.col(m) - F.col(f"{m}_mid")) * weight
    fits = [off(m) <= (F.col(f"{m}_most") - F.col(f"{m}_mid")) * FULL_WORDS for m in MARGIN]
    fits += [off(m) >= (F.col(f"{m}_least") - F.col(f"{m}_mid")) * FULL_WORDS for m, spec in MARGIN.items() if spec[2]]
    verdict = ~F.col("base_failed")
    for f in fits:
        verdict = verdict & F.coalesce(f, F.lit(True))
    return joined.withColumn("kept", verdict)


def _measured_once(df: DataFrame, keep: tuple[str, ...], text: str, lang: str, source: str, least_words: int, prior: int) -> DataFrame:
    found, _ = materialize(with_bins(measured(_plain(df, keep, text, lang, source), "_text"), least_words).drop("_text"), "quality")
    return _judged(found, thresholds(sketch(found), prior))


def passing(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_words: int = LEAST_WORDS, prior: int = PRIOR) -> DataFrame:
    """The rows of ``df`` that :func:`apply_rules` keeps, with all their columns, whatever these are called.

    Nulls, empty tables, ties and repeated rows are as there; a null or empty text goes, long texts are measured whole.
    Measuring costs far more than writing, so rows are measured once and written with their measures to the shared folder.
    """
    kept = _measured_once(df, tuple(df.columns), text, lang, source, least_words, prior).where("kept")
    return kept.select(*[F.col(f"`keep_{c}`").alias(c) for c in df.columns])


def apply_rules(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang", source: str = "source", least_words: int = LEAST_WORDS, prior: int = PRIOR) -> DataFrame:
    """*keep, the measures, base_failed and kept of every row of ``df``.

    Null texts have no words and fail; null languages and sources are groups of their own; a group whose documents all fail
    the base rules needs no thresholds; repeated rows get the same verdict each; an empty table gives no rows; other columns
    of ``df`` are left out.  Measures are computed once and written with ``keep`` to the shared folder; thresholds are one row
    per (language, source) and joined by Spark's own choice of join.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _measured_once(df, keep, text, lang, source, least_words, prior)
    return judged.select(*[F.col(f"`keep_{c}`").alias(c) for c in keep], *[c for c in out if c not in keep], "kept")


_MEASURES = r"""
t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, range(0, 3) x(k) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON w.r = c.r),
x AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_pm, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_pm,
             1000 * n_repeat_words // greatest(n_words, 1) AS repeat_pm, CAST(100 * word_chars // greatest(n_words, 1) AS BIGINT) AS len_,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
b AS (SELECT *, (len_ >> greatest(length(bin(len_)) - 10, 0)) << greatest(length(bin(len_)) - 10, 0) AS word_len FROM x),
s AS (SELECT lang, source, 'symbol_pm' AS measure, 3 AS times, 20 AS least_margin, 3 AS tail, symbol_pm AS bin FROM b WHERE NOT base_failed
      UNION ALL SELECT lang, source, 'dup_line_pm', 3, 340, 4, dup_line_pm FROM b WHERE NOT base_failed
      UNION ALL SELECT lang, source, 'repeat_pm', 10, 60, 4, repeat_pm FROM b WHERE NOT base_failed
      UNION ALL SELECT lang, source, 'word_len', 5, 30, 4, word_len FROM b WHERE NOT base_failed),
q0 AS (SELECT lang, source, measure, times, least_margin, tail, count(*) AS n, quantile_disc(bin, [0.1, 0.5, 0.75, 0.9]) AS q FROM s GROUP BY ALL),
q1 AS (SELECT lang, measure, count(*) AS n, quantile_disc(bin, [0.1, 0.5, 0.75, 0.9]) AS q FROM s GROUP BY ALL),
q2 AS (SELECT measure, quantile_disc(bin, [0.1, 0.5, 0.75, 0.9]) AS q FROM s GROUP BY ALL),
p1 AS (SELECT lang, measure, list_transform([1, 2, 3, 4], lambda i: (q1.n * q1.q[i] + 200 * q2.q[i]) // (q1.n + 200)) AS q FROM q1 JOIN q2 USING (measure)),
p AS (SELECT q0.lang, source, q0.measure, times, least_margin, tail, list_transform([1, 2, 3, 4], lambda i: (q0.n * q0.q[i] + 200 * p1.q[i]) // (q0.n + 200)) AS q
      FROM q0 JOIN p1 ON q0.lang IS NOT DISTINCT FROM p1.lang AND q0.measure = p1.measure),
l AS (SELECT lang, source, measure, q[tail] + greatest(least_margin, times * (q[tail] - q[2])) AS most, q[1] - greatest(least_margin, times * (q[2] - q[1])) AS least FROM p),
v AS (SELECT lang, source, max(most) FILTER (measure = 'symbol_pm') AS a, max(most) FILTER (measure = 'dup_line_pm') AS b_,
             max(most) FILTER (measure = 'repeat_pm') AS c_, max(most) FILTER (measure = 'word_len') AS d_, max(least) FILTER (measure = 'word_len') AS e_
      FROM l GROUP BY ALL)
"""
ORACLE_SQL = f"""
WITH {_MEASURES.strip()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_pm <= a, true) AND coalesce(dup_line_pm <= b_, true) AND coalesce(repeat_pm <= c_, true)
       AND coalesce(word_len <= d_, true) AND coalesce(word_len >= e_, true) AS kept
FROM b LEFT JOIN v ON b.lang IS NOT DISTINCT FROM v.lang AND b.source IS NOT DISTINCT FROM v.source
"""
