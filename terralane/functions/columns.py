"""Small column expressions: coercion, alternates, and the four meanings of a true flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which lower-case strings count as true, by where the flag comes from.
TRUE_WORDS = {
    "candidate": ("yes", "true", "1", "bridge", "tunnel", "culvert"),
    "feature": ("1", "true", "yes", "y", "bridge", "tunnel", "culvert", "covered"),
    "score": ("true", "1", "yes", "bridge", "tunnel"),
    "point": ("1", "true", "yes", "y"),
    "stream_tunnel": ("culvert", "yes", "covered"),
}


def col_or(df: DataFrame, name: str, default: object = None) -> Column:
    """A column, or a literal where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(default)


def number(c: Column | str) -> Column:
    """As double; null for text that is no number, and for NaN."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def number_or(df: DataFrame, name: str, default: float | None = None) -> Column:
    return F.coalesce(number(name), F.lit(default)) if name in df.columns else F.lit(default).cast("double")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null (``greatest`` and ``least`` would skip it)."""
    if low is not None:
        c = F.when(c < low, F.lit(float(low))).otherwise(c)
    if high is not None:
        c = F.when(c > high, F.lit(float(high))).otherwise(c)
    return c


def text(c: Column | str) -> Column:
    """As string, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column | str, kind: str) -> Column:
    return F.lower(text(c)).isin(*TRUE_WORDS[kind])


def flag_is_one(df: DataFrame, name: str) -> Column:
    """Whether a numeric flag column, if there is one, is 1 when cut to a whole number."""
    return F.coalesce(number(name), F.lit(0.0)).cast("long") == 1 if name in df.columns else F.lit(False)


def first_of(df: DataFrame, names: tuple[str, ...], cast: str | None = None) -> Column:
    """The first of these columns that the table has and that is not null; with ``cast``, that also parses."""
    found = [F.col(n).try_cast(cast) if cast else F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(cast or "string")


def first_non_empty(*columns: Column) -> Column:
    """The first that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in columns], F.lit(""))


def row_mean(pieces: list[Column]) -> Column:
    """Mean of those that are not null, 0 if none is, within [0, 1]."""
    if not pieces:
        return F.lit(0.0)
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in pieces), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in pieces), F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(clip(total / F.greatest(n, F.lit(1)), 0, 1))


def bucket(score: Column) -> Column:
    """Priority bucket: right-closed at 35, 55, 75 and 100 from -0.01; the text 'nan' outside or for null."""
    inside = (score > -0.01) & (score <= 100)
    return F.when(inside & (score <= 35), "low").when(inside & (score <= 55), "medium").when(inside & (score <= 75), "high").when(inside, "very_high").otherwise("nan")
