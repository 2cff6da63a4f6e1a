"""Text expressions shared by search, matching and quality checks. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored when titles and authors are compared.
STOPWORDS = ["the", "a", "an", "of", "and", "in", "on", "at", "to", "for", "with", "by", "from", "vol", "volume", "edition",
             "ed", "nd", "rd", "th", "st"]

# Edition notes removed from titles.
EDITION_PATTERNS = [
    r"\(\d+(?:st|nd|rd|th)?\s*ed\.?\)",
    r"\d+(?:st|nd|rd|th)?\s*edition",
    r"revised\s+edition",
    r"international\s+edition",
]


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(column(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


WHITE = " \t\n\r\f\x0b"


def strip(text: str | Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(column(text), F.lit(WHITE))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, for expressions that refer to it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: str | Column) -> Column:
    return strip(F.regexp_replace(column(text), r"\s+", " "))


def normalize_title(text: str | Column, remove_editions: bool = True) -> Column:
    """Lower case, edition notes out, punctuation to blanks, blanks squeezed; null counts as empty."""
    out = F.lower(F.coalesce(column(text), F.lit("")))
    if remove_editions:
        for pattern in EDITION_PATTERNS:
            out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_]+", " "))


def title_tokens(text: str | Column) -> Column:
    """Words of the normalised title without stopwords, all words when nothing else is left. Repeats stay."""
    words = F.filter(F.split(normalize_title(text), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def loose_title(text: str | Column) -> Column:
    """Catalogue side of the normalised comparison: dots and commas out, hyphens to blanks."""
    return F.translate(F.lower(column(text)), "-.,", " ")


def grams(text: str | Column, n: int) -> Column:
    """Distinct character n-grams, read off in one pass by a look-ahead; empty for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(column(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def count_of(text: str | Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    text = column(text)
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def lines(text: str | Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(column(text), r"\r\n|[\n\r]"), strip), lambda x: x != "")
