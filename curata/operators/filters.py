"""Row filters (survey C1-C7, C10-C13).

All are plain ``filter`` calls on Column predicates, so Catalyst merges
consecutive ones into one ``Filter`` and pushes what it can (dates, equality,
``IN``) into the Parquet scan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_CLASS, blank_to_null, regex_escape

# The reference's default block-lists.
TITLE_BLOCK_TERMS = ["survey", "review", "progress"]   # substring, any case
ABSTRACT_BLOCK_WORDS = ["thesis"]                      # whole word, any case


def require_text(df: DataFrame, cols: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """Keep rows whose columns are neither NULL nor the empty string."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & blank_to_null(c).isNotNull()
    return df.filter(cond)


def title_block_regex(terms: Iterable[str]) -> str:
    return "|".join(regex_escape(t.lower()) for t in terms)


def exclude_title_terms(df: DataFrame, terms: Iterable[str] = TITLE_BLOCK_TERMS, col: str = "title") -> DataFrame:
    """Drop rows whose title contains any term (case-insensitive substring).
    NULL titles are dropped too (they are removed by C1 in every pipeline); an
    empty list drops nothing."""
    terms = list(terms)
    if not terms:
        return df
    return df.filter(~F.lower(F.col(col)).rlike(title_block_regex(terms)))


def word_block_regex(words: Iterable[str]) -> str:
    alt = "|".join(regex_escape(w.lower()) for w in words)
    return f"(?<!{WORD_CLASS})(?:{alt})(?!{WORD_CLASS})"


def exclude_abstract_words(df: DataFrame, words: Iterable[str] = ABSTRACT_BLOCK_WORDS, col: str = "abstract") -> DataFrame:
    """Drop rows whose abstract contains any word as a whole word
    (case-insensitive; ``Éthesis`` and ``synthesis`` do not match ``thesis``); an
    empty list drops nothing."""
    words = list(words)
    if not words:
        return df
    return df.filter(~F.lower(F.col(col)).rlike(word_block_regex(words)))


def filter_language(df: DataFrame, lang: str = "en", col: str = "language") -> DataFrame:
    """C4: declared-language filter, applied only if the column exists."""
    if col not in df.columns:
        return df
    return df.filter(F.col(col).contains(lang))


def _as_date(d) -> Column | None:
    if d is None:
        return None
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        return F.lit(d.isoformat()[:10]).cast("date")
    return F.lit(str(d)).cast("date")


def between_dates(df: DataFrame, start=None, end=None, col: str = "publication_date") -> DataFrame:
    """Inclusive date range; an open side is unbounded; NULL dates drop out."""
    c = F.col(col).cast("date")
    cond = c.isNotNull()
    s, e = _as_date(start), _as_date(end)
    if s is not None:
        cond = cond & (c >= s)
    if e is not None:
        cond = cond & (c <= e)
    return df.filter(cond)


def between_years(df: DataFrame, y0: int | None = None, y1: int | None = None, col: str = "publication_date") -> DataFrame:
    """Inclusive year range, as a date range, so that the scan can use it."""
    return between_dates(df, None if y0 is None else f"{int(y0):04d}-01-01", None if y1 is None else f"{int(y1):04d}-12-31", col)


def filter_doc_types(df: DataFrame, allowed: Iterable[str], col: str = "type") -> DataFrame:
    """Source-side document-type restriction."""
    return df.filter(F.col(col).isin(list(allowed)))


def score_at_least(df: DataFrame, threshold: float, col: str = "semantic_score") -> DataFrame:
    """Inclusive score threshold."""
    return df.filter(F.col(col) >= F.lit(float(threshold)))


def by_status(df: DataFrame, *status: str, col: str = "status") -> DataFrame:
    """Status filter."""
    return df.filter(F.col(col).isin(list(status)))
