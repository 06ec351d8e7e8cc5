"""Scalar text functions (survey I1-I4, I6-I8, I10, I15).  All are Column
expressions and stay in the JVM; those over arrays of tokens (I7, I8) are
higher-order functions, which Spark interprets outside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "word character" for whole-word matching: any Unicode letter, digit or
# underscore.  Written out as a class (instead of \w) so that Java and RE2 agree.
WORD_CLASS = r"[\p{L}\p{N}_]"
_META = set("\\.^$|?*+()[]{}")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_escape(text: str) -> str:
    """Escape regex metacharacters; the result is valid in Java and RE2."""
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def blank_to_null(c) -> Column:
    """The empty string becomes NULL (whitespace is kept, as pandas does)."""
    return F.nullif(_c(c), F.lit(""))


def norm_search(c) -> Column:
    """Search normaliser -- hyphen and newline become spaces, lower case."""
    return F.lower(F.replace(F.replace(_c(c), F.lit("-"), F.lit(" ")), F.lit("\n"), F.lit(" ")))


def norm_dedup(c) -> Column:
    """De-dup normaliser -- lower case; hyphens, newlines and spaces removed.

    The reference turns hyphens into spaces and then removes spaces, which is the
    same as removing all three characters in one pass."""
    return F.translate(F.lower(_c(c)), "- \n", "")


def norm_review(c) -> Column:
    """I4: review normaliser -- lower case, spaces removed."""
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit(""))


def long_key(c) -> Column:
    """Shuffle key for long text (titles, abstracts): SHA-256 of the text.

    A 32-byte digest stands for the text as key, so the text itself need not be
    exchanged; a 64-bit hash would collide at 1e11 rows, SHA-256 does not in practice.
    NULL stays NULL so that null keys still form their own group."""
    return F.unhex(F.sha2(_c(c), 256))


def whole_phrase_regex(phrase: str, prefix: bool = False) -> str:
    """Java regex matching ``phrase`` as a whole word sequence.

    ``prefix`` lets the last word continue (trailing ``*`` in a query term)."""
    body = regex_escape(phrase)
    tail = "" if prefix else f"(?!{WORD_CLASS})"
    return f"(?<!{WORD_CLASS}){body}{tail}"


def whole_phrase_regex_re2(phrase: str, prefix: bool = False) -> str:
    """The same match written for RE2 (no look-around): used by SQL oracles."""
    body = regex_escape(phrase)
    tail = "" if prefix else f"([^{WORD_CLASS[1:-1]}]|$)"
    return f"(^|[^{WORD_CLASS[1:-1]}]){body}{tail}"


def query_operators_to_words(c) -> Column:
    """The internal tokens ``<AND>``/``<OR>`` back to ``AND``/``OR``."""
    return F.replace(F.replace(_c(c), F.lit("<AND>"), F.lit("AND")), F.lit("<OR>"), F.lit("OR"))


def year_text(c) -> Column:
    """A year stored as a float string (``2021.0``) cut at the dot."""
    return F.split_part(_c(c).cast("string"), F.lit("."), F.lit(1))


def prefixed_id(doi) -> Column:
    """Citation-service id -- ``URL:`` for links, ``DOI:`` otherwise."""
    d = _c(doi)
    return F.when(d.contains("http"), F.concat(F.lit("URL:"), d)).otherwise(F.concat(F.lit("DOI:"), d))


# Noun-plural rules standing in for a dictionary lemmatiser
# (irregular forms are not covered).  Applied to one whitespace token.
#   ...ies -> ...y   (studies -> study)      ...sses -> ...ss (classes -> class)
#   ...ches/shes/xes/zes -> drop "es"        ...ss, ...us, ...is -> unchanged
#   other ...s -> drop "s" (models -> model); tokens of 3 chars or fewer unchanged
def lemma_token(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(n <= 3, t)
        .when(t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("sses"), t.substr(F.lit(1), n - 2))
        .when(t.endswith("ches") | t.endswith("shes") | t.endswith("xes") | t.endswith("zes"), t.substr(F.lit(1), n - 2))
        .when(t.endswith("ss") | t.endswith("us") | t.endswith("is"), t)
        .when(t.endswith("s"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def lemma_token_sql(t: str) -> str:
    """The same rules as SQL text (Spark and DuckDB accept it)."""
    return (
        f"CASE WHEN length({t}) <= 3 THEN {t} "
        f"WHEN ends_with({t}, 'ies') THEN substr({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'sses') THEN substr({t}, 1, length({t}) - 2) "
        f"WHEN ends_with({t}, 'ches') OR ends_with({t}, 'shes') OR ends_with({t}, 'xes') OR ends_with({t}, 'zes') "
        f"THEN substr({t}, 1, length({t}) - 2) "
        f"WHEN ends_with({t}, 'ss') OR ends_with({t}, 'us') OR ends_with({t}, 'is') THEN {t} "
        f"WHEN ends_with({t}, 's') THEN substr({t}, 1, length({t}) - 1) "
        f"ELSE {t} END"
    )


def lemmatize_words(c) -> Column:
    """Lemmatise every space-separated token of a (normalised) text."""
    return F.array_join(F.transform(F.split(_c(c), " "), lemma_token), " ")


def lemmatize_word(word: str) -> str:
    """Driver-side twin of ``lemma_token`` for query terms."""
    w = word
    if len(w) <= 3:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ches", "shes", "xes", "zes")):
        return w[:-2]
    if w.endswith(("ss", "us", "is")):
        return w
    if w.endswith("s"):
        return w[:-1]
    return w


# Accent folding used by the tokenizer (I8).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
# What stands between the tokenizer's words.
NOT_LETTERS = r"[^\p{L}]+"


def unmarked(c) -> Column:
    """I8: a text without tags, lower case."""
    return F.lower(F.regexp_replace(_c(c), r"<[^>]+>", " "))


def tokenize(c, min_len: int = 2, max_len: int | None = 15) -> Column:
    """I8: strip tags, lower case, fold accents, split on non-letters, keep
    tokens of ``min_len``..``max_len`` characters (``None``: however long)."""
    toks = F.split(F.translate(unmarked(c), ACCENTED, UNACCENTED), NOT_LETTERS)
    if max_len is None:
        return F.filter(toks, lambda t: F.length(t) >= min_len)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len))
