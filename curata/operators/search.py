"""Term search (survey C8, C8b, C9, D6, I9).

``boolean_search`` turns a boolean query such as
``'machine learning' AND ('edge' OR "fog*")`` into one filter.  Our code only
splits the text into terms and operators (I9); every term becomes a boolean
column, and the AND/OR/parenthesis structure is handed to Spark's own SQL
parser (``F.expr``), so precedence (AND before OR) and error reporting are
Spark's.  A term matches case-insensitively as a whole phrase on the
I2-normalised field; a trailing ``*`` makes it a prefix.  Synonyms expand a term
to an OR group; several fields are ORed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (lemmatize_word, lemmatize_words, long_key, norm_search, whole_phrase_regex,
                              whole_phrase_regex_re2)
from .dedup import keep_first

# Operator spellings accepted in query text.
AND_TOKENS = {"and", "&", "&&"}
OR_TOKENS = {"or", "|", "||", "¦"}


@dataclass(frozen=True)
class Term:
    text: str          # lower-cased, I2-normalised phrase without the trailing '*'
    prefix: bool


def normalize_query(expression: str) -> str:
    """Drop the ``Â`` encoding artefact, spell every operator outside
    quotes as ``AND``/``OR``, collapse whitespace."""
    out = [val for _kind, val in lex_query(expression.replace("Â", ""))]
    return re.sub(r"\s+", " ", " ".join(out)).replace("( ", "(").replace(" )", ")").strip()


def lex_query(expression: str) -> list[tuple[str, str]]:
    """Split query text into ('term', quoted-or-bare text), ('op', AND|OR) and
    ('paren', '('|')') tokens.  Quoted text is kept verbatim with its quotes."""
    s = expression.replace("Â", "")
    toks: list[tuple[str, str]] = []
    i, n = 0, len(s)
    while i < n:
        ch = s[i]
        if ch.isspace():
            i += 1
        elif ch in "'\"":
            j = s.find(ch, i + 1)
            if j < 0:
                raise ValueError(f"unbalanced quote at position {i} in query: {expression!r}")
            toks.append(("term", s[i:j + 1]))
            i = j + 1
        elif ch in "()":
            toks.append(("paren", ch))
            i += 1
        elif ch in "&|¦":
            j = i
            while j < n and s[j] in "&|¦":
                j += 1
            op = s[i:j]
            if op in AND_TOKENS:
                toks.append(("op", "AND"))
            elif op in OR_TOKENS:
                toks.append(("op", "OR"))
            else:
                raise ValueError(f"unknown operator {op!r} in query: {expression!r}")
            i = j
        else:
            j = i
            while j < n and not s[j].isspace() and s[j] not in "()'\"&|¦":
                j += 1
            word = s[i:j]
            if word.lower() in AND_TOKENS:
                toks.append(("op", "AND"))
            elif word.lower() in OR_TOKENS:
                toks.append(("op", "OR"))
            else:
                toks.append(("term", word))
            i = j
    return toks


def _term(raw: str) -> Term:
    t = raw[1:-1] if raw[:1] in "'\"" and raw[-1:] == raw[:1] else raw
    t = t.replace("-", " ").replace("\n", " ").lower().strip()
    prefix = t.endswith("*")
    return Term(t.rstrip("*").strip(), prefix)


def synonyms_for(query: str, mapping: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The synonym entries whose key is a term of ``query``."""
    keys = {k.lower(): k for k in mapping}
    found = {}
    for kind, val in lex_query(query):
        if kind == "term":
            t = _term(val).text
            if t in keys:
                found[t] = list(mapping[keys[t]])
    return found


def _expand(term: Term, synonyms: Mapping[str, Sequence[str]]) -> list[Term]:
    syn = {k.lower(): v for k, v in (synonyms or {}).items()}
    out = [term]
    for s in syn.get(term.text, []):
        out.append(_term(s))
    return out


def compile_query(query: str, synonyms: Mapping[str, Sequence[str]] | None = None):
    """Return (boolean SQL text over placeholders __t0.., list of term groups)."""
    parts: list[str] = []
    groups: list[list[Term]] = []
    for kind, val in lex_query(query):
        if kind == "term":
            parts.append(f"__t{len(groups)}")
            groups.append(_expand(_term(val), synonyms or {}))
        else:
            parts.append(val)
    if not groups:
        raise ValueError(f"query has no terms: {query!r}")
    return " ".join(parts), groups


def _sql_literal(text: str) -> str:
    """A Spark SQL string literal (backslash escapes are processed by the parser)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placeholders(skeleton: str, tests: Mapping[int, str]) -> str:
    """The query's skeleton with every term placeholder replaced by its test."""
    return re.sub(r"\b__t(\d+)\b", lambda m: tests[int(m[1])], skeleton)


def search_condition(query: str, fields: Sequence[str] = ("title", "abstract"),
                     synonyms: Mapping[str, Sequence[str]] | None = None, across_fields: bool = False) -> Column:
    """The C9 predicate as one Column: some field satisfies the whole query.
    With ``across_fields`` each term may be found in another field.

    Each field is normalised once per row and bound to a lambda variable
    (``transform(array(named_struct(...)), s -> <query>)[0]``); the query's
    AND/OR/parenthesis skeleton is parsed by Spark's SQL parser with every term
    replaced by its whole-phrase test on ``s``.  Without the binding, the
    optimizer would inline the normalisation into every term test -- one
    lower/translate pass over the text per term and field."""
    skeleton, groups = compile_query(query, synonyms)
    names = {f: f"f{i}" for i, f in enumerate(fields)}

    def body(of: Sequence[str]) -> str:
        def test(group: list[Term]) -> str:
            alts = [f"(contains(s.{names[f]}, {_sql_literal(t.text)}) AND "
                    f"s.{names[f]} RLIKE {_sql_literal(whole_phrase_regex(t.text, t.prefix))})" for t in group for f in of]
            return "coalesce(" + " OR ".join(alts) + ", false)"   # a NULL text matches nothing
        return "(" + _placeholders(skeleton, {i: test(g) for i, g in enumerate(groups)}) + ")"

    whole = body(fields) if across_fields else " OR ".join(body([f]) for f in fields)
    bound = ", ".join(f"'{names[f]}', lower(translate(`{f}`, '-\n', '  '))" for f in fields)
    return F.coalesce(F.expr(f"element_at(transform(array(named_struct({bound})), s -> {whole}), 1)"), F.lit(False))


def term_condition(term: Term, field: str) -> Column:
    """Whether one term stands in one field."""
    text = norm_search(field)
    return F.coalesce(text.contains(term.text) & text.rlike(whole_phrase_regex(term.text, term.prefix)), F.lit(False))


def boolean_search(df: DataFrame, query: str, fields: Sequence[str] = ("title", "abstract"),
                   synonyms: Mapping[str, Sequence[str]] | None = None, across_fields: bool = False) -> DataFrame:
    """Keep rows where one of ``fields`` satisfies the boolean ``query``."""
    return df.filter(search_condition(query, fields, synonyms, across_fields))


def boolean_search_sql(query: str, fields: Sequence[str] = ("title", "abstract"),
                       synonyms: Mapping[str, Sequence[str]] | None = None) -> str:
    """The same predicate as DuckDB SQL (test oracle)."""
    skeleton, groups = compile_query(query, synonyms)

    def of(f: str) -> str:
        norm = f"lower(translate({f}, '-' || chr(10), '  '))"
        tests = {}
        for i, group in enumerate(groups):
            pats = [whole_phrase_regex_re2(t.text, t.prefix).replace("'", "''") for t in group]
            tests[i] = "coalesce(" + " OR ".join(f"regexp_matches({norm}, '{p}')" for p in pats) + ", false)"
        return "(" + _placeholders(skeleton, tests) + ")"

    return "(" + " OR ".join(map(of, fields)) + ")"


# --- C8 / C8b: keyword filter on the lemmatised abstract -----------------------------

def keyword_terms(keywords: Sequence[str], synonyms: Mapping[str, Sequence[str]] | None = None,
                  mode: str = "phrase") -> list[list[str]]:
    """Per keyword the list of lemmatised alternatives.  mode='phrase' keeps each
    keyword/synonym whole (C8); mode='tokens' splits them into words (C8b)."""
    syn = synonyms or {}
    groups = []
    for kw in keywords:
        alts = [kw] + list(syn.get(kw, []))
        if mode == "tokens":
            alts = [w for a in alts for w in a.lower().split(" ") if w]
        groups.append([" ".join(lemmatize_word(w) for w in a.lower().split(" ")) for a in alts])
    return groups


def keyword_text(col: str = "abstract") -> Column:
    """The text keyword filters match on: I2-normalised, then lemmatised."""
    return lemmatize_words(norm_search(col))


def filter_keywords(df: DataFrame, keywords: Sequence[str], synonyms: Mapping[str, Sequence[str]] | None = None,
                    mode: str = "phrase", col: str = "abstract", order_by: str = "ord", status: str | None = None) -> DataFrame:
    """AND over keywords of (keyword OR synonyms) as whole words on the
    lemmatised abstract; rows without abstract drop out; then keep-first by title.  With ``status``
    the rows get dense ids and are stamped with it, as the reference's filtered set is.

    The lemmatised text is bound to a lambda variable: computed once per row, not once per keyword."""
    pats = ["|".join(whole_phrase_regex(a) for a in alts) for alts in keyword_terms(keywords, synonyms, mode)]

    def all_of(text: Column) -> Column:
        cond = text.isNotNull()
        for pat in pats:
            cond = cond & text.rlike(pat)
        return cond

    hit = F.element_at(F.transform(F.array(keyword_text(col)), all_of), 1)
    out = keep_first(df.filter(F.col(col).isNotNull() & hit), long_key(F.col("title")), order_by, "one")
    if status is None:
        return out
    from .ordering import with_dense_id
    return with_dense_id(out.drop("id"), order_by).withColumn("status", F.lit(status))
