"""Many phrases in one pass: table-valued synonyms (survey D6) and inflected keywords.

``phrase_hits`` finds which phrases of a *table* -- thousands or millions of them -- stand in which records.  A text is cut once into its words and
what stands between them; each word is looked up among the phrases that begin with it, and only where one does the words and separators that follow
are compared.  So the cost is one look-up a word, however many phrases there are.  Phrases are broadcast in passes of at most ``PER_PASS``
(counted before); a larger table means more passes.

A phrase matches as a term of boolean search does: whole, case-insensitively, on the I2-normalised text; a trailing ``*`` makes it a prefix
(short prefixes of one word are looked up by their first letters).  Phrases that begin or end with other than a letter, digit or underscore are refused.

``boolean_search_table`` is C9 with its synonyms in a table, ``lemma_table`` and ``keyword_forms`` the dictionary lemmatiser re-aimed at the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_search
from ..functions.words import ahead, words
from ..sources.stages import cut
from . import search
from .term_index import OTHER, WORD

PER_PASS = 200_000
#: Letters by which prefixes of one word are looked up, at most.
LETTERS = 3


def cut_words(text: Column) -> tuple[Column, Column]:
    """Words of a normalised text, and what stands before each of them; both have one entry more, for what ends the text."""
    t, pattern = F.concat(text, F.lit(" x")), F.lit(f"({OTHER})({WORD})")
    return F.regexp_extract_all(t, pattern, F.lit(2)), F.regexp_extract_all(t, pattern, F.lit(1))


def prepared(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """The phrases cut as texts are, with the key by which they are looked up; those that cannot be looked up are left out."""
    t = F.trim(norm_search(phrase))
    own = phrases.withColumn("__prefix", t.endswith("*")).withColumn("__t", F.rtrim(F.rtrim(t, F.lit("*"))))
    own = own.filter(F.col("__t").rlike(r"^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$"))
    words, gaps = cut_words(F.col("__t"))
    own = own.withColumns({"__words": words, "__gaps": gaps}).withColumns({"__n": F.size("__words") - 1})
    own = own.withColumns({"__words": F.slice("__words", F.lit(1), F.col("__n")), "__gaps": F.slice("__gaps", F.lit(2), F.col("__n") - 1)})
    short = F.col("__prefix") & (F.col("__n") == 1)
    first = F.get("__words", F.lit(0))
    k = F.least(F.length(first), F.lit(LETTERS))
    return own.withColumn("__key", F.when(short, F.concat(k.cast("string"), F.lit(":"), F.substring(first, F.lit(1), k))).otherwise(F.concat(F.lit("="), first))).drop("__t")


def phrase_hits(df: DataFrame, phrases: DataFrame, fields: Sequence[str] = ("title", "abstract"), key: str = "ord", phrase: str = "phrase",
                per_pass: int = PER_PASS) -> DataFrame:
    """``key``, field (its number) and the columns of ``phrases``: one row for each record, field and phrase that stands in it."""
    columns = [c for c in phrases.columns if c != phrase] + [phrase]
    # written once: else the optimiser pushes tests of the cut phrases down to where the phrases come from, and cuts them again for each
    ready = cut(prepared(cut(phrases.dropDuplicates(), "phrases"), phrase), "prepared")
    counts = ready.agg(F.count("*").alias("n"), F.count_if(~F.col("__key").startswith("=")).alias("p"), F.max("__n").alias("longest")).first()
    reach = counts.longest or 1
    found = []
    for i, f in enumerate(fields):
        # a row for each word holds the words that a phrase may reach from there, not the whole text
        texts = df.filter(F.col(f).isNotNull())
        at = ahead(texts, norm_search(f), [key], reach) if reach > 1 else words(texts, norm_search(f), [key], "__word")
        exact = F.concat(F.lit("="), F.col("__word"))
        if counts.p:
            begins = [F.when(F.length("__word") >= k, F.concat(F.lit(f"{k}:"), F.substring("__word", 1, k))) for k in range(1, LETTERS + 1)]
            probes = at.withColumn("__key", F.explode(F.array_compact(F.array(exact, *begins))))
        else:
            probes = at.withColumn("__key", exact)
        passes = max(1, -(-counts.n // per_pass))
        for p in range(passes):
            some = ready if passes == 1 else ready.filter(F.pmod(F.xxhash64("__key", phrase), F.lit(passes)) == p)
            n = F.col("__n")
            from_here, gaps = (F.col("__w"), F.col("__g")) if reach > 1 else (F.array("__word"), F.array().cast("array<string>"))
            own = F.slice(from_here, F.lit(1), n)
            between = F.slice(gaps, F.lit(1), n - 1) == F.col("__gaps")
            last, theirs = F.get(own, n - 1), F.get("__words", n - 1)
            whole = own == F.col("__words")
            begun = F.col("__prefix") & (F.slice(own, F.lit(1), n - 1) == F.slice("__words", F.lit(1), n - 1)) & last.startswith(theirs)
            hit = probes.join(F.broadcast(some), "__key").filter((n <= F.size(from_here)) & between & F.coalesce(whole | begun, F.lit(False)))
            found.append(hit.select(key, F.lit(i).alias("field"), *columns).distinct())
    out = reduce(DataFrame.unionByName, found)
    return out


def boolean_search_table(df: DataFrame, query: str, synonyms: DataFrame, fields: Sequence[str] = ("title", "abstract"), across_fields: bool = False,
                         key: str = "ord") -> DataFrame:
    """C9 with D6 as a table ``synonyms`` (keyword, phrase): the rows that ``boolean_search`` keeps with the same synonyms as a mapping."""
    skeleton, groups = search.compile_query(query)
    spark = df.sparkSession
    own = [(i, t.text + ("*" if t.prefix else "")) for i, g in enumerate(groups) for t in g]
    asked = spark.createDataFrame([(i, t.rstrip("*"), t) for i, t in own], "g int, keyword string, phrase string")
    given = synonyms.select(F.lower(F.col("keyword")).alias("keyword"), "phrase").join(F.broadcast(asked.select("g", "keyword")), "keyword").select("g", "phrase")
    hits = phrase_hits(df, asked.select("g", "phrase").unionByName(given), fields, key)
    by = [key] if across_fields else [key, "field"]
    flags = [F.max(F.col("g") == i).alias(f"__t{i}") for i in range(len(groups))]
    right = hits.groupBy(*by).agg(*flags).filter(F.expr(skeleton)).select(F.col(key).alias("__ord")).distinct()
    return df.join(right, F.col(key) == F.col("__ord"), "left_semi")


# --- I7: lemmas by the corpus's own vocabulary ------------------------------------------

#: Endings of plurals and what stands in their place, in the order in which they are tried.
DETACH = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
#: Plurals that no rule gives, and words that look like plurals.
IRREGULAR = {
    "analyses": "analysis", "axes": "axis", "bases": "basis", "crises": "crisis", "hypotheses": "hypothesis", "theses": "thesis", "syntheses": "synthesis",
    "criteria": "criterion", "phenomena": "phenomenon", "data": "datum", "media": "medium", "children": "child", "feet": "foot", "geese": "goose", "mice": "mouse",
    "lice": "louse", "oxen": "ox", "teeth": "tooth", "indices": "index", "matrices": "matrix", "vertices": "vertex", "appendices": "appendix", "knives": "knife",
    "lives": "life", "wives": "wife", "formulae": "formula", "nuclei": "nucleus", "stimuli": "stimulus", "radii": "radius", "fungi": "fungus", "corpora": "corpus",
    "genera": "genus", "species": "species", "series": "series", "news": "news", "gas": "gas", "bus": "bus", "lens": "lens", "physics": "physics",
    "mathematics": "mathematics", "always": "always", "this": "this", "is": "is", "was": "was", "has": "has", "as": "as", "its": "its", "us": "us",
}
LEAST_LETTERS = 3


def vocabulary(df: DataFrame, text: str = "abstract") -> DataFrame:
    """token, n: the words of a column, lower case, and how often they stand there."""
    return words(df, norm_search(text), name="token").groupBy("token").agg(F.count("*").alias("n"))


def lemma_table(words: DataFrame) -> DataFrame:
    """token, lemma for every word of a ``vocabulary``: the irregular form, else the first detachment that is itself a word of the vocabulary, else
    the word.  One join of the distinct words with themselves; texts are not touched."""
    words = cut(words, "vocabulary")
    token = F.col("token")
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    tries = [F.when(token.endswith(end) & (F.length(token) - len(end) + len(put) >= LEAST_LETTERS),
                    F.struct(F.lit(i).alias("i"), F.concat(F.substring(token, F.lit(1), F.length(token) - len(end)), F.lit(put)).alias("base"))) for i, (end, put) in enumerate(DETACH)]
    tried = (words.select("token", F.explode(F.array_compact(F.array(*tries))).alias("t")).select("token", "t.i", "t.base")
             .join(words.select(F.col("token").alias("base")), "base", "left_semi").groupBy("token").agg(F.min_by("base", "i").alias("base")))
    return words.join(tried, "token", "left").select("token", F.coalesce(F.try_element_at(irregular, token), "base", "token").alias("lemma"))


def keyword_forms(keywords: DataFrame, lemmas: DataFrame) -> DataFrame:
    """keyword, phrase: every form that a keyword of one word takes in the corpus, by its lemma -- a synonym table for ``phrase_hits``."""
    own = keywords.select("keyword", F.lower("keyword").alias("token")).join(lemmas, "token", "left").select("keyword", F.coalesce("lemma", "token").alias("lemma"))
    return own.join(lemmas, "lemma").select("keyword", F.col("token").alias("phrase")).unionByName(keywords.select("keyword", F.lower("keyword").alias("phrase"))).distinct()


def lemma_table_sql(tokens: str) -> str:
    """DuckDB twin of ``lemma_table`` over a relation ``tokens`` with a column token (distinct)."""
    tries = " UNION ALL ".join(f"SELECT token, {i} AS i, substr(token, 1, length(token) - {len(e)}) || '{p}' AS base FROM {tokens} "
                               f"WHERE ends_with(token, '{e}') AND length(token) - {len(e)} + {len(p)} >= {LEAST_LETTERS}" for i, (e, p) in enumerate(DETACH))
    irregular = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    return f"""SELECT v.token, coalesce(irr.lemma, d.base, v.token) AS lemma FROM {tokens} v
LEFT JOIN (SELECT token, arg_min(base, i) AS base FROM ({tries}) WHERE base IN (SELECT token FROM {tokens}) GROUP BY token) d USING (token)
LEFT JOIN (VALUES {irregular}) irr(token, lemma) ON irr.token = v.token"""
