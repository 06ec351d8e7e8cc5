"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB
oracle per operator of the survey.  ``__spark_entry__`` exposes this registry.

Every query reads whole driver tables (or views Spark derives from them), so its
work grows with the data; outputs alias every computed column, and doubles are
rounded to 6 places on both sides so the value hashes are comparable.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..operators import dedup, filters, search
from ..operators import incremental_dedup as ID
from ..operators import language_model as LM
from ..operators import phrase_match as PM
from ..operators import term_index as TI
from ..sources import stages
from ..sources import tables
from . import oracle as O

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


OUT = ["id", "ord", "doi", "database", "query_name", "title"]
OUT_SQL = ", ".join(OUT)

# The flagship term query: words that occur in the corpus (the reference's
# block-list words never do).
FLAGSHIP_QUERY = "'that is' OR ('with the' AND for) OR \"tion*\""
FLAGSHIP_FROM, FLAGSHIP_TO = "2016-01-01", "2023-12-31"


def _w(sql: str) -> str:
    return sql.strip()


# --- de-duplication ----------------------------------------------------------------

@register("dedup_cascade", _w(f"""
WITH {O.PAPERS_CTE},
{O.cascade('papers', 'all')}
SELECT {OUT_SQL} FROM c4"""))
def q_dedup_cascade(spark, sf):
    return dedup.remove_repeated(tables.papers(spark, sf)).select(*OUT)


@register("dedup_cascade_parity", _w(f"""
WITH {O.PAPERS_CTE},
{O.cascade('papers', 'one')}
SELECT {OUT_SQL} FROM c4"""))
def q_dedup_cascade_parity(spark, sf):
    return dedup.remove_repeated(tables.papers(spark, sf), doi_nulls="one").select(*OUT)


@register("dedup_doi", _w(f"""
WITH {O.PAPERS_CTE}
{O.keep_first('papers', "nullif(trim(lower(doi)), '')", 'all')}"""
                         .replace("SELECT * FROM papers", f"SELECT {OUT_SQL} FROM papers")))
def q_dedup_doi(spark, sf):
    return dedup.dedup_doi(tables.papers(spark, sf)).select(*OUT)


@register("dedup_title", _w(f"""
WITH {O.PAPERS_CTE}
{O.keep_first('papers', O.norm_dedup('title'))}""".replace("SELECT * FROM papers", f"SELECT {OUT_SQL} FROM papers")))
def q_dedup_title(spark, sf):
    return dedup.dedup_title(tables.papers(spark, sf)).select(*OUT)


@register("dedup_abstract", _w(f"""
WITH {O.PAPERS_CTE}
{O.keep_first('papers', O.norm_dedup('abstract'))}""".replace("SELECT * FROM papers", f"SELECT {OUT_SQL} FROM papers")))
def q_dedup_abstract(spark, sf):
    return dedup.dedup_abstract(tables.papers(spark, sf)).select(*OUT)


# --- flagship: clean, date range, cascade, boolean search, count per source -------

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.papers(spark, sf)
    p = filters.require_text(p)
    p = filters.between_dates(p, FLAGSHIP_FROM, FLAGSHIP_TO)
    p = dedup.remove_repeated(p)
    p = search.boolean_search(p, FLAGSHIP_QUERY, ["title", "abstract"])
    return p.groupBy("database").agg(F.count(F.lit(1)).alias("n_records"))


REGISTRY["search_dedup_counts"] = (flagship, _w(f"""
WITH {O.PAPERS_CTE},
base AS (SELECT * FROM papers WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
         AND publication_date BETWEEN DATE '{FLAGSHIP_FROM}' AND DATE '{FLAGSHIP_TO}'),
{O.cascade('base', 'all')}
SELECT database, count(*) AS n_records FROM c4
WHERE {search.boolean_search_sql(FLAGSHIP_QUERY, ['title', 'abstract'])}
GROUP BY database"""))


# --- filters and cleaning --------------------------------------------------------------

from ..functions import dates as D          # noqa: E402
from ..functions import language as L       # noqa: E402
from ..functions import text as T           # noqa: E402
from ..plans import curation as M           # noqa: E402

# Fixed query parameters: corpus words (the reference's block-list words never
# occur in the generated prose, so they are kept and joined by corpus words).
TITLE_TERMS = filters.TITLE_BLOCK_TERMS + ["thth", "eau"]
ABSTRACT_WORDS = filters.ABSTRACT_BLOCK_WORDS + ["est", "para"]
KEYWORDS = ["thing", "that is"]
SYNONYMS = {"thing": ["stuff", "ouen"], "that is": ["this is", "it was"]}


def _re2_words(words) -> str:
    alt = "|".join(T.regex_escape(w.lower()) for w in words)
    wc = T.WORD_CLASS[1:-1]
    return f"(^|[^{wc}])({alt})([^{wc}]|$)"


@register("require_text", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL"""))
def q_require_text(spark, sf):
    return filters.require_text(tables.papers(spark, sf)).select(*OUT)


@register("exclude_title_terms", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers
WHERE NOT regexp_matches(lower(title), '{"|".join(T.regex_escape(t) for t in TITLE_TERMS)}')"""))
def q_exclude_title_terms(spark, sf):
    return filters.exclude_title_terms(tables.papers(spark, sf), TITLE_TERMS).select(*OUT)


@register("exclude_abstract_words", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE NOT regexp_matches(lower(abstract), '{_re2_words(ABSTRACT_WORDS)}')"""))
def q_exclude_abstract_words(spark, sf):
    return filters.exclude_abstract_words(tables.papers(spark, sf), ABSTRACT_WORDS).select(*OUT)


@register("declared_language", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE contains(lang, 'en')"""))
def q_declared_language(spark, sf):
    return filters.filter_language(tables.papers(spark, sf), "en", col="lang").select(*OUT)


@register("detect_language", _w(f"""
SELECT doc_id, lang, {L.detect_language_sql('text')} AS detected FROM documents"""))
def q_detect_language(spark, sf):
    d = tables.table(spark, sf, "documents")
    return L.with_language(d, "text", "detected").select("doc_id", "lang", "detected")


@register("language_accuracy", _w(f"""
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN detected = lang THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
FROM (SELECT lang, {L.detect_language_sql('text')} AS detected FROM documents) GROUP BY lang"""))
def q_language_accuracy(spark, sf):
    d = L.with_language(tables.table(spark, sf, "documents"), "text", "detected")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.when(F.col("detected") == F.col("lang"), 1).otherwise(0)).cast("long").alias("n_agree"))


@register("between_dates", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE publication_date BETWEEN DATE '2017-03-01' AND DATE '2021-10-31'"""))
def q_between_dates(spark, sf):
    return filters.between_dates(tables.papers(spark, sf), "2017-03-01", "2021-10-31").select(*OUT)


@register("between_years", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE year(publication_date) BETWEEN 2018 AND 2020"""))
def q_between_years(spark, sf):
    return filters.between_years(tables.papers(spark, sf), 2018, 2020).select(*OUT)


def _keyword_sql(mode: str) -> str:
    text = (f"array_to_string(list_transform(string_split({O.norm_search('abstract')}, ' '), "
            f"lambda t: {T.lemma_token_sql('t')}), ' ')")
    conds = []
    for alts in search.keyword_terms(KEYWORDS, SYNONYMS, mode):
        conds.append(f"regexp_matches({text}, '{_re2_words(alts)}')")
    return (f"WITH {O.PAPERS_CTE},\nk AS (SELECT * FROM papers WHERE abstract IS NOT NULL AND {' AND '.join(conds)})\n"
            f"SELECT {OUT_SQL} FROM k QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1")


@register("keyword_filter", _keyword_sql("phrase"))
def q_keyword_filter(spark, sf):
    return search.filter_keywords(tables.papers(spark, sf), KEYWORDS, SYNONYMS).select(*OUT)


@register("keyword_filter_tokens", _keyword_sql("tokens"))
def q_keyword_filter_tokens(spark, sf):
    return search.filter_keywords(tables.papers(spark, sf), KEYWORDS, SYNONYMS, mode="tokens").select(*OUT)


@register("keyword_filter_stamped", _w(f"""
SELECT row_number() OVER (ORDER BY ord) AS id, ord, 'filtered' AS status, title FROM ({_keyword_sql("phrase")}) t"""))
def q_keyword_filter_stamped(spark, sf):
    """C8 with new ids and the status of a filtered set."""
    return search.filter_keywords(tables.papers(spark, sf), KEYWORDS, SYNONYMS, status="filtered").select("id", "ord", "status", "title")


BOOLEAN_QUERIES = {
    "boolean_search": "'that is' AND (thing OR 'it was') OR \"ouen\"",
    "boolean_search_synonyms": "thing && ('with the' || 'for')",
}


def _bool_q(name, query, synonyms=None):
    synonyms = search.synonyms_for(query, synonyms) if synonyms else None   # D6: the entries of this query's terms
    sql = _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE {search.boolean_search_sql(query, ['title', 'abstract'], synonyms)}""")

    def fn(spark, sf):
        return search.boolean_search(tables.papers(spark, sf), query, ["title", "abstract"], synonyms).select(*OUT)
    REGISTRY[name] = (fn, sql)


_bool_q("boolean_search", BOOLEAN_QUERIES["boolean_search"])
_bool_q("boolean_search_synonyms", BOOLEAN_QUERIES["boolean_search_synonyms"], SYNONYMS)


def _indexed_q(name, query, synonyms=None):
    synonyms = search.synonyms_for(query, synonyms) if synonyms else None

    @register(name, REGISTRY[name.removeprefix("indexed_")][1])
    def fn(spark, sf):
        """C9 by the positional term index: the rows of the scan."""
        from ..streaming.incremental import run_folder
        p = tables.papers(spark, sf)
        index = TI.build(p, run_folder(spark, "term-index"), ["title", "abstract"])
        return index.search(p, query, synonyms).select(*OUT)


_indexed_q("indexed_boolean_search", BOOLEAN_QUERIES["boolean_search"])
_indexed_q("indexed_boolean_search_synonyms", BOOLEAN_QUERIES["boolean_search_synonyms"], SYNONYMS)


SYNONYM_QUERY = "thing AND (for OR 'it was')"
# A synonym table from the corpus: for `thing` the first words of English texts, for `for` the words before the first full stop of German ones.
_SYN = {"thing": ("en", r"^([A-Za-z]+)"), "for": ("de", r"([A-Za-z]+)\.")}
_TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"


def corpus_synonyms(spark, sf) -> DataFrame:
    d = tables.table(spark, sf, "documents")
    parts = [d.filter(F.col("lang") == lang).select(F.lit(k).alias("keyword"), F.lower(F.regexp_extract("text", pat, 1)).alias("phrase")) for k, (lang, pat) in _SYN.items()]
    return parts[0].unionByName(parts[1]).filter("phrase <> ''").distinct()


@register("boolean_search_synonym_table", _w(f"""
WITH {O.PAPERS_CTE},
syn AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(f"SELECT '{k}' AS keyword, lower(regexp_extract(text, '{pat}', 1)) AS phrase FROM documents WHERE lang = '{lang}'" for k, (lang, pat) in _SYN.items())}) WHERE phrase <> ''),
w AS (SELECT *, {_TOKENS.format(O.norm_search('title'))} AS tw, {_TOKENS.format(O.norm_search('abstract'))} AS aw FROM papers),
l AS (SELECT (SELECT list(phrase) FROM syn WHERE keyword = 'thing') || ['thing'] AS things, (SELECT list(phrase) FROM syn WHERE keyword = 'for') || ['for'] AS fors)
SELECT {OUT_SQL} FROM w, l WHERE coalesce(list_has_any(tw, things) AND (list_has_any(tw, fors) OR regexp_matches({O.norm_search('title')}, '{T.whole_phrase_regex_re2('it was')}')), false)
  OR coalesce(list_has_any(aw, things) AND (list_has_any(aw, fors) OR regexp_matches({O.norm_search('abstract')}, '{T.whole_phrase_regex_re2('it was')}')), false)"""))
def q_boolean_search_synonym_table(spark, sf):
    """D6 with the synonyms in a table that grows with the corpus."""
    return PM.boolean_search_table(tables.papers(spark, sf), SYNONYM_QUERY, corpus_synonyms(spark, sf)).select(*OUT)


_VOCAB_SQL = f"""{O.PAPERS_CTE},
vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format(O.norm_search('abstract'))}) AS token FROM papers) GROUP BY token),
lemmas AS ({PM.lemma_table_sql('vocab')})"""


@register("lemma_table", _w(f"""
WITH {_VOCAB_SQL} SELECT token, lemma FROM lemmas"""))
def q_lemma_table(spark, sf):
    """A lemma for every word of the corpus, by its own vocabulary."""
    return PM.lemma_table(PM.vocabulary(tables.papers(spark, sf)))


FORM_KEYWORDS = ["thing", "ing", "der"]


@register("keyword_forms", _w(f"""
WITH {_VOCAB_SQL},
k AS (SELECT unnest({FORM_KEYWORDS}) AS keyword),
f AS (SELECT DISTINCT keyword, l2.token AS phrase FROM k LEFT JOIN lemmas l1 ON l1.token = keyword JOIN lemmas l2 ON l2.lemma = coalesce(l1.lemma, keyword) UNION SELECT keyword, keyword FROM k),
t AS (SELECT DISTINCT ord, unnest({_TOKENS.format(O.norm_search('abstract'))}) AS phrase FROM papers)
SELECT ord, keyword, count(*) AS n_forms FROM t JOIN f USING (phrase) GROUP BY ord, keyword"""))
def q_keyword_forms(spark, sf):
    """C8 by lemmas: which records hold which keywords in any of their forms, and in how many."""
    p = tables.papers(spark, sf)
    lemmas = stages.cut(PM.lemma_table(PM.vocabulary(p)), "lemmas")
    forms = PM.keyword_forms(spark.createDataFrame([(k,) for k in FORM_KEYWORDS], "keyword string"), lemmas)
    return PM.phrase_hits(p, forms, ["abstract"]).groupBy("ord", "keyword").agg(F.count("*").alias("n_forms"))


@register("clean_records", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers
WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
  AND NOT regexp_matches(lower(title), '{"|".join(T.regex_escape(t) for t in TITLE_TERMS)}')
  AND NOT regexp_matches(lower(abstract), '{_re2_words(ABSTRACT_WORDS)}')
  AND {L.detect_language_sql('abstract')} = 'en'"""))
def q_clean_records(spark, sf):
    return M.clean_papers(tables.papers(spark, sf), TITLE_TERMS, ABSTRACT_WORDS).select(*OUT)


# A quarter of the labelled rows is held out of what the language model learns from.
LEARN = "doc_id % 4 <> 2"


def language_model(spark, sf) -> LM.LanguageModel:
    return LM.fit(tables.table(spark, sf, "documents").filter(LEARN))


@register("learned_language", _w(f"""
WITH {LM.model_sql(f'(SELECT * FROM documents WHERE {LEARN})')},
{LM.scored_sql('documents', 'doc_id')}
SELECT doc_id AS ord, coalesce(language, 'unknown') AS language, round(margin, 6) AS margin FROM documents LEFT JOIN lm_found USING (doc_id)"""))
def q_learned_language(spark, sf):
    """C5 by a learnt model, over whole texts, with the lead over the next language."""
    df = LM.with_language(tables.table(spark, sf, "documents"), language_model(spark, sf), margin="margin")
    return df.select(F.col("doc_id").alias("ord"), "language", F.round("margin", 6).alias("margin"))


@register("learned_language_accuracy", _w(f"""
WITH {LM.model_sql(f'(SELECT * FROM documents WHERE {LEARN})')},
{LM.scored_sql(f'(SELECT * FROM documents WHERE NOT {LEARN})', 'doc_id')}
SELECT lang, count(*) AS n, count(*) FILTER (WHERE language = lang) AS n_right FROM documents JOIN lm_found USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang"""))
def q_learned_language_accuracy(spark, sf):
    """Held-out rows that are given their own language, by language."""
    held = tables.table(spark, sf, "documents").filter(~F.expr(LEARN)).filter("lang IS NOT NULL AND length(text) > 0")
    found = LM.with_language(held, language_model(spark, sf), margin="margin").filter("margin IS NOT NULL")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("n_right"))


LM_MARGIN = 0.05


@register("clean_records_learned", _w(f"""
WITH {O.PAPERS_CTE}, {LM.model_sql(f'(SELECT * FROM documents WHERE {LEARN})')},
{LM.scored_sql('papers', 'ord', 'abstract', LM_MARGIN)}
SELECT {OUT_SQL} FROM papers JOIN lm_found USING (ord)
WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
  AND NOT regexp_matches(lower(title), '{"|".join(T.regex_escape(t) for t in TITLE_TERMS)}')
  AND NOT regexp_matches(lower(abstract), '{_re2_words(ABSTRACT_WORDS)}')
  AND language = 'en'"""))
def q_clean_records_learned(spark, sf):
    """M2 with the learnt model and a margin (Q13) in place of the word profiles."""
    return M.clean_papers(tables.papers(spark, sf), TITLE_TERMS, ABSTRACT_WORDS,
                          model=language_model(spark, sf), min_margin=LM_MARGIN).select(*OUT)


@register("parse_dates", _w(f"""
SELECT ord, date_text, CAST({O.date_meaning_sql()} AS VARCHAR) AS parsed
FROM (SELECT *, ord AS doc_id FROM ({tables.date_texts_sql('documents')}) t) p"""))
def q_parse_dates(spark, sf):
    df = D.parse_dates(tables.date_texts(spark, sf), "date_text", "parsed")
    return df.select("ord", "date_text", F.col("parsed").cast("string").alias("parsed"))


# --- relevance, citations, decisions, review ------------------------------------------

from ..operators import aggregates as A     # noqa: E402
from ..operators import joins as J          # noqa: E402
from ..operators import ordering as G       # noqa: E402
from ..operators import relevance as S      # noqa: E402
from ..operators import encoder as EN       # noqa: E402
from ..operators import review as R         # noqa: E402
from ..operators import vector_index as VI  # noqa: E402
from ..streaming.incremental import run_folder  # noqa: E402

S1_LABEL, S1_T, S2_T, TOPK = 0, 0.15, 0.012, 10


@tables.memo
def vectors(spark, sf) -> DataFrame:
    e = tables.table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("id"), "embedding", "label")


def with_vectors(df: DataFrame, spark, sf) -> DataFrame:
    """Every record with a vector of its own (`tables.all_vectors`)."""
    return df.join(tables.all_vectors(spark, sf), "id")


def s1_scored(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    q = S.centroid_column(v.filter(F.col("label") == S1_LABEL), unit=True)
    p = with_vectors(tables.papers(spark, sf), spark, sf)
    return S.semantic_filter(p, q, S1_T, unit=True)


@register("semantic_filter", _w(f"""
WITH {O.PAPERS_CTE}, {O.VECS_CTE}, {O.ALL_VECS_CTE},
{O.centroid_cte('cen', 'vecs WHERE label = 0')}
SELECT p.id, p.ord, round({O.cos_to('cen', True)}, 6) AS semantic_score
FROM papers p JOIN allvecs USING (id), cen
WHERE {O.cos_to('cen', True)} >= {S1_T}"""))
def q_semantic_filter(spark, sf):
    return s1_scored(spark, sf).select("id", "ord", F.round("semantic_score", 6).alias("semantic_score"))


@register("semantic_top_k", _w(f"""
WITH {O.PAPERS_CTE}, {O.VECS_CTE}, {O.ALL_VECS_CTE},
{O.centroid_cte('cen', 'vecs WHERE label = 0')}
SELECT p.id, p.ord, round({O.cos_to('cen', True)}, 6) AS semantic_score
FROM papers p JOIN allvecs USING (id), cen
ORDER BY {O.cos_to('cen', True)} DESC, p.ord LIMIT {TOPK}"""))
def q_semantic_top_k(spark, sf):
    v = vectors(spark, sf)
    q = S.centroid_column(v.filter(F.col("label") == S1_LABEL), unit=True)
    p = S.semantic_scores(with_vectors(tables.papers(spark, sf), spark, sf), q, unit=True)
    return G.top_k(p, "semantic_score", TOPK).select("id", "ord", F.round("semantic_score", 6).alias("semantic_score"))


@tables.memo
def selected(spark, sf) -> DataFrame:
    """Records whose latest decision is 'included'."""
    return J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf)).filter(F.col("status") == "included")


@tables.memo
def removed(spark, sf) -> DataFrame:
    return J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf)).filter(
        F.col("status").isin("not included", "excluded"))


SEL_SQL = f"""{O.PAPERS_CTE}, {O.DECISIONS_CTE}, {O.LAST_CTE},
decided AS (SELECT p.* EXCLUDE (status), coalesce(l.status, p.status) AS status FROM papers p LEFT JOIN last l USING (id)),
sel AS (SELECT * FROM decided WHERE status = 'included'),
rem AS (SELECT * FROM decided WHERE status IN ('not included', 'excluded'))"""


def record_index(spark, sf) -> VI.VectorIndex:
    return VI.build(tables.all_vectors(spark, sf).withColumn("ord", F.col("id") - 1).select("ord", "embedding"),
                   run_folder(spark, "vector-index"), key="ord")


def label_centre(spark, sf) -> list[float]:
    """The query vector of `semantic_top_k`, as numbers: one row of d of them."""
    c = S.centroid_column(vectors(spark, sf).filter(F.col("label") == S1_LABEL), unit=True)
    return list(spark.range(1).select(c.alias("c")).first().c)


@register("indexed_top_k", _w(f"""
WITH {O.PAPERS_CTE}, {O.VECS_CTE}, {O.ALL_VECS_CTE},
{O.centroid_cte('cen', 'vecs WHERE label = 0')}
SELECT p.ord, round({O.cos_to('cen', True)}, 6) AS semantic_score
FROM papers p JOIN allvecs USING (id), cen
ORDER BY {O.cos_to('cen', True)} DESC, p.ord LIMIT {TOPK}"""))
def q_indexed_top_k(spark, sf):
    """G1 by the vector index: the rows of the full scan."""
    found, _cells = record_index(spark, sf).top_k(label_centre(spark, sf), TOPK)
    return found.select("ord", F.round("semantic_score", 6).alias("semantic_score"))


@register("indexed_filter", _w(f"""
WITH {O.PAPERS_CTE}, {O.VECS_CTE}, {O.ALL_VECS_CTE},
{O.centroid_cte('cen', 'vecs WHERE label = 0')}
SELECT p.ord, round({O.cos_to('cen', True)}, 6) AS semantic_score
FROM papers p JOIN allvecs USING (id), cen
WHERE {O.cos_to('cen', True)} >= {S1_T}"""))
def q_indexed_filter(spark, sf):
    """S1 by the vector index."""
    found, _cells = record_index(spark, sf).above(label_centre(spark, sf), S1_T)
    return found.select("ord", F.round("semantic_score", 6).alias("semantic_score"))


TFIDF_T = 0.05
_STATS_SQL = f"""tf AS ({EN.terms_sql('documents', 'doc_id', 'text')}),
docs_n AS (SELECT count(*) AS n FROM documents),
stats AS (SELECT term, df, n, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), docs_n)"""


@register("tfidf_terms", _w(f"""
WITH {_STATS_SQL} SELECT term, df, n, round(idf, 6) AS idf FROM stats"""))
def q_tfidf_terms(spark, sf):
    """S3: document frequencies of all words of all texts."""
    return EN.fit(tables.table(spark, sf, "documents")).select("term", "df", "n", F.round("idf", 6).alias("idf"))


@register("tfidf_relevance", _w(f"""
WITH {_STATS_SQL},
btf AS ({EN.terms_sql('benchmark', 'item_id', 'text')}),
bw AS (SELECT item_id, term, tf * idf AS w FROM btf JOIN stats USING (term)),
bn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM bw GROUP BY item_id),
q AS (SELECT term, sum(w / norm) / (SELECT count(*) FROM benchmark) AS q FROM bw JOIN bn USING (item_id) GROUP BY term),
s AS (SELECT doc_id, sum(tf * idf * coalesce(q, 0)) / sqrt(sum(tf * idf * tf * idf)) AS s FROM tf JOIN stats USING (term) LEFT JOIN q USING (term) GROUP BY doc_id)
SELECT doc_id AS ord, round(s, 6) AS semantic_score FROM s WHERE s >= {TFIDF_T}"""))
def q_tfidf_relevance(spark, sf):
    """S3 on whole texts: mean TF-IDF cosine of every record to the descriptions, the `benchmark` passages."""
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    counts = EN.word_counts(docs, "ord")
    stats = stages.cut(EN.fit(docs, counts=counts), "tfidf")
    found = EN.tfidf_relevance(docs, tables.table(spark, sf, "benchmark"), stats, TFIDF_T, counts=counts)
    return found.select("ord", F.round("semantic_score", 6).alias("semantic_score"))


@register("seed_relevance", _w(f"""
WITH {SEL_SQL}, {O.ALL_VECS_CTE},
{O.centroid_cte('cen', 'allvecs WHERE id IN (SELECT id FROM sel)')},
cand AS (SELECT * FROM papers WHERE id NOT IN (SELECT id FROM sel))
SELECT c.id, c.ord, round({O.cos_to('cen', False)}, 6) AS semantic_score
FROM cand c JOIN allvecs USING (id), cen
WHERE {O.cos_to('cen', False)} >= {S2_T}"""))
def q_seed_relevance(spark, sf):
    seeds = with_vectors(selected(spark, sf), spark, sf)
    cand = with_vectors(tables.papers(spark, sf).join(selected(spark, sf).select("id"), "id", "left_anti"), spark, sf)
    return S.relevance_to_seeds(cand, seeds, S2_T).select("id", "ord", F.round("semantic_score", 6).alias("semantic_score"))


@register("seed_relevance_pairwise", _w(f"""
WITH {SEL_SQL}, {O.ALL_VECS_CTE},
seeds AS (SELECT v AS sv, n AS sn FROM allvecs WHERE id IN (SELECT id FROM sel)),
cand AS (SELECT c.id, c.ord, v, n FROM papers c JOIN allvecs USING (id) WHERE c.id NOT IN (SELECT id FROM sel))
SELECT id, ord, round(avg(CASE WHEN n > 0 AND sn > 0 THEN list_inner_product(v, sv) / n / sn ELSE 0.0 END), 6) AS semantic_score
FROM cand, seeds GROUP BY id, ord
HAVING avg(CASE WHEN n > 0 AND sn > 0 THEN list_inner_product(v, sv) / n / sn ELSE 0.0 END) >= {S2_T}"""))
def q_seed_relevance_pairwise(spark, sf):
    # Same operator as seed_relevance; the oracle is the all-pairs mean.
    return q_seed_relevance(spark, sf)


@register("apply_decisions", _w(f"""
WITH {SEL_SQL}
SELECT id, ord, status FROM decided"""))
def q_apply_decisions(spark, sf):
    return J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf)).select("id", "ord", "status")


@register("status_filter", _w(f"""
WITH {SEL_SQL}
SELECT id, ord, status FROM decided WHERE status IN ('not included', 'excluded')"""))
def q_status_filter(spark, sf):
    d = J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf))
    return filters.by_status(d, "not included", "excluded").select("id", "ord", "status")


@tables.memo
def citations_of_selected(spark, sf) -> DataFrame:
    return J.expand_citations(selected(spark, sf), tables.citations(spark, sf), tables.papers(spark, sf))


CITES_SQL = f"""{SEL_SQL}, {O.CITATIONS_CTE},
hits AS (SELECT DISTINCT citing_ord FROM citations WHERE cited_ord IN (SELECT ord FROM sel)),
cites AS (SELECT * EXCLUDE (query_name, type, status), 'citation' AS query_name, 'citation' AS type, 'unknown' AS status
          FROM papers WHERE ord IN (SELECT citing_ord FROM hits)
            AND nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1)"""


@register("citation_expansion", _w(f"""
WITH {CITES_SQL}
SELECT {OUT_SQL} FROM cites"""))
def q_citation_expansion(spark, sf):
    return citations_of_selected(spark, sf).select(*OUT)


UNDECIDED_KEY = "nullif(lower(trim(doi)), '')"


@register("undecided", _w(f"""
WITH {CITES_SQL},
cand AS (SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord), {UNDECIDED_KEY} AS k FROM (
         SELECT 0 AS src, id, ord, doi, database, query_name, title FROM papers
         UNION ALL SELECT 1, id, ord, doi, database, query_name, title FROM cites)),
kept AS (SELECT * FROM cand WHERE k IS NULL OR k NOT IN
          (SELECT {UNDECIDED_KEY} FROM sel WHERE {UNDECIDED_KEY} IS NOT NULL UNION SELECT {UNDECIDED_KEY} FROM rem WHERE {UNDECIDED_KEY} IS NOT NULL))
{O.keep_first('kept', 'k', 'all').replace('SELECT *', 'SELECT ' + OUT_SQL)}"""))
def q_undecided(spark, sf):
    return J.undecided(tables.papers(spark, sf).select(*OUT), selected(spark, sf), citations_of_selected(spark, sf).select(*OUT),
                       removed(spark, sf), mode="clean").select(*OUT)


@register("undecided_parity", _w(f"""
WITH {CITES_SQL},
u AS (SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord) FROM (
      SELECT 0 AS src, id, ord, doi, database, query_name, title FROM papers
      UNION ALL SELECT 1, id, ord, doi, database, query_name, title FROM sel
      UNION ALL SELECT 2, id, ord, doi, database, query_name, title FROM cites
      UNION ALL SELECT 3, id, ord, doi, database, query_name, title FROM rem))
SELECT {OUT_SQL} FROM u QUALIFY count(*) OVER (PARTITION BY coalesce(doi, chr(0) || 'null')) = 1"""))
def q_undecided_parity(spark, sf):
    return J.undecided(tables.papers(spark, sf).select(*OUT), selected(spark, sf).select(*OUT),
                       citations_of_selected(spark, sf).select(*OUT), removed(spark, sf).select(*OUT),
                       mode="parity").select(*OUT)


@register("singletons", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers QUALIFY count(*) OVER (PARTITION BY lower(doi)) = 1"""))
def q_singletons(spark, sf):
    return dedup.singletons(tables.papers(spark, sf), F.lower(F.col("doi"))).select(*OUT)


@register("review_dedup", _w(f"""
WITH {O.PAPERS_CTE},
r1 AS ({O.keep_first('papers', 'lower(title)')}),
r2 AS ({O.keep_first('r1', "replace(lower(abstract), ' ', '')")})
SELECT {OUT_SQL} FROM r2"""))
def q_review_dedup(spark, sf):
    return dedup.review_dedup(tables.papers(spark, sf)).select(*OUT)


@register("review_progress", _w(f"""
WITH {SEL_SQL}
SELECT count(*) AS total, CAST(count_if(status = 'unknown') AS BIGINT) AS unknown,
       CAST(count_if(status = 'included') AS BIGINT) AS included,
       CAST(count_if(status IN ('not included', 'excluded')) AS BIGINT) AS excluded,
       CASE WHEN count(*) > 0 THEN round((count(*) - count_if(status = 'unknown')) / count(*) * 100, 2) ELSE 0.0 END AS progress
FROM decided"""))
def q_review_progress(spark, sf):
    return R.review_progress(J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf)))


@register("review_progress_by_source", _w(f"""
WITH {SEL_SQL}
SELECT database, count(*) AS total, CAST(count_if(status = 'unknown') AS BIGINT) AS unknown,
       CAST(count_if(status = 'included') AS BIGINT) AS included,
       CAST(count_if(status IN ('not included', 'excluded')) AS BIGINT) AS excluded,
       CASE WHEN count(*) > 0 THEN round((count(*) - count_if(status = 'unknown')) / count(*) * 100, 2) ELSE 0.0 END AS progress
FROM decided GROUP BY database"""))
def q_review_progress_by_source(spark, sf):
    return R.review_progress(J.apply_decisions(tables.papers(spark, sf), tables.decisions(spark, sf)), ["database"])


@register("volume_profile", _w(f"""
WITH {O.PAPERS_CTE},
y AS (SELECT query_name, database, year(publication_date) AS year, count(*) AS n_year FROM papers GROUP BY ALL)
SELECT query_name, database, CAST(sum(n_year) AS BIGINT) AS total, count(*) AS n_years,
       CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, CAST(ceil(sum(n_year) / 25) AS BIGINT) AS pages
FROM y GROUP BY query_name, database"""))
def q_volume_profile(spark, sf):
    return A.volume_profile(tables.papers(spark, sf), 25)


@register("volume_by_year", _w(f"""
WITH {O.PAPERS_CTE},
y AS (SELECT query_name, database, year(publication_date) AS year, count(*) AS n FROM papers WHERE publication_date IS NOT NULL GROUP BY ALL),
r AS (SELECT query_name, database, unnest(s) AS year FROM
      (SELECT query_name, database, generate_series(min(year), max(year)) AS s FROM y GROUP BY query_name, database))
SELECT query_name, database, CAST(r.year AS INTEGER) AS year, coalesce(n, 0) AS n_records FROM r LEFT JOIN y USING (query_name, database, year)"""))
def q_volume_by_year(spark, sf):
    """E4, year rows: with the years that have no record."""
    return A.volume_by_year(tables.papers(spark, sf))


@register("stage_counts", _w(f"""
WITH {O.PAPERS_CTE}, {O.cascade('papers', 'all')}
SELECT 'raw' AS stage, count(*) AS n_rows FROM papers
UNION ALL SELECT 'with_text', count(*) FROM papers WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
UNION ALL SELECT 'deduplicated', count(*) FROM c4"""))
def q_stage_counts(spark, sf):
    p = tables.papers(spark, sf)
    return A.stage_counts({"raw": p, "with_text": filters.require_text(p), "deduplicated": dedup.remove_repeated(p)})


@register("sort_records", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL}, CAST(publication_date AS VARCHAR) AS publication_date FROM papers ORDER BY publication_date DESC, ord"""))
def q_sort_records(spark, sf):
    return G.sort_records(tables.papers(spark, sf), ["publication_date"], True).select(
        *OUT, F.col("publication_date").cast("string").alias("publication_date"))


@register("page", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers ORDER BY ord LIMIT 50 OFFSET 100"""))
def q_page(spark, sf):
    return G.page(tables.papers(spark, sf), ["ord"], 100, 50).select(*OUT)


@register("cap_per_group", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers QUALIFY row_number() OVER (PARTITION BY database ORDER BY publication_date DESC, ord) <= 5"""))
def q_cap_per_group(spark, sf):
    return G.cap_per_group(tables.papers(spark, sf), ["database"],
                           [F.col("publication_date").desc(), F.col("ord")], 5).select(*OUT)


@register("review_batch", _w(f"""
WITH {O.PAPERS_CTE},
r1 AS ({O.keep_first('papers', 'lower(title)')}),
r2 AS ({O.keep_first('r1', "replace(lower(abstract), ' ', '')")})
SELECT {OUT_SQL} FROM r2 WHERE status = 'unknown' ORDER BY md5(CAST(ord AS VARCHAR) || ':7'), ord LIMIT 20"""))
def q_review_batch(spark, sf):
    return R.review_batch(tables.papers(spark, sf), 20, seed=7).select(*OUT)


@register("review_round", _w(f"""
WITH {O.PAPERS_CTE}, {O.DECISIONS_CTE}, {O.LAST_CTE},
r1 AS ({O.keep_first('papers', 'lower(title)')}),
r2 AS ({O.keep_first('r1', "replace(lower(abstract), ' ', '')")}),
d AS (SELECT r2.* EXCLUDE (status), coalesce(l.status, r2.status) AS status FROM r2 LEFT JOIN last_a l USING (id))
SELECT row_number() OVER (ORDER BY ord) AS id, ord, doi, title, 'unknown' AS status FROM d WHERE status = 'included'"""))
def q_review_round(spark, sf):
    inc, _removed, _upd = R.review_round(tables.papers(spark, sf), tables.decisions(spark, sf), "abstract")
    return inc.select("id", "ord", "doi", "title", "status")


@register("review_round_full_text", _w(f"""
WITH {O.PAPERS_CTE}, {O.DECISIONS_CTE}, {O.LAST_CTE},
r1 AS ({O.keep_first('papers', 'lower(title)')}),
r2 AS ({O.keep_first('r1', "replace(lower(abstract), ' ', '')")})
SELECT r2.id, ord, l.status FROM r2 JOIN last_f l USING (id) WHERE l.status IN ('not included', 'excluded')"""))
def q_review_round_full_text(spark, sf):
    """R2, full-text round: what its own decisions exclude."""
    _inc, out, _upd = R.review_round(tables.papers(spark, sf), tables.decisions(spark, sf), "full_text")
    return out.select("id", "ord", "status")


@register("dense_id", _w(f"""
WITH {O.PAPERS_CTE}
SELECT row_number() OVER (ORDER BY ord) AS id, ord FROM papers WHERE nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL"""))
def q_dense_id(spark, sf):
    p = filters.require_text(tables.papers(spark, sf)).drop("id")
    return G.with_dense_id(p).select("id", "ord")


@register("union_aligned", _w(f"""
WITH {CITES_SQL}
SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord) FROM (
  SELECT 0 AS src, id, ord, doi, database, query_name, title, NULL AS url FROM papers
  UNION ALL SELECT 1, id, ord, doi, database, query_name, title, url FROM cites)"""))
def q_union_aligned(spark, sf):
    p = tables.papers(spark, sf).select(*OUT)
    c = citations_of_selected(spark, sf).select(*OUT, "url")
    return A.union_aligned(p, c).select(*OUT, "url")


# --- composed steps -------------------------------------------------------------------

E2E_FROM, E2E_TO = "2016-01-01", "2024-12-31"


def _stages(spark, sf, store=None) -> dict[str, DataFrame]:
    return M.survey_stages(tables.papers(spark, sf), tables.decisions(spark, sf), tables.citations(spark, sf),
                           tables.all_vectors(spark, sf), E2E_FROM, E2E_TO, TITLE_TERMS, ABSTRACT_WORDS, S2_T, store=store)


_TT = "|".join(T.regex_escape(t) for t in TITLE_TERMS)
_REC = "record_id, ord, doi, title, database, query_name, abstract"
_K = "nullif(lower(trim(doi)), '')"


def _rounds_sql(src: str, p: str) -> str:
    """Both review rounds over ``src``: {p}_inc included, {p}_rem removed."""
    return f"""{p}1 AS ({O.keep_first(src, 'lower(title)')}),
{p}2 AS ({O.keep_first(p + '1', "replace(lower(abstract), ' ', '')")}),
{p}_a AS (SELECT t.*, l.status AS s FROM {p}2 t LEFT JOIN last_a l ON l.id = t.record_id),
{p}_f AS (SELECT t.* EXCLUDE (s), l.status AS s FROM {p}_a t LEFT JOIN last_f l ON l.id = t.record_id WHERE t.s = 'included'),
{p}_inc AS (SELECT {_REC} FROM {p}_f WHERE s = 'included'),
{p}_rem AS (SELECT {_REC} FROM {p}_a WHERE s IN ('not included', 'excluded') UNION ALL SELECT {_REC} FROM {p}_f WHERE s IN ('not included', 'excluded'))"""


SURVEY_SQL = f"""{O.PAPERS_CTE}, {O.DECISIONS_CTE}, {O.LAST_CTE}, {O.CITATIONS_CTE}, {O.ALL_VECS_CTE},
base AS (SELECT * FROM papers WHERE publication_date BETWEEN DATE '{E2E_FROM}' AND DATE '{E2E_TO}'),
{O.cascade('base', 'all')},
cl AS (SELECT *, id AS record_id FROM c4 WHERE NOT regexp_matches(lower(title), '{_TT}')
        AND NOT regexp_matches(lower(abstract), '{_re2_words(ABSTRACT_WORDS)}')
        AND {L.detect_language_sql('abstract')} = 'en'),
{_rounds_sql('cl', 'r')},
open_ AS (SELECT * FROM cl WHERE ord NOT IN (SELECT ord FROM r_inc) AND ord NOT IN (SELECT ord FROM r_rem)),
hits AS (SELECT DISTINCT citing_ord FROM citations WHERE cited_ord IN (SELECT ord FROM r_inc)),
cites AS (SELECT id AS record_id, ord, doi, title, database, 'citation' AS query_name, abstract
          FROM papers WHERE ord IN (SELECT citing_ord FROM hits)
            AND nullif(title, '') IS NOT NULL AND nullif(abstract, '') IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1),
cand AS (SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord), {_K} AS k
         FROM (SELECT 0 AS src, {_REC} FROM open_ UNION ALL SELECT 1, {_REC} FROM cites)),
und AS (SELECT * FROM cand WHERE k IS NULL OR k NOT IN
          (SELECT {_K} FROM r_inc WHERE {_K} IS NOT NULL UNION SELECT {_K} FROM r_rem WHERE {_K} IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY k, CASE WHEN k IS NULL THEN ord END ORDER BY ord) = 1),
{O.centroid_cte('cen', 'allvecs WHERE id IN (SELECT record_id FROM r_inc)')},
snow AS (SELECT {_REC} FROM und JOIN allvecs ON allvecs.id = und.record_id, cen WHERE {O.cos_to('cen', False)} >= {S2_T}),
{_rounds_sql('snow', 's')},
un AS (SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord)
       FROM (SELECT 0 AS src, {_REC} FROM r_inc UNION ALL SELECT 1, {_REC} FROM s_inc)),
f1 AS ({O.keep_first('un', 'lower(title)')}),
f2 AS ({O.keep_first('f1', 'lower(doi)', 'all')}),
{O.cascade('f2', 'all', 'g')},
fin AS (SELECT row_number() OVER (ORDER BY ord) AS id, ord, doi, title, database, query_name FROM g4)"""


@register("snowball", _w(f"""
WITH {SURVEY_SQL}
SELECT row_number() OVER (ORDER BY ord) AS id, record_id, ord, doi, title, database, query_name FROM snow"""))
def q_snowball(spark, sf):
    return G.with_dense_id(_stages(spark, sf)["snowball"]).select("id", "record_id", "ord", "doi", "title", "database", "query_name")


@register("merge_final", _w(f"""
WITH {CITES_SQL},
un AS (SELECT row_number() OVER (ORDER BY src, ord) AS ord, * EXCLUDE (src, ord)
       FROM (SELECT 0 AS src, ord, doi, title, database, query_name, abstract FROM sel
             UNION ALL SELECT 1, ord, doi, title, database, query_name, abstract FROM cites)),
f1 AS ({O.keep_first('un', 'lower(title)')}),
f2 AS ({O.keep_first('f1', 'lower(doi)', 'all')}),
{O.cascade('f2', 'all', 'g')}
SELECT row_number() OVER (ORDER BY ord) AS id, ord, doi, title, database, query_name FROM g4"""))
def q_merge_final(spark, sf):
    """M4 on two sets: the included records and the records that cite them."""
    return M.merge_final(selected(spark, sf), citations_of_selected(spark, sf)).select("id", "ord", "doi", "title", "database", "query_name")


@register("survey_end_to_end", _w(f"""
WITH {SURVEY_SQL}
SELECT id, ord, doi, title, database, query_name FROM fin"""))
def q_survey_end_to_end(spark, sf):
    return _stages(spark, sf)["final"].select("id", "ord", "doi", "title", "database", "query_name")


@register("survey_resumed", _w(f"""
WITH {SURVEY_SQL}
SELECT id, ord, doi, title, database, query_name FROM fin"""))
def q_survey_resumed(spark, sf):
    """A9 on M6: a second run over the stages of a first one, none of which it builds again."""
    root = run_folder(spark, "survey")
    for _ in range(2):
        store = stages.StageStore(spark, root)
        found = _stages(spark, sf, store)["final"]
    if any(built for _, built in store.log):
        raise RuntimeError(f"stages built again: {store.log}")
    return found.select("id", "ord", "doi", "title", "database", "query_name")


@register("stage_rows", _w(f"""
WITH {SURVEY_SQL}
SELECT 'cleaned' AS stage, count(*) AS n_rows FROM cl UNION ALL SELECT 'snowball', count(*) FROM snow"""))
def q_stage_rows(spark, sf):
    """Rows of the survey's stages, observed while they were written."""
    store = stages.StageStore(spark, run_folder(spark, "survey"))
    _stages(spark, sf, store)
    return store.counts().filter(F.col("stage").isin("cleaned", "snowball"))


# --- ingestion of landed payloads -------------------------------------------------------

from ..sources import landed_fixture as X  # noqa: E402
from ..sources import payloads as P        # noqa: E402

ING_OUT = ["ord", "database", "doi", "title", "abstract", "publication_date", "query_name", "query_value",
           "url", "publication", "publisher"]


def _ing_cols(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c == "title" else
                       F.col(c).cast("string").alias(c) if c == "publication_date" else F.col(c) for c in ING_OUT])


@tables.memo
def landed(spark, sf) -> DataFrame:
    return X.landed_payloads(tables.papers(spark, sf))


@register("ingest_records", _w(f"""
WITH {O.PAPERS_CTE}, {O.INGEST_CTE}
SELECT ord, database, doi, nullif(title, '') AS title, abstract, CAST(publication_date AS VARCHAR) AS publication_date,
       query_name, query_value, url, publication, publisher FROM ingested"""))
def q_ingest_records(spark, sf):
    return _ing_cols(M.ingest(landed(spark, sf)))


# What the test responses call an article in three of the sources.
DOC_TYPES = ["Journals", "Article"]


@register("source_constraints", _w(f"""
WITH {O.PAPERS_CTE}, {O.INGEST_CTE}
SELECT i.ord, i.database, i.doi, i.title FROM ingested i JOIN papers p ON p.ord = i.doc
WHERE i.database IN ('ieeexplore', 'springer', 'scopus')
  AND NOT regexp_matches(lower(i.title), '{"|".join(T.regex_escape(t) for t in TITLE_TERMS)}')
  AND NOT regexp_matches(lower(i.abstract), '{_re2_words(ABSTRACT_WORDS)}') AND i.title <> ''"""))
def q_source_constraints(spark, sf):
    """C10 on the document types that the sources deliver, with C1-C3."""
    p = filters.filter_doc_types(M.ingest(landed(spark, sf)), DOC_TYPES)
    p = filters.exclude_abstract_words(filters.exclude_title_terms(filters.require_text(p), TITLE_TERMS), ABSTRACT_WORDS)
    return p.select("ord", "database", "doi", "title")


@register("payload_totals", _w(f"""
WITH {O.PAPERS_CTE}
SELECT database || ':' || query_name || ':' || CAST(ord // 150 AS VARCHAR) AS request_id,
       count(*) + CASE WHEN (ord // 150) % 3 = 1 THEN 2 ELSE 0 END AS total
FROM papers GROUP BY database, query_name, ord // 150"""))
def q_payload_totals(spark, sf):
    return P.payload_totals(landed(spark, sf)).select("request_id", "total")


@register("preprocess", _w(f"""
WITH {O.PAPERS_CTE}, {O.INGEST_CTE},
base AS (SELECT * FROM ingested WHERE publication_date BETWEEN DATE '{E2E_FROM}' AND DATE '{E2E_TO}'),
{O.cascade('base', 'all')}
SELECT row_number() OVER (ORDER BY ord) AS id, ord, database, doi, title FROM c4
WHERE NOT regexp_matches(lower(title), '{"|".join(T.regex_escape(t) for t in TITLE_TERMS)}')
  AND NOT regexp_matches(lower(abstract), '{_re2_words(ABSTRACT_WORDS)}')
  AND {L.detect_language_sql('abstract')} = 'en'"""))
def q_preprocess(spark, sf):
    return M.preprocess(landed(spark, sf), E2E_FROM, E2E_TO, TITLE_TERMS, ABSTRACT_WORDS).select(
        "id", "ord", "database", "doi", "title")


# --- streaming ----------------------------------------------------------------------

from ..streaming import incremental as K   # noqa: E402


def _docs_stream(spark, sf):
    schema = tables.table(spark, sf, "documents").schema
    return K.table_stream(spark, sf, "documents", schema)


@register("incremental_landing", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers"""))
def q_incremental_landing(spark, sf):
    root = K.run_folder(spark, "landing")
    stream = tables.papers_from(_docs_stream(spark, sf)).select(*OUT)
    K.land_incrementally(stream, os.path.join(root, "table"), os.path.join(root, "_checkpoint"))
    return K.read_landed(spark, os.path.join(root, "table")).select(*OUT)


@register("stream_dedup", _w(f"""
WITH {O.PAPERS_CTE}
SELECT DISTINCT lower(doi) AS doi_key FROM papers WHERE doi IS NOT NULL
UNION ALL SELECT NULL FROM papers WHERE doi IS NULL"""))
def q_stream_dedup(spark, sf):
    root = K.run_folder(spark, "dedup")
    s = tables.papers_from(_docs_stream(spark, sf)).withColumn(
        "event_time", F.col("publication_date").cast("timestamp"))
    out = K.stream_dedup(s, F.lower(F.col("doi")), "event_time", "3650 days").select(F.lower(F.col("doi")).alias("doi_key"))
    K.run_append(out, os.path.join(root, "table"), os.path.join(root, "_checkpoint"))
    return spark.read.parquet(os.path.join(root, "table"))


CASCADE_SQL = _w(f"""
WITH {O.PAPERS_CTE},
{O.cascade('papers', 'all')}
SELECT {OUT_SQL} FROM c4""")


@register("incremental_dedup", CASCADE_SQL)
def q_incremental_dedup(spark, sf):
    """F5 in three batches, the last records first: the survivors of one batch."""
    p = tables.papers(spark, sf)
    state = ID.IncrementalCascade(spark, K.run_folder(spark, "cascade"))
    for i, lang in enumerate(("lang IN ('fr', 'es')", "lang = 'de'", "lang IS NULL OR lang NOT IN ('fr', 'es', 'de')")):
        state.merge(p.filter(lang), i)
    return state.select(p).select(*OUT)


@register("stream_cascade", CASCADE_SQL)
def q_stream_cascade(spark, sf):
    """K2 with the whole cascade, over a stream in several micro-batches."""
    root = K.run_folder(spark, "cascade")
    docs = tables.table(spark, sf, "documents")
    n = 3 * -(-docs.rdd.getNumPartitions() // 3)   # files as many as the table's splits, three micro-batches
    docs.repartition(n, "doc_id").write.parquet(os.path.join(root, "landed"))
    stream = K.file_stream(spark, os.path.join(root, "landed"), "*.parquet", docs.schema, max_files=n // 3)
    state = K.stream_cascade(tables.papers_from(stream), os.path.join(root, "state"), os.path.join(root, "_checkpoint"))
    return state.select(tables.papers(spark, sf)).select(*OUT)


@register("decision_status_stream", _w(f"""
WITH {O.DECISIONS_CTE}
SELECT id, arg_max(status, ts) AS status, CAST(max(ts) AS VARCHAR) AS ts FROM decisions GROUP BY id"""))
def q_decision_status_stream(spark, sf):
    root = K.run_folder(spark, "decisions")
    schema = tables.table(spark, sf, "labels").schema
    labels = K.table_stream(spark, sf, "labels", schema)
    decisions = tables.decisions_from(labels)
    K.run_updates(K.decision_status_stream(decisions), os.path.join(root, "table"), os.path.join(root, "_checkpoint"))
    out = K.current_status(spark, os.path.join(root, "table"))
    return out.select("id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# --- HTML, JSON lookups, enrichment ------------------------------------------------------

from ..functions import html as H          # noqa: E402


_HTML_SEEN = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
_HTML_TEXT = f"regexp_replace(regexp_extract({_HTML_SEEN}, '(?is)<article\\b.*?</article', 0) || '>', '<[^>]*>', ' ', 'g')"
for _e, _c in H.ENTITIES:
    _HTML_TEXT = f"replace({_HTML_TEXT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@register("html_section_text", _w(f"""
SELECT page_id, length(t) AS n_chars, t AS section_text
FROM (SELECT page_id, trim(regexp_replace({_HTML_TEXT}, '\\s+', ' ', 'g')) AS t FROM pages) x"""))
def q_html_section_text(spark, sf):
    pages = tables.table(spark, sf, "pages")
    return (pages.select("page_id", H.section_text("html", "article").alias("section_text"))
            .select("page_id", F.length("section_text").cast("long").alias("n_chars"), "section_text"))


_FIRST = "trim(regexp_replace(split_part(text, '.', 1), '[^A-Za-z]+', ' '{}))"


@register("html_nested_sections", _w(f"""
SELECT doc_id, trim(regexp_replace({_FIRST.format(", 'g'")} || ' (' || coalesce(lang, '') || ' ' || chr(233) || '&' || chr(8217) || ') end', ' +', ' ', 'g')) AS section_text FROM documents"""))
def q_html_nested_sections(spark, sf):
    """I12 on pages with nested sections of one name, attributes that hold tags, and numeric entities, one made of each document."""
    d = tables.table(spark, sf, "documents").filter("text IS NOT NULL")
    page = F.concat(F.lit("<script>'<div class=main>'</script><div class='side' title='</div>>'>no<div>no</div></div><div data-a=\"a > b </div>\" class='row main'>"
                          "<p title='1 > 2'>"), F.expr(_FIRST.format("")), F.lit("</p><div>("), F.coalesce("lang", F.lit("")),
                    F.lit(" &#233;&amp;&#x2019;)</div><!-- </div> -->end</div><div class='main'>later</div>"))
    return d.select("doc_id", H.section_text(page, "div", {"class": "main"}).alias("section_text"))


@register("json_abstract", _w(f"""
WITH {O.PAPERS_CTE},
lk AS (SELECT doi, ord % 4 AS shape, abstract FROM papers WHERE doi IS NOT NULL)
SELECT doi, nullif(abstract, '') AS abstract FROM lk"""))
def q_json_abstract(spark, sf):
    lk = X.abstract_lookups(tables.papers(spark, sf))
    return lk.select(F.col("key").alias("doi"), P.json_abstract("body").alias("abstract"))


@register("enrich_abstract", _w(f"""
WITH {O.PAPERS_CTE},
lk AS (SELECT doi, first(nullif(abstract, '') ORDER BY ord) FILTER (WHERE nullif(abstract, '') IS NOT NULL) AS a
       FROM papers WHERE doi IS NOT NULL AND ord IN (SELECT doc_id FROM labels) GROUP BY doi),
pg AS (SELECT 'https://records.example.org/' || CAST(page_id AS VARCHAR) AS url, url AS page_url FROM pages)
SELECT p.ord, p.doi, coalesce(lk.a, pg.page_url, '') AS abstract
FROM papers p LEFT JOIN lk USING (doi) LEFT JOIN pg ON pg.url = p.url"""))
def q_enrich_abstract(spark, sf):
    # Records arrive without abstracts; the first lookup (retrieval responses by
    # DOI -- there is one for every labelled record) fills what it can, the
    # second (page URL by record URL) the rest, otherwise ''.
    p = tables.papers(spark, sf)
    bare = p.select("ord", "doi", "url", F.lit(None).cast("string").alias("abstract"))
    labelled = p.join(tables.table(spark, sf, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    lk = X.abstract_lookups(labelled).select(F.col("key").alias("doi"), "ord", P.json_abstract("body").alias("a"))
    pages = tables.table(spark, sf, "pages").select(
        F.concat(F.lit("https://records.example.org/"), F.col("page_id").cast("string")).alias("url"),
        F.col("url").alias("page_url"))
    return J.enrich_abstract(bare, [(lk, "doi", "a", "ord"), (pages, "url", "page_url")]).select("ord", "doi", "abstract")


# --- scalar functions, files, volume guard, encoder ----------------------------------

@register("text_functions", _w(f"""
WITH {O.PAPERS_CTE}
SELECT ord,
  lower(title) AS title_lower,
  nullif(title, '') AS title_or_null,
  {O.norm_search('abstract')} AS abstract_search,
  {O.norm_dedup('abstract')} AS abstract_dedup,
  replace(lower(abstract), ' ', '') AS abstract_review,
  split_part(CAST(CAST(year(publication_date) AS DOUBLE) AS VARCHAR), '.', 1) AS year_text,
  replace(replace(query_value, '<AND>', 'AND'), '<OR>', 'OR') AS query_words,
  CASE WHEN contains(doi, 'http') THEN 'URL:' || doi ELSE 'DOI:' || doi END AS prefixed_id,
  CAST(ceil(length(abstract) / 1000) AS BIGINT) AS n_pages, ord % 25 AS page_slot,
  round(length(abstract) / 7.0, 2) AS chars_per_7,
  title || '[SEP]' || abstract AS model_text,
  coalesce(nullif(trim(doi), ''), nullif(trim(url), '')) AS any_id,
  coalesce(nullif(CASE WHEN ord % 2 = 0 THEN '2-s2.0-' || ord END, ''),
           nullif(regexp_extract('SCOPUS_ID:' || ord, 'SCOPUS_ID:(.*)$', 1), ''), '') AS scopus_id
FROM papers"""))
def q_text_functions(spark, sf):
    p = tables.papers(spark, sf)
    eid = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("2-s2.0-"), F.col("ord").cast("string")))
    p = p.withColumns({"eid": eid, "dc:identifier": F.concat(F.lit("SCOPUS_ID:"), F.col("ord").cast("string"))})
    return p.select(
        "ord",
        F.lower("title").alias("title_lower"),
        T.blank_to_null("title").alias("title_or_null"),
        T.norm_search("abstract").alias("abstract_search"),
        T.norm_dedup("abstract").alias("abstract_dedup"),
        T.norm_review("abstract").alias("abstract_review"),
        T.year_text(F.year("publication_date").cast("double")).alias("year_text"),
        T.query_operators_to_words("query_value").alias("query_words"),
        T.prefixed_id("doi").alias("prefixed_id"),
        F.ceil(F.length("abstract") / 1000).cast("long").alias("n_pages"),
        (F.col("ord") % 25).alias("page_slot"),
        F.round(F.length("abstract") / 7.0, 2).alias("chars_per_7"),
        P.model_text().alias("model_text"),
        P.coalesce_id("doi", "url").alias("any_id"),
        P.scopus_id().alias("scopus_id"),
    )


@register("tokenize", _w(f"""
SELECT doc_id, array_to_string(list_filter(string_split_regex(
         translate(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '{T.ACCENTED}', '{T.UNACCENTED}'), '[^\\p{{L}}]+'),
         lambda t: length(t) BETWEEN 2 AND 15), ' ') AS tokens
FROM documents"""))
def q_tokenize(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


@register("lemmatize", _w(f"""
WITH {O.PAPERS_CTE}
SELECT ord, array_to_string(list_transform(string_split({O.norm_search('abstract')}, ' '),
                                           lambda t: {T.lemma_token_sql('t')}), ' ') AS lemmas
FROM papers"""))
def q_lemmatize(spark, sf):
    return tables.papers(spark, sf).select("ord", T.lemmatize_words(T.norm_search("abstract")).alias("lemmas"))


@register("cosine_pairs", _w("""
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b,
       round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
             / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""))
def q_cosine_pairs(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("ea"))
    b = e.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    j = a.join(b, F.col("vec_b") == F.col("vec_a") + 1)
    return j.select("vec_a", "vec_b", F.round(S.cosine("ea", "eb"), 6).alias("cosine"))


@register("csv_roundtrip", _w(f"""
WITH {O.PAPERS_CTE}
SELECT id, ord, doi, database, query_name, nullif(title, '') AS title, nullif(abstract, '') AS abstract FROM papers"""))
def q_csv_roundtrip(spark, sf):
    from ..schema import PAPER_SCHEMA
    from ..sources.stages import write_stage
    path = K.run_folder(spark, "csv")
    write_stage(tables.papers(spark, sf).drop("lang"), path, fmt="csv")
    back = P.read_papers_csv(spark, path, PAPER_SCHEMA, on_bad="fail", multiline=True)   # abstracts hold line ends
    return back.select(*OUT, "abstract")


@register("csv_bad_rows", _w(f"""
WITH {O.PAPERS_CTE}
SELECT CASE WHEN ord % 7 = 3 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords FROM papers GROUP BY 1"""))
def q_csv_bad_rows(spark, sf):
    """A file whose rows have texts for dates and numbers here and there: such rows are kept apart, with their line, and counted."""
    root = K.run_folder(spark, "csv")
    p = tables.papers(spark, sf)
    odd = F.col("ord") % 7 == 3
    rows = p.select("ord", F.when(odd & (F.col("ord") % 2 == 0), "n/a").otherwise(F.col("publication_date").cast("string")).alias("publication_date"),
                    F.when(odd & (F.col("ord") % 2 == 1), "1.x").otherwise(F.lit("0.5")).alias("semantic_score"), "title")
    rows.write.option("header", True).option("escape", '"').csv(os.path.join(root, "in"))
    schema = T_.StructType.fromDDL("ord long, publication_date date, semantic_score double, title string")
    good, bad = P.quarantined(P.read_papers_csv(spark, os.path.join(root, "in"), schema, on_bad="quarantine", multiline=True), os.path.join(root, "table"))
    ords = F.split_part("_corrupt_record", F.lit(","), F.lit(1)).cast("long")
    return (good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("ord").alias("ords"))
            .unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.sum(ords).alias("ords"))))


@register("raw_partition_scan", _w(f"""
WITH {O.PAPERS_CTE}
SELECT database AS source, query_name, count(DISTINCT ord // 150) AS n_requests
FROM papers WHERE query_name IN ('q0', 'q1') AND database IN ('arxiv', 'springer', 'core')
GROUP BY ALL"""))
def q_raw_partition_scan(spark, sf):
    root = K.run_folder(spark, "landed")
    P.land_payloads(landed(spark, sf), root)
    raw = P.load_raw(spark, root, ["q0", "q1"], ["arxiv", "springer", "core"])
    return raw.groupBy("source", "query_name").agg(F.count(F.lit(1)).alias("n_requests"))


@register("text_encoder_relevance", None)
def q_text_encoder_relevance(spark, sf):
    """S3: hashing encoder on whole texts; documents scored against the
    centroid of the encoded ``benchmark`` passages."""
    bench = S.hashing_encoder(tables.table(spark, sf, "benchmark"), "text")
    docs = S.hashing_encoder(tables.table(spark, sf, "documents"), "text")
    rel = S.relevance_to_seeds(docs.withColumnRenamed("doc_id", "ord"), bench, 0.3)
    return rel.select("ord", F.round("semantic_score", 6).alias("semantic_score"))


@register("drop_all_null_columns", _w(f"""
WITH {O.PAPERS_CTE}
SELECT database, doi, title, url, abstract, publication, publisher, CAST(publication_date AS VARCHAR) AS publication_date, query_name FROM
(SELECT database, doi, nullif(title, '') AS title, url, abstract, publication, publisher, publication_date, query_name FROM papers
 WHERE database = 'ieeexplore')"""))
def q_drop_all_null_columns(spark, sf):
    """Of a source's unified columns, `semantic_score` and `note` hold nothing and go."""
    rows = P.normalise(P.raw_rows(landed(spark, sf), "ieeexplore"), "ieeexplore", dedup=False)
    rows = rows.withColumns({"semantic_score": F.lit(None).cast("double"), "note": F.lit(""), "title": F.nullif("title", F.lit("")),
                             "publication_date": F.col("publication_date").cast("string")})
    return P.drop_all_null_columns(rows.drop("type", "query_value", "page", "pos"))


# --- remaining inventory: page audit, citation payloads, final de-dup, per-source steps -------------

@register("audit_pages", _w(f"""
WITH {O.PAPERS_CTE}
SELECT database || ':' || query_name || ':' || CAST(ord // 150 AS VARCHAR) AS request_id, count(*) + 2 AS expected, count(*) AS received
FROM papers WHERE (ord // 150) % 3 = 1 GROUP BY database, query_name, ord // 150"""))
def q_audit_pages(spark, sf):
    """Responses whose parsed records fall short of the announced total."""
    pl = landed(spark, sf)
    got = None
    for n in P.sources():
        r = P.raw_rows(pl, n).select("request_id")
        got = r if got is None else got.unionByName(r)
    return A.audit_pages(P.payload_totals(pl), got).select("request_id", "expected", "received")


@register("flatten_citations", _w(f"""
WITH {O.PAPERS_CTE}, {O.CITATIONS_CTE}
SELECT c.cited_ord, coalesce(p.doi, 'p' || CAST(p.ord AS VARCHAR)) AS doi, p.title, p.abstract, p.url,
       p.publisher, CAST(make_date(year(p.publication_date), 1, 1) AS VARCHAR) AS publication_date,
       'citation' AS query_name
FROM citations c JOIN papers p ON p.ord = c.citing_ord"""))
def q_flatten_citations(spark, sf):
    flat = P.flatten_citations(X.citation_payloads(tables.citations(spark, sf), tables.papers(spark, sf)))
    return flat.select("cited_ord", "doi", "title", "abstract", "url", "publisher",
                       F.col("publication_date").cast("string").alias("publication_date"), "query_name")


@register("final_dedup", _w(f"""
WITH {O.PAPERS_CTE},
f1 AS ({O.keep_first('papers', 'lower(title)')}),
f2 AS ({O.keep_first('f1', 'lower(doi)', 'all')}),
{O.cascade('f2', 'all', 'g')}
SELECT {OUT_SQL} FROM g4"""))
def q_final_dedup(spark, sf):
    return dedup.final_dedup(tables.papers(spark, sf)).select(*OUT)


@register("source_postprocess", _w(f"""
WITH {O.PAPERS_CTE},
lk AS (SELECT doi, first(abstract ORDER BY ord) AS a FROM papers
       WHERE database = 'scopus' AND ord % 2 = 0 AND doi IS NOT NULL AND nullif(abstract, '') IS NOT NULL GROUP BY doi),
raw AS (SELECT ord, database, query_name, title, lang,
          CASE WHEN database = 'scopus' THEN coalesce(lk.a, nullif(p.abstract, '')) ELSE nullif(p.abstract, '') END AS abstract,
          CASE database WHEN 'core' THEN coalesce(p.doi, 'core:' || ord) WHEN 'semantic_scholar' THEN coalesce(p.doi, 'p' || ord) ELSE p.doi END AS doi,
          CASE WHEN database = 'semantic_scholar' THEN make_date(year(publication_date), 1, 1) ELSE publication_date END AS publication_date
        FROM papers p LEFT JOIN lk ON lk.doi = p.doi),
t1 AS (SELECT * FROM raw WHERE nullif(title, '') IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY database, lower(title) ORDER BY query_name, ord) = 1),
t2 AS (SELECT * FROM t1 WHERE abstract IS NOT NULL
       QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY database, doi ORDER BY query_name, ord) = 1)
SELECT database, doi, title, abstract, CAST(publication_date AS VARCHAR) AS publication_date FROM t2
WHERE (database <> 'springer' OR contains(lang, 'en')) AND publication_date BETWEEN DATE '{E2E_FROM}' AND DATE '{E2E_TO}'"""))
def q_source_postprocess(spark, sf):
    """M5 of all six sources.  Scopus records arrive without abstracts: the
    lookup by DOI knows the even records, the one by SCOPUS_ID all of them."""
    papers = tables.papers(spark, sf)
    scopus = papers.filter(F.col("database") == "scopus")
    by_doi = X.abstract_lookups(scopus.filter(F.col("ord") % 2 == 0)).select(
        F.col("key").alias("doi"), "ord", P.json_abstract("body").alias("a"))
    by_id = X.abstract_lookups(scopus, F.concat(F.lit("2-s2.0-"), F.col("ord").cast("string"))).select(
        F.col("key").alias("scopus_id"), "ord", P.json_abstract("body").alias("a"))
    bare = X.landed_payloads(papers.withColumn("abstract", F.when(F.col("database") != "scopus", F.col("abstract"))))
    out = None
    for name in P.sources():
        lookups = [(by_doi, "doi", "a", "ord"), (by_id, "scopus_id", "a", "ord")] if name == "scopus" else None
        one = M.source_postprocess(bare, name, E2E_FROM, E2E_TO, lookups=lookups).select(
            "database", "doi", "title", "abstract", F.col("publication_date").cast("string").alias("publication_date"))
        out = one if out is None else out.unionByName(one)
    return out


@register("page_after", _w(f"""
WITH {O.PAPERS_CTE}
SELECT {OUT_SQL} FROM papers WHERE ord > 500 ORDER BY ord LIMIT 50"""))
def q_page_after(spark, sf):
    """G3, keyset form: the page after the last key seen (deep pages without offsets)."""
    return G.page_after(tables.papers(spark, sf), "ord", 500, 50).select(*OUT)
