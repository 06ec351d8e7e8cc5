"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the driver's parquet tables registered as views.  The
derived record views of ``curata.sources.tables`` are repeated here as CTEs.
"""

from __future__ import annotations

NL = "chr(10)"

PAPERS_CTE = """papers AS (
SELECT CAST(doc_id + 1 AS BIGINT) AS id,
  CASE WHEN doc_id % 17 = 0 THEN NULL
       WHEN doc_id // 700 % 2 = 0 THEN '10.5555/D' || CAST(doc_id % 700 AS VARCHAR)
       ELSE '10.5555/d' || CAST(doc_id % 700 AS VARCHAR) END AS doi,
  'raw' AS type,
  'q' || CAST(doc_id % 3 AS VARCHAR) AS query_name,
  'term' || CAST(doc_id % 3 AS VARCHAR) || ' <AND> topic' AS query_value,
  source AS publication,
  source AS publisher,
  make_date(CAST(2015 + doc_id % 10 AS INT), CAST(1 + doc_id % 12 AS INT), CAST(1 + doc_id % 28 AS INT)) AS publication_date,
  CASE doc_id % 6 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'springer' WHEN 2 THEN 'ieeexplore'
       WHEN 3 THEN 'scopus' WHEN 4 THEN 'core' ELSE 'semantic_scholar' END AS database,
  CASE WHEN doc_id % 41 = 0 THEN '' ELSE split_part(text, '.', 1) END AS title,
  'https://records.example.org/' || CAST(doc_id AS VARCHAR) AS url,
  CASE WHEN doc_id % 43 = 0 THEN NULL ELSE text END AS abstract,
  'unknown' AS status,
  CAST(NULL AS DOUBLE) AS semantic_score,
  doc_id AS ord,
  lang
FROM documents)"""

CITATIONS_CTE = """citations AS (
SELECT doc_id AS citing_ord, (doc_id * 7 + k * 13 + 1) % (SELECT count(*) FROM documents) AS cited_ord
FROM documents, (SELECT unnest([0, 1, 2]) AS k) ks)"""

DECISIONS_CTE = """decisions AS (
SELECT doc_id + 1 AS id, 'abstract' AS round,
       CASE WHEN quality = 1 THEN 'included' ELSE 'not included' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS DOUBLE)) AS ts
FROM labels
UNION ALL
SELECT doc_id + 1 AS id, 'abstract' AS round, 'not included' AS status,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY + to_seconds(CAST(doc_id AS DOUBLE)) AS ts
FROM labels WHERE toxic = 1
UNION ALL
SELECT doc_id + 1 AS id, 'full_text' AS round, CASE WHEN doc_id % 5 = 0 THEN 'excluded' ELSE 'included' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 2 DAY + to_seconds(CAST(doc_id AS DOUBLE)) AS ts
FROM labels WHERE quality = 1)"""

ALL_VECS_CTE = """allvecs AS (SELECT d.doc_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS v,
                 sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
          FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))"""


def norm_dedup(c: str) -> str:
    return f"translate(lower({c}), '- ' || {NL}, '')"


def norm_search(c: str) -> str:
    return f"lower(translate({c}, '-' || {NL}, '  '))"


def keep_first(src: str, key: str, nulls: str = "one", order: str = "ord") -> str:
    part = key if nulls == "one" else f"{key}, CASE WHEN ({key}) IS NULL THEN {order} END"
    return f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {order}) = 1"


def cascade(src: str, doi_nulls: str = "all", prefix: str = "c") -> str:
    """CTE chain for the F5 cascade over ``src``; the last CTE is ``{prefix}4``."""
    doi = "lower(doi)" if doi_nulls == "one" else "nullif(trim(lower(doi)), '')"
    return (f"{prefix}1 AS ({keep_first(src, doi, doi_nulls)}),\n"
            f"{prefix}2 AS ({keep_first(prefix + '1', norm_dedup('title'))}),\n"
            f"{prefix}3 AS (SELECT * FROM {prefix}2 WHERE nullif(abstract, '') IS NOT NULL AND nullif(title, '') IS NOT NULL),\n"
            f"{prefix}4 AS ({keep_first(prefix + '3', norm_dedup('abstract'))})")

LAST_CTE = """last AS (SELECT id, arg_max(status, ts) AS status FROM decisions GROUP BY id),
last_a AS (SELECT id, arg_max(status, ts) AS status FROM decisions WHERE round = 'abstract' GROUP BY id),
last_f AS (SELECT id, arg_max(status, ts) AS status FROM decisions WHERE round = 'full_text' GROUP BY id)"""

VECS_CTE = """vecs AS (SELECT vec_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS v, label,
                 sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
          FROM embeddings)"""


def centroid_cte(name: str, src: str) -> str:
    """``name`` AS one row with list ``c``: mean of unit vectors of ``src`` (cols v, n)."""
    return (f"""{name} AS (SELECT list(m ORDER BY pos) AS c FROM (
  SELECT pos, avg(x) AS m FROM (
    SELECT unnest(list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END)) AS x,
           generate_subscripts(v, 1) AS pos FROM {src}) GROUP BY pos))""")


def cos_to(cname: str, unit: bool) -> str:
    """Score of row vector v (norm n) against centroid ``cname``.c."""
    q = f"{cname}.c"
    if unit:
        return (f"CASE WHEN n > 0 THEN list_inner_product(v, {q}) / sqrt(list_inner_product({q}, {q})) / n "
                f"ELSE 0.0 END")
    return f"CASE WHEN n > 0 THEN list_inner_product(v, {q}) / n ELSE 0.0 END"


INGEST_CTE = """srcs AS (
  SELECT p.*, CASE database WHEN 'core' THEN 'core:' || ord WHEN 'semantic_scholar' THEN 'p' || ord ELSE doi END AS skey,
         CASE database WHEN 'arxiv' THEN 0 WHEN 'core' THEN 1 WHEN 'ieeexplore' THEN 2 WHEN 'scopus' THEN 3
                       WHEN 'semantic_scholar' THEN 4 ELSE 5 END AS src
  FROM papers p),
kept AS (SELECT * FROM srcs QUALIFY skey IS NULL
           OR row_number() OVER (PARTITION BY database, skey ORDER BY query_name, ord // 150, ord) = 1),
ingested AS (
  SELECT row_number() OVER (ORDER BY src, query_name, ord // 150, ord) AS ord,
         database,
         CASE database WHEN 'core' THEN coalesce(doi, 'core:' || ord) WHEN 'semantic_scholar' THEN coalesce(doi, 'p' || ord)
                       ELSE doi END AS doi,
         title, abstract,
         CASE WHEN database = 'semantic_scholar' THEN make_date(year(publication_date), 1, 1)
              ELSE publication_date END AS publication_date,
         query_name, replace(replace(query_value, '<AND>', 'AND'), '<OR>', 'OR') AS query_value,
         CASE database WHEN 'arxiv' THEN doi ELSE url END AS url,
         CASE database WHEN 'arxiv' THEN 'arxiv' WHEN 'core' THEN 'core' WHEN 'semantic_scholar' THEN 'semantic_scholar'
                       ELSE publication END AS publication,
         CASE database WHEN 'arxiv' THEN 'arxiv' WHEN 'core' THEN 'core' ELSE publisher END AS publisher, ord AS doc
  FROM kept)"""

# What date each text of tables.DATE_SHAPES means, written out by hand from doc_id: not derived from the parser.
_Y, _M, _D = "2010 + doc_id % 15", "1 + doc_id % 12", "1 + doc_id % 28"
_M2, _D2 = "1 + (doc_id + 1) % 12", "1 + (doc_id + 3) % 28"
DATE_MEANINGS = [
    (_Y, "1", "1"), (_Y, "1", "1"), (_Y, _M, _D), (_Y, _M, _D), (_Y, _M, "1"), (_Y, _M, "1"), (_Y, _M, "1"), (_Y, _M, "1"),
    (_Y, _M, _D2), (_Y, _M2, _D2), (_Y, "3 * (1 + doc_id % 4)", "1"), (_Y, "1", "1"), (_Y, _M, _D), (_Y, _M, _D), None,
    ("2000", "1", "1"), (_Y, _M, _D), (_Y, _M, _D), (_Y, _M, _D), (_Y, _M, _D), (_Y, _M2, "1"),
]


def date_meaning_sql() -> str:
    whens = " ".join(f"WHEN {k} THEN " + ("NULL" if x is None else f"make_date(CAST({x[0]} AS INT), CAST({x[1]} AS INT), CAST({x[2]} AS INT))")
                     for k, x in enumerate(DATE_MEANINGS))
    return f"CASE doc_id % {len(DATE_MEANINGS)} {whens} END"
