"""Registered queries of this subpackage: one per operator and the pipeline,
each over its whole table with production parameters.  ``SQL`` holds the DuckDB
twins where SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, licenses, merkle, packing, pii, quality, repair, secrets, sharding, tokens, trie
from .common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op2_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(documents(spark, sf_dir))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(documents(spark, sf_dir)), pii.KINDS)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_neighbours(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("enter", "exit")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_uniform_shards": op2_uniform_shards,
    "op3_jaccard_join": op3_jaccard_join,
    "op3_jaccard_links": op3_jaccard_links,
    "op4_personal_data": op4_personal_data,
    "op5_language": op5_language,
    "op6_merkle": op6_merkle,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_structure_repair": op13_structure_repair,
}

# A conversation's crc32 by bits; prefixes as lists of turns, each joined to all of its own prefixes.
OP11_SQL = r"""WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda r, x: list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
s AS (
  SELECT i.c, 0 AS own, t.pos, t.role, t.text FROM ids i JOIN t ON t.c = i.b AND t.pos < i.h
  UNION ALL SELECT i.c, 1, t.pos, t.role, t.text FROM ids i JOIN t ON t.c = i.c AND t.pos >= i.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM s),
p AS (
  SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL SELECT c, 0, '', CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) FROM ids),
n AS (
  SELECT path, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saving
  FROM p GROUP BY path),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
sub AS (
  SELECT list_slice(path, 1, u) AS path, sum(saving) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (SELECT n.path, n.saving, k.path IS NULL AS leaf, unnest(range(0, n.d + 1)) AS u FROM n LEFT JOIN k ON n.path = k.path) GROUP BY 1)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, q.c AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, sub.leaves AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN sub ON n.path = sub.path LEFT JOIN k ON n.path = k.path LEFT JOIN e ON n.path = e.path
LEFT JOIN n q ON n.d > 0 AND q.path = list_slice(n.path, 1, n.d - 1)
"""


def _words_sql(text: str) -> str:
    """Words of operator 12: A-Z lower-cased, runs of digits, letters and all code points from U+0080."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def _license_sql() -> str:
    """Operator 12: places of whole phrases by comparing slices, notices by diagonals of equal slices."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    texts = [(p, label, licenses.K_PHRASE) for p, label in licenses.PHRASES] + [(n, label, licenses.K_NOTICE) for label, n in licenses.NOTICES]
    rows = ", ".join(f"({i}, {quoted(label)}, {k}, {_words_sql(quoted(text))})" for i, (text, label, k) in enumerate(texts))
    k = licenses.K_NOTICE
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql('text')} AS w FROM documents),
t(template, label, k, tw) AS (VALUES {rows}),
w AS (SELECT rid, w, unnest(range(0, len(w))) AS i FROM d),
base AS (
  SELECT rid, label, i FROM w JOIN t ON t.k = {licenses.K_PHRASE} AND w.w[i + 1] = tw[1] AND list_slice(w.w, i + 1, i + len(tw)) = tw),
places AS (SELECT template, label, len(tw) AS size, tw, unnest(range(0, len(tw) - {k - 1})) AS j FROM t WHERE k = {k}),
hit AS (
  SELECT rid, template, label, size, i - j AS diagonal, j FROM w JOIN places ON w.w[i + 1] = tw[j + 1] AND list_slice(w.w, i + 1, i + {k}) = list_slice(tw, j + 1, j + {k})),
apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {licenses.BAND} THEN 0 ELSE 1 END AS a
  FROM (SELECT DISTINCT rid, template, diagonal FROM hit)),
cluster AS (SELECT rid, template, diagonal, sum(a) OVER (PARTITION BY rid, template ORDER BY diagonal) AS c FROM apart),
span AS (
  SELECT rid, label, count(DISTINCT j + o.o) / size AS share
  FROM hit JOIN cluster USING (rid, template, diagonal) CROSS JOIN (SELECT unnest(range(0, {k})) AS o) o
  GROUP BY rid, template, label, size, c HAVING share >= {licenses.LEAST}),
b AS (SELECT rid, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
a AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT rid, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT rid, label, share FROM span) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


SQL: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_license_scan": _license_sql()}
