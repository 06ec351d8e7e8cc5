"""Vector relevance (survey S1-S3, I14, E2, D7, G1).

Scores are cosine similarities on ``ARRAY<FLOAT>`` columns computed with
higher-order functions (``zip_with`` + ``aggregate``), JVM-side.

S2 (relevance to a set of seed records) uses the identity
``mean_i cos(c, s_i) = dot(c/|c|, mean_i s_i/|s_i|)``: the seeds are reduced to
one centroid by a distributed aggregate (partial vector sums in every task),
and every candidate is scored against that one vector.  No candidates x seeds
pairs are formed, whatever the size of either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    vd = as_double(v)
    return F.sqrt(dot(vd, vd))


def _safe_div(x: Column, n: Column) -> Column:
    # a zero vector scores 0 instead of dividing by zero; ``n`` is read once
    return F.coalesce(F.try_divide(x, n), F.lit(0.0))


def cosine_to_unit(v, unit: Column) -> Column:
    """cos(v, u) for a unit vector ``u``: dot(v, u) / |v| -- O(d) per row."""
    return _safe_div(dot(as_double(v), unit), norm(v))


def cosine(a, b) -> Column:
    return _safe_div(dot(as_double(a), as_double(b)), norm(a) * norm(b))


def normalised(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Unit-normalise the array column ``vec`` into ``out``.

    The norm is computed once per row and spread into an array of the same
    length; ``zip_with`` divides element by element.  (A lambda reading the norm
    column directly may get the norm inlined, i.e. recomputed per element.)"""
    tmp = "__norm"
    with_n = df.withColumn(tmp, norm(vec))
    filled = F.array_repeat(F.col(tmp), F.size(vec))
    return (with_n.withColumn(out, F.zip_with(as_double(vec), filled, lambda x, n: _safe_div(x, n)))
            .drop(tmp))


def centroid_column(df: DataFrame, vec: str = "embedding", unit: bool = False) -> Column:
    """Mean of the unit-normalised vectors of ``df`` (unit length if ``unit``) as
    a lazy scalar subquery (``DataFrame.scalar``): it runs inside the consuming query, no
    driver round trip and no join.  ``Summarizer.mean`` adds whole vectors, with
    partial sums in every task: one row of d numbers leaves each of them."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    units = normalised(df.select(vec).filter(F.col(vec).isNotNull()), vec, "__unit")
    c = (units.select(array_to_vector(F.col("__unit")).alias("v"))
         .agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("c")))
    if unit:   # one row: normalising here costs nothing per candidate
        c = normalised(c, "c", "c")
    return c.scalar()


def vector_literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("double") for x in v])


def semantic_scores(df: DataFrame, query_vec: Sequence[float] | Column, vec: str = "embedding",
                    out: str = "semantic_score", unit: bool = False) -> DataFrame:
    """Cosine of every row's vector with the query vector (a list of numbers
    or an array Column such as ``centroid_column``; ``unit`` says that the
    Column already has length 1)."""
    if isinstance(query_vec, Column):
        # a subquery may not sit inside a higher-order function: bind it to a column first
        length = norm(vec) if unit else norm(vec) * norm("__q")
        return (df.withColumn("__q", query_vec)
                .withColumn(out, _safe_div(dot(as_double(vec), as_double("__q")), length))
                .drop("__q"))
    q = [float(x) for x in query_vec]
    n = sum(x * x for x in q) ** 0.5
    q = [x / n for x in q]
    return df.withColumn(out, cosine_to_unit(vec, vector_literal(q)))


def semantic_filter(df: DataFrame, query_vec: Sequence[float] | Column, threshold: float, vec: str = "embedding",
                    unit: bool = False) -> DataFrame:
    """Keep rows with cosine >= threshold (a top-k report is G1 on the scores)."""
    return semantic_scores(df, query_vec, vec, unit=unit).filter(F.col("semantic_score") >= F.lit(float(threshold)))


def relevance_to_seeds(candidates: DataFrame, seeds: DataFrame, threshold: float,
                       vec: str = "embedding") -> DataFrame:
    """Mean cosine of each candidate to all seeds, kept if >= threshold.
    One query: the seed centroid is a scalar subquery of it."""
    c = centroid_column(seeds, vec)
    # a subquery may not sit inside a higher-order function: bind it to a column first
    scored = (candidates.withColumn("__c", c)
              .withColumn("semantic_score", _safe_div(dot(as_double(vec), F.col("__c")), norm(vec))).drop("__c"))
    return scored.filter(F.col("semantic_score") >= F.lit(float(threshold)))


def hashing_encoder(df: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """S3: default text encoder -- Spark ML term hashing of the tokenised text,
    L2-normalised, as ``ARRAY<FLOAT>``.  A model-backed encoder can replace it as
    an iterator ``pandas_udf`` (model loaded once per Python worker)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import tokenize

    tmp_tok, tmp_vec, tmp_unit = "__tokens", "__tf", "__unit"
    tok = df.withColumn(tmp_tok, tokenize(text, min_len=1, max_len=None))   # every word counts
    tf = HashingTF(inputCol=tmp_tok, outputCol=tmp_vec, numFeatures=dim).transform(tok)
    unit = Normalizer(inputCol=tmp_vec, outputCol=tmp_unit, p=2.0).transform(tf)
    return (unit.withColumn(out, vector_to_array(F.col(tmp_unit), "float32"))
            .drop(tmp_tok, tmp_vec, tmp_unit))
