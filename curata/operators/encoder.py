"""Text encoder with corpus statistics (survey S3): term frequency times inverse document frequency.

``fit`` is one distributed aggregate over the distinct words of each text and can be stored as a table and loaded again.  Encoding joins the words of the
texts, cut and counted by Arrow a block of texts at a time, with it.  A word that is in a third of all texts would make that join lopsided, so the most frequent words (at most
``FREQUENT``, a bound that is counted before) are joined by broadcast and only the others by shuffle.

``tfidf_relevance`` is the exact cosine of sparse vectors: records against the mean of the unit vectors of one or more descriptions.
``encode`` gives dense vectors by a fixed signed random projection -- each word has a sign in each dimension, bits of its
hashes -- whose inner products estimate those of the sparse vectors, so S1, S2 and the vector index work on texts.

Words are those of the tokenizer (I8) without limits on their length.  Null and wordless texts have the zero vector, which scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, NOT_LETTERS, UNACCENTED, unmarked
from ..functions.words import counted
from ..sources.stages import cut, write_stage

#: Words that are joined by broadcast, at most.
FREQUENT = 50_000


def word_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf: a row for each different word of each text, counted where the text lies and written once, for ``fit`` and for weights."""
    return cut(counted(texts.select(key, text), unmarked(text), [key], NOT_LETTERS, str.maketrans(ACCENTED, UNACCENTED)), "counts")


def fit(texts: DataFrame, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """term, df (texts that hold it), n (texts), idf = ln((1 + n) / (1 + df)) + 1.  ``counts``: the ``word_counts`` of the texts, where they are at hand."""
    n = texts.count()
    if counts is None:
        counts = counted(texts, unmarked(text), [], NOT_LETTERS, str.maketrans(ACCENTED, UNACCENTED))
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    return seen.withColumn("n", F.lit(n).cast("long")).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def save(stats: DataFrame, path: str) -> None:
    write_stage(stats, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _least_frequent(stats: DataFrame, at_most: int) -> int:
    """The least df at which no more than ``at_most`` words have it or more (steps of a quarter of a power of two)."""
    levels = stats.groupBy(F.floor(F.log2("df") * 4).alias("level")).count().orderBy(F.desc("level")).collect()  # some 160 rows
    total, least = 0, 1 << 62
    for r in levels:
        total += r["count"]
        if total > at_most:
            break
        least = int(np.ceil(2 ** (r.level / 4)))
    return least


def _by_key(texts: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """key, term, tf: the words of rows that share a key counted together; only those are brought together."""
    again = cut(texts.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__again")), "again")
    if again.isEmpty():
        return counts
    same = F.col(key).eqNullSafe(F.col("__again"))
    alone, shared = counts.join(again, same, "left_anti"), counts.join(again, same, "left_semi")
    return alone.unionByName(shared.groupBy(key, "term").agg(F.sum("tf").alias("tf")))


def term_weights(texts: DataFrame, key: str, text: str, stats: DataFrame, frequent: int = FREQUENT, counts: DataFrame | None = None) -> DataFrame:
    """key, term, weight (tf x idf) and the other columns of ``stats`` for the words of each text; words that ``stats`` lacks are left out."""
    own = _by_key(texts, key, word_counts(texts, key, text) if counts is None else counts)
    least = _least_frequent(stats, frequent)
    common, rare = stats.filter(F.col("df") >= least), stats.filter(F.col("df") < least)
    found = own.join(F.broadcast(common), "term")
    others = own.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term")
    return found.unionByName(others).withColumn("weight", F.col("tf") * F.col("idf"))


def description_weights(descriptions: DataFrame, stats: DataFrame, text: str = "text") -> DataFrame:
    """term, q: the mean of the unit vectors of the descriptions (one or more texts)."""
    numbered = cut(descriptions.select(F.col(text).alias("text")).withColumn("d", F.monotonically_increasing_id()), "descriptions")
    n = numbered.count()
    w = term_weights(numbered, "d", "text", stats)
    norms = w.groupBy("d").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return w.join(norms, "d").groupBy("term").agg((F.sum(F.col("weight") / F.col("norm")) / n).alias("q"))


def tfidf_relevance(records: DataFrame, descriptions: DataFrame, stats: DataFrame, threshold: float, text: str = "text", key: str = "ord",
                    counts: DataFrame | None = None) -> DataFrame:
    """key and semantic_score: the mean cosine of each record to the descriptions, where it is ``threshold`` or more."""
    known = cut(stats.join(description_weights(descriptions, stats, "text"), "term", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "terms")
    w = term_weights(records, key, text, known, counts=counts)
    scored = w.groupBy(key).agg((F.sum(F.col("weight") * F.col("q")) / F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("semantic_score"))
    if threshold <= 0:  # records without a word score 0
        scored = records.select(key).join(scored, key, "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    return scored.filter(F.col("semantic_score") >= threshold)


def encode(texts: DataFrame, stats: DataFrame, key: str = "id", text: str = "text", dim: int = 128, out: str = "embedding") -> DataFrame:
    """key and the projected unit vector (``ARRAY<FLOAT>`` of ``dim`` numbers, a multiple of 64) of every text."""
    if dim % 64:
        raise ValueError("dim is a multiple of 64")
    hashes = F.array(*[F.xxhash64(F.lit(i), "term") for i in range(dim // 64)])
    w = term_weights(texts, key, text, stats).groupBy(key).agg(F.collect_list(F.struct(hashes.alias("h"), "weight")).alias("__terms"))
    every = texts.select(key).join(w, key, "left")
    kind = dict(texts.dtypes)[key]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column("__terms")
                n = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])
                terms = lists.flatten()
                h = np.asarray(terms.field("h").flatten(), np.int64).view(np.uint8).reshape(-1, dim // 8)
                signs = np.unpackbits(h, axis=1).astype(np.float64) * 2 - 1
                signs *= terms.field("weight").to_numpy()[:, None]
                vectors = np.zeros((b.num_rows, dim))
                np.add.at(vectors, np.repeat(np.arange(b.num_rows), n), signs)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, length, out=vectors, where=length > 0).astype(np.float32)
                offsets = pa.array(np.arange(b.num_rows + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[key, out])

    return every.mapInArrow(project, f"{key} {kind}, {out} array<float>")


def terms_sql(src: str, key: str, text: str) -> str:
    """DuckDB twin of the words of each text: (key, term, tf)."""
    from ..functions.text import ACCENTED, UNACCENTED
    words = (f"list_filter(string_split_regex(translate(lower(regexp_replace({text}, '<[^>]+>', ' ', 'g')), '{ACCENTED}', '{UNACCENTED}'), "
             f"'[^\\p{{L}}]+'), lambda t: length(t) >= 1)")
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({words}) AS term FROM {src}) GROUP BY ALL"
