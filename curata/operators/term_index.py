"""Positional term index for boolean search (survey C9).

A posting is a word with what stands before it, ``gap``, and up to ``ROW`` of its occurrences in a field: the records' keys ``ord`` and the places ``pos``.
Arrow cuts the texts, a block of them at a time.  Postings are ranged by (term, first) into parts of about as many occurrences each; where parts begin
is taken from a sample of ``TEXTS`` texts, which decides on sizes alone.  So a query reads the parts that hold its words -- a frequent word fills parts of its own, and a
prefix is a range of terms.  The lexicon (term, first and last part, occurrences) names the parts; a query fetches one row of it for each of its words.

A phrase is its words at consecutive places with the same text between them: joins of narrow occurrences by (ord, field, pos).  The query's
AND/OR structure is evaluated by Spark over one row for each (ord, field) that some term hits, holding which terms hit it.
Rows are those of ``search.boolean_search``, the scan.  A term that begins or ends with other than a letter, digit or underscore has no place in the
index; its hits are found by the scan.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..functions.memory import release
from ..functions.text import WORD_CLASS, norm_search
from ..sources.stages import cut
from . import search

#: Occurrences of a part, about.
PART = 2_000_000
#: Parts at least, so that small tables are cut too.
LEAST_PARTS = 16
#: Occurrences of a posting, and bytes of texts that are cut at a time.
ROW, BLOCK = 256, 4 << 20
#: Texts that say where parts begin, and about as many of their postings, at most: of them all, and of each part where that is more.
TEXTS, SAMPLE, EACH = 5000, 100_000, 200
WORD, OTHER = f"{WORD_CLASS}+", f"[^{WORD_CLASS[1:-1]}]*"
HIT = ["ord", "field"]
POSTING = "term string, gap string, first long, n int, ord array<long>, pos array<int>, part int"
SCHEMA = f"{POSTING}, field int"


def _postings(texts: pa.RecordBatch, edges: Sequence[tuple[str, int]]) -> pa.RecordBatch:
    """The postings of a block of texts (ord, text), and the parts that they belong to."""
    own, found = words.split(texts.column(1), words.OTHER)
    term, gap = found.dictionary_encode(), words.gaps_before(texts.column(1)).dictionary_encode()
    group = term.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(gap.dictionary)) + gap.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(group, kind="stable")
    group, n = group[order], np.arange(len(group))
    first = np.flatnonzero((n - np.searchsorted(group, group)) % ROW == 0)
    ends, head = pa.array(np.append(first, len(group)), pa.int32()), pa.array(order[first])
    ords, pos = texts.column(0).take(pa.array(own[order])), pa.array((n - np.searchsorted(own, own))[order], pa.int32())
    terms, heads = term.dictionary.take(term.indices.take(head)), pc.fill_null(ords.take(pa.array(first)), 0)
    part = pa.array([bisect_right(edges, at) for at in zip(terms.to_pylist(), heads.to_pylist())], pa.int32())
    return pa.RecordBatch.from_arrays([
        terms, gap.dictionary.take(gap.indices.take(head)), heads, pa.array(np.diff(first, append=len(group)), pa.int32()),
        pa.ListArray.from_arrays(ends, ords), pa.ListArray.from_arrays(ends, pos), part], names=["term", "gap", "first", "n", "ord", "pos", "part"])


def postings(df: DataFrame, fields: Sequence[str], key: str = "ord", edges: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """term, gap, first (the first of ``ord``), n (its size), ord, pos, part (how many of ``edges`` it has reached), field (its number): every word of
    every field."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.blocks(whole, BLOCK):
                yield _postings(b, edges)
        release()

    def of(i: int, f: str) -> DataFrame:
        own = df.select(F.col(key).cast("long").alias("ord"), norm_search(f).alias("text")).filter("text IS NOT NULL")
        return own.mapInArrow(run, POSTING).withColumn("field", F.lit(i))

    return reduce(DataFrame.unionByName, [of(i, f) for i, f in enumerate(fields)])


def _edges(df: DataFrame, fields: Sequence[str], key: str, parts: int | None) -> tuple[list[tuple[str, int]], int]:
    """Where parts of about as many occurrences each begin, and the number of parts, by the postings of some texts."""
    share = min(1.0, TEXTS / max(1, df.count()))
    some = cut(postings(df.sample(share, seed=1), fields, key).select("term", F.col("first"), "n"), "sample")
    n = some.agg(F.sum("n").alias("n")).first().n or 0
    parts = parts or max(LEAST_PARTS, -(-int(n / share) // PART))
    chance = min(1.0, max(SAMPLE, EACH * parts) / max(1, n))  # of an occurrence: postings of many are always there, so frequent words keep their weight
    few = sorted((r.term, r.first, max(r.n, 1 / chance)) for r in some.filter(F.rand(1) < F.col("n") * chance).toLocalIterator())
    upto = np.cumsum([n for *_, n in few])
    return [few[i][:2] for i in np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)] if few else [], parts


def build(df: DataFrame, path: str, fields: Sequence[str] = ("title", "abstract"), key: str = "ord", parts: int | None = None) -> TermIndex:
    """Write the index of ``df`` under ``path`` and open it."""
    spark = df.sparkSession
    edges, parts = _edges(df, fields, key, parts)
    # the part first: files are written in its order, and another sort would come after this one
    sorted_ = postings(df, fields, key, edges).repartitionById(parts, "part").sortWithinPartitions("part", "term", "first", "field")
    sorted_.write.mode("overwrite").partitionBy("part").parquet(os.path.join(path, "postings"))
    written = spark.read.schema(SCHEMA).parquet(os.path.join(path, "postings"))
    lexicon = written.groupBy("term").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.sum("n").alias("n"))
    lexicon.repartitionByRange(max(1, parts // 16), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(os.path.join(path, "lexicon"))
    return open_index(spark, path, fields)


def open_index(spark: SparkSession, path: str, fields: Sequence[str] = ("title", "abstract")) -> TermIndex:
    return TermIndex(spark, path, tuple(fields))


@dataclass(frozen=True)
class Phrase:
    """words[i] is followed by gaps[i + 1]; ``prefix``: the last word may go on."""
    words: tuple[str, ...]
    gaps: tuple[str, ...]
    prefix: bool


def phrase(term: search.Term) -> Phrase | None:
    """A query term as words and what stands between them; None where it begins or ends with something else."""
    word = re.compile(r"\w+")  # as WORD_CLASS: letters, numbers, underscore
    words = word.findall(term.text)
    between = word.split(term.text)
    if not words or between[0] or between[-1]:
        return None
    return Phrase(tuple(words), tuple(between[:-1]), term.prefix)


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]

    def lexicon(self) -> DataFrame:
        return self.spark.read.schema("term string, first int, last int, n long").parquet(os.path.join(self.path, "lexicon"))

    @staticmethod
    def _matches(word: str, prefix: bool) -> Column:
        return F.col("term").startswith(word) if prefix else F.col("term") == word

    def parts(self, words: Sequence[tuple[str, bool]]) -> dict[tuple[str, bool], tuple[int, int]]:
        """First and last part of each word (or prefix) that the index has: one row for each word of the query."""
        asked = [self.lexicon().filter(self._matches(w, p)).agg(F.min("first").alias("a"), F.max("last").alias("b")).select(F.lit(i).alias("i"), "a", "b")
                 for i, (w, p) in enumerate(words)]
        found = reduce(DataFrame.unionByName, asked).collect() if asked else []
        return {words[r.i]: (r.a, r.b) for r in found if r.a is not None}

    def postings(self, word: str, prefix: bool, parts: Mapping[tuple[str, bool], tuple[int, int]]) -> DataFrame:
        """The postings of a word; only its parts are read."""
        rows = self.spark.read.schema(SCHEMA).parquet(os.path.join(self.path, "postings"))
        if (word, prefix) not in parts:
            return rows.filter(F.lit(False))
        a, b = parts[word, prefix]
        return rows.filter(F.col("part").between(a, b) & self._matches(word, prefix))

    def occurrences(self, word: str, prefix: bool, parts: Mapping[tuple[str, bool], tuple[int, int]]) -> DataFrame:
        """ord, field, pos, gap of a word."""
        return self.postings(word, prefix, parts).select("field", "gap", F.explode(F.arrays_zip("ord", "pos")).alias("o")).select("o.ord", "field", "o.pos", "gap")

    def hits(self, p: Phrase, parts: Mapping) -> DataFrame:
        """(ord, field) where a phrase stands."""
        last = len(p.words) - 1
        if not last:
            return self.postings(p.words[0], p.prefix, parts).select(F.explode("ord").alias("ord"), "field").distinct()
        rows = [self.occurrences(w, p.prefix and i == last, parts) for i, w in enumerate(p.words)]
        found = rows[0].select(*HIT, "pos")
        for i in range(1, len(rows)):
            after = rows[i].filter(F.col("gap") == p.gaps[i]).select(*HIT, (F.col("pos") - i).alias("pos"))
            found = found.join(after, [*HIT, "pos"], "left_semi")
        return found.select(*HIT).distinct()

    def search(self, df: DataFrame, query: str, synonyms: Mapping[str, Sequence[str]] | None = None, across_fields: bool = False, key: str = "ord") -> DataFrame:
        """The rows of ``df``, the records that were indexed, that satisfy the boolean query."""
        skeleton, groups = search.compile_query(query, synonyms)
        asked = {t: phrase(t) for g in groups for t in g}
        words = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in asked.values() if p for i, w in enumerate(p.words)))
        parts = self.parts(words)
        found = []
        for i, group in enumerate(groups):
            for t in group:
                rows = [self.hits(asked[t], parts)] if asked[t] else [
                    df.filter(search.term_condition(t, f)).select(F.col(key).alias("ord"), F.lit(k).alias("field")) for k, f in enumerate(self.fields)]
                found += [r.withColumn("g", F.lit(i)) for r in rows]
        every = reduce(DataFrame.unionByName, found)
        by = ["ord"] if across_fields else HIT
        flags = [F.max(F.col("g") == i).alias(f"__t{i}") for i in range(len(groups))]
        right = every.groupBy(*by).agg(*flags).filter(F.expr(skeleton)).select(F.col("ord").alias("__ord")).distinct()
        return df.join(right, F.col(key) == F.col("__ord"), "left_semi")
