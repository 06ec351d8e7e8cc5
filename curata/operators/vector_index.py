"""Vector index for exact top-k and threshold search by cosine (survey G1, S1).

Vectors are dealt to the nearest of a few thousand centres and stored partitioned by that cell.  A cell keeps the
smallest and greatest angle of its vectors to its centre.  By the triangle inequality for angles no vector of the cell is nearer to a
query than the query's angle to the centre less the greatest one, or the smallest one less it; cells whose bound cannot
reach the threshold (or the k-th best score found so far) are never read -- a partition filter of the scan.  Results are
those of a full scan, ties included; how much is read depends on how well the vectors cluster.

The centres are fitted on a bounded sample (``SAMPLE`` rows in expectation, drawn by a hash of the id); every vector is indexed.
Only the cells' bounds come to the driver: at most ``CELLS`` rows.  A cell's rows are spread over as many files as they need, so a cell
with a third of all vectors is not written by one task.  Zero and null vectors score 0 and lie in a cell of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import cut
from .ordering import top_k
from .relevance import cosine_to_unit, vector_literal

#: Centres at most, rows that they are fitted on in expectation, rows of a file, rounds of fitting.
CELLS, SAMPLE, ROWS_PER_FILE, ROUNDS = 4096, 20_000, 100_000, 8
ZERO = -1
#: Slack of the bounds for rounding.
SLACK = 1e-6


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a list column as unit rows (zero where null, of another length, or zero)."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column.to_pylist()):
        if x is not None and len(x) == dim:
            out[i] = x
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def fit_centres(vectors: DataFrame, key: str, vec: str, cells: int, dim: int, n: int) -> np.ndarray:
    """Unit centres by spherical k-means on a sample of the vectors."""
    drawn = F.pmod(F.xxhash64(F.lit(9), key), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    x = unit_rows(vectors.filter(drawn).select(key, vec).dropDuplicates([key]).select(vec).toArrow().column(vec), dim)
    x = np.unique(x[np.abs(x).sum(1) > 0], axis=0)
    rng = np.random.default_rng(3)
    if len(x) <= cells:
        return x
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    cells: np.ndarray      # cell numbers, in order
    rows: np.ndarray       # rows of each
    least: np.ndarray      # smallest angle to the centre
    most: np.ndarray       # greatest one
    key: str
    vec: str

    def scan(self, cells: Sequence[int]) -> DataFrame:
        """The vectors of some cells; only their folders are read."""
        return self.spark.read.parquet(os.path.join(self.path, "vectors")).filter(F.col("cell").isin([int(c) for c in cells])).drop("cell")

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each cell can have with a unit query."""
        angle = np.arccos(np.clip(self.centres @ unit, -1, 1))[np.maximum(self.cells, 0)] if len(self.centres) else np.zeros(len(self.cells))
        nearest = np.maximum(0, np.maximum(angle - self.most, self.least - angle))
        return np.where(self.cells == ZERO, 0.0, np.cos(nearest) + SLACK)

    def scored(self, cells: Sequence[int], unit: np.ndarray) -> DataFrame:
        return self.scan(cells).withColumn("semantic_score", cosine_to_unit(self.vec, vector_literal(unit)))

    def above(self, query: Sequence[float], threshold: float) -> tuple[DataFrame, list[int]]:
        """The rows with a cosine of ``threshold`` or more, and the cells read."""
        unit = _unit(query)
        cells = self.cells[self.bounds(unit) >= threshold].tolist()
        return self.scored(cells, unit).filter(F.col("semantic_score") >= threshold), cells

    def top_k(self, query: Sequence[float], k: int) -> tuple[DataFrame, list[int]]:
        """G1: the k best rows (ties by key), and the cells read: the most promising ones give a k-th best score, then
        every other cell whose bound reaches it."""
        unit = _unit(query)
        bound = self.bounds(unit)
        order = np.argsort(-bound, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.rows[order]), 4 * k)) + 1
        first = order[:enough]
        best = top_k(self.scored(self.cells[first], unit), "semantic_score", k, tiebreak=self.key).select("semantic_score").collect()  # k rows
        reach = min((r.semantic_score for r in best), default=-2.0) if len(best) >= k else -2.0
        more = order[enough:][bound[order[enough:]] >= reach]
        cells = self.cells[np.concatenate([first, more])].tolist()
        return top_k(self.scored(cells, unit), "semantic_score", k, tiebreak=self.key), cells


def _unit(query: Sequence[float]) -> np.ndarray:
    q = np.asarray(query, float)
    length = np.linalg.norm(q)
    return q / length if length > 0 else q


def build(vectors: DataFrame, path: str, key: str = "id", vec: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Write the index of ``vectors`` (key, vec) under ``path`` and open it."""
    spark = vectors.sparkSession
    known = cut(vectors.select(key, vec), "vectors")
    shape = known.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, dim = shape.n, max(shape.d or 0, 0)
    cells = min(CELLS, cells or max(1, round(n ** 0.5)))
    centres = fit_centres(known, key, vec, cells, dim, n) if dim else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)  # at most CELLS x dim numbers
    kind = dict(vectors.dtypes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = unit_rows(b.column(vec), dim)
                zero = ~(x != 0).any(1) if dim else np.ones(b.num_rows, bool)
                cos = x @ c.T if len(c) else np.zeros((b.num_rows, 1))
                cell = np.where(zero, ZERO, cos.argmax(1)).astype(np.int32)
                angle = np.where(zero, 0.0, np.arccos(np.clip(cos.max(1), -1, 1)))
                yield pa.RecordBatch.from_arrays([b.column(key), b.column(vec), pa.array(cell), pa.array(angle)], names=[key, vec, "cell", "angle"])

    dealt = cut(known.mapInArrow(deal, f"{key} {kind[key]}, {vec} {kind[vec]}, cell int, angle double"), "cells")
    about = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    about.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "bounds"))
    spread = dealt.join(F.broadcast(about.select("cell", F.ceil(F.col("rows") / ROWS_PER_FILE).alias("files"))), "cell")  # a row for each cell
    (spread.repartition("cell", F.pmod(F.xxhash64(key), F.col("files"))).drop("files", "angle")
     .write.mode("overwrite").partitionBy("cell").parquet(os.path.join(path, "vectors")))
    centre_rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(centre_rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "centres"))
    return open_index(spark, path, key, vec)


def open_index(spark: SparkSession, path: str, key: str = "id", vec: str = "embedding") -> VectorIndex:
    """An index that was built under ``path``."""
    about = sorted(spark.read.parquet(os.path.join(path, "bounds")).collect(), key=lambda r: r.cell)  # at most CELLS + 1 rows
    centres = sorted(spark.read.parquet(os.path.join(path, "centres")).collect(), key=lambda r: r.cell)
    cols = [np.array([r[c] for r in about]) for c in ("cell", "rows", "least", "most")]
    return VectorIndex(spark, path, np.array([r.centre for r in centres]), *cols, key, vec)
