"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.memory import release


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table, read by Spark alone (any path scheme)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (and columns named), so that other columns of
    the input can neither clash with an operator's own nor be read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c) for c in more])


def map_rows(df: DataFrame, schema: str, batch: Callable[..., dict], *args, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with one function from a batch's columns (Python lists by
    name) to output columns; one Arrow batch, or with ``rows`` a slice of so many rows of it, is
    turned into Python values at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                b = whole.slice(at, rows)
                out = batch({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, *args)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                del out
        release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, change: Callable[..., pa.RecordBatch], *args, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` that keeps the columns: slices of ``rows`` rows of each batch are filtered or
    rewritten by ``change(slice, *args)``; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                out = change(b.slice(at, rows), *args)
                if out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the
    session has it; a folder of our own only where it is unset (tests)."""
    from ..session import checkpoint_dir
    return checkpoint_dir(spark).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, so a lost executor costs a re-read and not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
