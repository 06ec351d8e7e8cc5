"""The unified record schema -- the single contract between operators.

``ord`` is an explicit total order.  Keep-first de-duplication, dense ids and
review draws are defined on it, because a distributed table has no row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("doi", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("query_value", T.StringType()),
    T.StructField("publication", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("publication_date", T.DateType()),
    T.StructField("database", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("semantic_score", T.DoubleType()),
    T.StructField("ord", T.LongType()),
])

PAPER_COLUMNS = [f.name for f in PAPER_SCHEMA.fields]

# The eleven columns every source is normalised to (before stamping id/status).
CORE_COLUMNS = ["doi", "type", "query_name", "query_value", "publication", "publisher",
                "publication_date", "database", "title", "url", "abstract"]

# Review states used by the two review rounds.
UNKNOWN = "unknown"
INCLUDED = "included"
NOT_INCLUDED = "not included"   # abstract round
EXCLUDED = "excluded"           # full-text round
REMOVED_STATES = (NOT_INCLUDED, EXCLUDED)
REVIEW_STATES = (UNKNOWN, INCLUDED, NOT_INCLUDED, EXCLUDED)   # order breaks ties on equal timestamps


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` onto PAPER_SCHEMA: missing columns become typed nulls,
    extra columns are dropped, types are cast."""
    cols: list[Column] = []
    present = set(df.columns)
    for f in PAPER_SCHEMA.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
