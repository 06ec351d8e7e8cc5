"""Aggregations and set operations (survey E3, E4, H1, A6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def union_aligned(*dfs: DataFrame, order_col: str = "ord") -> DataFrame:
    """H1: union by column name, missing columns become NULL.  ``ord`` is numbered
    anew by (input, ord), so keep-first prefers earlier inputs, as
    ``pd.concat`` order does, and stays unique however often unions are nested.
    A single input, or inputs without ``ord``, keep their columns as they are."""
    from .ordering import with_dense_id

    out = None
    for rank, d in enumerate(dfs):
        d = d.withColumn("__rank", F.lit(rank))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if len(dfs) < 2 or order_col not in out.columns:
        return out.drop("__rank")
    return with_dense_id(out.withColumnRenamed(order_col, "__ord"), ["__rank", "__ord"], order_col).drop("__rank", "__ord")


def stage_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named stage, as one table.  Frames that are stage tables
    (``sources.stages``) are counted from their files' metadata."""
    out = None
    for name, d in frames.items():
        c = d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def volume_by_year(df: DataFrame, date_col: str = "publication_date") -> DataFrame:
    """E4, year rows: records per query x source x year, with a 0 for every year
    between a query's first and last one that has none."""
    keys = ["query_name", "database"]
    per_year = df.filter(F.col(date_col).isNotNull()).groupBy(*keys, F.year(date_col).alias("year")).agg(F.count(F.lit(1)).alias("n_records"))
    years = (per_year.groupBy(*keys).agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
             .select(*keys, F.explode(F.sequence("y0", "y1")).alias("year")))
    return years.join(per_year, [*keys, "year"], "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))


def volume_profile(df: DataFrame, page_size: int, date_col: str = "publication_date") -> DataFrame:
    """Records per query x source x year, totals per query x source and the
    number of pages needed at ``page_size`` rows per page."""
    per_year = (df.groupBy("query_name", "database", F.year(date_col).alias("year"))
                .agg(F.count(F.lit(1)).alias("n_year")))
    return (per_year.groupBy("query_name", "database")
            .agg(F.sum("n_year").cast("long").alias("total"),
                 F.count(F.lit(1)).cast("long").alias("n_years"),
                 F.min("year").alias("first_year"), F.max("year").alias("last_year"))
            .withColumn("pages", F.ceil(F.col("total") / F.lit(page_size)).cast("long")))


def audit_pages(totals: DataFrame, rows: DataFrame, request: str = "request_id", total: str = "total") -> DataFrame:
    """Requests whose parsed rows fall short of the announced total.

    ``totals`` has one row per request (announced total), ``rows`` one row per
    parsed record; rows are counted per request (partial aggregation) and
    compared with the announcement.  A request with no parsed row counts 0."""
    got = rows.groupBy(request).agg(F.count(F.lit(1)).alias("received"))
    return (totals.select(request, F.col(total).cast("long").alias("expected"))
            .join(got, request, "left")
            .withColumn("received", F.coalesce(F.col("received"), F.lit(0)))
            .filter(F.col("received") < F.col("expected")))
