"""Review state (survey E1, R1, R2, B13, C13).  Decisions arrive as a table
(or a stream, see ``curata.streaming``) instead of console prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CORE_COLUMNS, EXCLUDED, INCLUDED, NOT_INCLUDED, UNKNOWN
from .dedup import review_dedup
from .joins import apply_decisions
from .ordering import draw_batch, with_dense_id


def review_progress(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, unknown, included, excluded and percent reviewed
    (``round((total-unknown)/total*100, 2)``; 0.0 for an empty group set)."""
    s = F.col("status")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == UNKNOWN).alias("unknown"),
        F.count_if(s == INCLUDED).alias("included"),
        F.count_if(s.isin(NOT_INCLUDED, EXCLUDED)).alias("excluded"),
    ]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn(
        "progress",
        F.when(F.col("total") > 0,
               F.round((F.col("total") - F.col("unknown")) / F.col("total") * 100, 2)).otherwise(F.lit(0.0)))


def review_batch(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """De-dup for review (F7), then a reproducible draw of ``n`` unknown rows."""
    return draw_batch(review_dedup(df), n, seed)


def reviewed_projection(df: DataFrame, status: str) -> DataFrame:
    """The eleven core columns (+ score, ord, record_id), status stamped."""
    cols = [c for c in CORE_COLUMNS + ["semantic_score", "ord", "record_id"] if c in df.columns]
    return df.select(*cols).withColumn("status", F.lit(status))


def review_round(df: DataFrame, decisions: DataFrame, round: str = "abstract", stage=None, ids: bool = True):
    """R2: apply the decisions of one ``round``; return (included, removed, updated).

    ``included`` gets new dense ids (unless ``ids`` is off, for a caller that numbers later); after the abstract round its status is
    reset to ``unknown`` (it goes on to the full-text round), after the
    full-text round it stays ``included``.  ``stage`` (e.g. a lineage cut) is
    applied to the updated table once, before it is split."""
    upd = apply_decisions(review_dedup(df), decisions, round)
    if stage is not None:
        upd = stage(upd)
    inc = upd.filter(F.col("status") == INCLUDED)
    inc = reviewed_projection(inc, UNKNOWN if round == "abstract" else INCLUDED)
    inc = with_dense_id(inc) if ids else inc
    removed = upd.filter(F.col("status").isin(NOT_INCLUDED, EXCLUDED))
    return inc, removed, upd
