"""Joins (survey D1-D4, D6).  The reference loops over rows and HTTP calls;
here every one is an equi-join that Spark plans itself.  No broadcast hint is
forced: the sides have no proven size bound, so Catalyst and AQE decide from
measured sizes (``autoBroadcastJoinThreshold``), and AQE splits skewed join
partitions when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import Column

from ..schema import REVIEW_STATES, UNKNOWN
from ..functions.text import long_key
from .aggregates import union_aligned
from .dedup import keep_first, singletons
from .filters import between_years, require_text


def citing_edges(selected: DataFrame, edges: DataFrame, key: str = "ord") -> DataFrame:
    """Edges whose cited record is selected."""
    return edges.join(selected.select(F.col(key).alias("cited_ord")), "cited_ord", "left_semi")


def spread_nulls(key: Column, *row: str) -> Column:
    """``key`` for a join that NULL keys take no part in: a NULL becomes a value
    that no key has and that differs from row to row, so that a mass of NULLs
    is dealt over all tasks."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*row).cast("string")))


def expand_citations(selected: DataFrame, edges: DataFrame, records: DataFrame,
                     y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Forward snowball, one hop -- every record citing a selected one,
    then require title/abstract, keep-first by title, optional year range,
    stamped as citations.  A record citing several selected ones appears once
    (semi join), as keep-first by title would make it anyway."""
    hits = citing_edges(selected, edges).select(F.col("citing_ord").alias("ord"))
    cites = records.join(hits, "ord", "left_semi")
    cites = require_text(cites, ["title", "abstract"])
    cites = keep_first(cites, long_key(F.col("title")), "ord", "one")
    if y0 is not None or y1 is not None:
        cites = between_years(cites, y0, y1)
    return cites.withColumns({"query_name": F.lit("citation"), "type": F.lit("citation"),
                              "status": F.lit(UNKNOWN)})


def enrich_abstract(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], col: str = "abstract") -> DataFrame:
    """Fill ``col`` from lookup tables in priority order.

    ``lookups`` is a list of (table, key column shared with ``df``, value
    column[, order column]).  Each lookup is made unique on its key first -- the
    non-blank value with the smallest order (else the smallest value), by
    keep-first, whose partial limit runs before the shuffle -- so the left
    joins never multiply rows; the first non-blank value in priority order
    wins, else ``''``."""
    out = df
    vals = [F.nullif(F.col(col), F.lit(""))]
    for i, spec in enumerate(lookups):
        tbl, key, value = spec[:3]
        order = spec[3] if len(spec) > 3 else None
        name = f"__lk{i}"
        sel = tbl.select(F.col(key), F.nullif(F.col(value), F.lit("")).alias(name),
                         (F.col(order) if order else F.nullif(F.col(value), F.lit(""))).alias("__o"))
        sel = sel.filter(F.col(key).isNotNull() & F.col(name).isNotNull())
        uniq = keep_first(sel, F.col(key), "__o", "one").drop("__o")
        uniq = uniq.withColumnRenamed(key, "__k")
        out = out.withColumn("__key", spread_nulls(F.col(key).cast("string"), *out.columns))
        out = out.join(uniq.withColumn("__k", F.col("__k").cast("string")), F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
        vals.append(F.nullif(F.col(name), F.lit("")))
    names = [f"__lk{i}" for i in range(len(lookups))]
    return out.withColumn(col, F.coalesce(*vals, F.lit(""))).drop(*names)


def decision_code(ts: str = "ts", status: str = "status") -> Column:
    """(ts, status) as one BIGINT: microseconds * 8 + the state's code (1..4).
    Its maximum is the latest decision (ties on ``ts`` go to the later state
    in REVIEW_STATES).  A status outside the fixed states raises an error."""
    states = F.array(*[F.lit(x) for x in REVIEW_STATES])
    code = F.array_position(states, F.col(status))
    code = F.when(code > 0, code).otherwise(
        F.raise_error(F.concat(F.lit("unknown review status: "), F.coalesce(F.col(status), F.lit("NULL")))).cast("long"))
    return F.unix_micros(F.col(ts)) * F.lit(8) + code


def decode_status(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in REVIEW_STATES]), (c % F.lit(8)).cast("int"))


def decode_ts(c: Column) -> Column:
    return F.timestamp_micros(F.floor(c / F.lit(8)))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per id.  ``max`` of a BIGINT code is a hash aggregate with
    map-side partial maxima: a hot id is pre-aggregated, nothing is sorted."""
    return (decisions.groupBy("id").agg(F.max(decision_code()).alias("__last"))
            .select("id", decode_status(F.col("__last")).alias("__decision")))


def apply_decisions(df: DataFrame, decisions: DataFrame, round: str | None = None) -> DataFrame:
    """D3: set ``status`` from the latest decision per id -- of one review
    ``round``, or of all -- ; others keep theirs."""
    if round is not None:
        decisions = decisions.filter(F.col("round") == round)
    last = latest_decisions(decisions)
    return (df.join(last, "id", "left")
            .withColumn("status", F.coalesce(F.col("__decision"), F.col("status")))
            .drop("__decision"))


def undecided(original: DataFrame, selected: DataFrame, citations: DataFrame, removed: DataFrame,
              mode: str = "clean", key: str = "doi") -> DataFrame:
    """Candidates that are not yet decided.

    mode='parity': the reference's "keep only DOIs occurring once in the union of
    all four sets" (it also drops a citing record already retrieved, and every
    NULL DOI -- quirk Q5).  mode='clean': (original + citations) minus
    (selected + removed) by DOI in any case, then one row per DOI, rows without DOI kept;
    ``ord`` is numbered anew (H1)."""
    if mode == "parity":
        union = union_aligned(original, selected, citations.withColumn("publication", F.lit("semantic_scholar")), removed)
        out = singletons(union.withColumn("__k", F.coalesce(F.col(key), F.lit("\u0000null"))), "__k", "ord")
        return out.drop("__k")
    own = F.lower(F.trim(F.col(key)))
    blank = F.nullif(own, F.lit(""))
    decided = selected.select(blank.alias("__d")).unionByName(removed.select(blank.alias("__d"))).dropna().distinct()
    cand = union_aligned(original, citations.select(*original.columns)).withColumn("__k", spread_nulls(blank, "ord"))
    cand = cand.join(decided, F.col("__k") == F.col("__d"), "left_anti")
    return keep_first(cand, F.col("__k"), "ord", "all").drop("__k")
