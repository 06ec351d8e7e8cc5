"""De-duplication (survey F1-F8) -- the core of the reference.

Every keep-first is defined by an explicit total order (``ord`` by default),
because a distributed table has no row order.

Physical shape of ``keep_first``: ``row_number() OVER (PARTITION BY key ORDER
BY ord) = 1``.  Catalyst plans it as a *partial* ``WindowGroupLimit`` before the
shuffle, so each map task forwards at most one row per key: a key holding a
third of all rows costs one row per map task in the exchange, not a third of
the table in one reducer.  NULL keys either form one group (pandas semantics,
``nulls='one'``) or are all kept (``nulls='all'``); in the second case the
partition key is widened with ``ord`` so a mass of NULLs spreads over all
reducers instead of forming a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, long_key, norm_dedup, norm_review

_RN = "__rn"


def _cols(keys) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def keep_first(df: DataFrame, keys, order_by: str | Sequence[str] = "ord", nulls: str = "one") -> DataFrame:
    """keep the first row (by ``order_by``) of every key.

    nulls='one' -- rows with a NULL key form one group (pandas ``drop_duplicates``);
    nulls='all' -- every row with a NULL key survives."""
    if nulls not in ("one", "all"):
        raise ValueError("nulls must be 'one' or 'all'")
    kcols = _cols(keys)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    part = list(kcols)
    if nulls == "all":
        any_null = F.lit(False)
        for k in kcols:
            any_null = any_null | k.isNull()
        part.append(F.when(any_null, F.struct(*order)))
    w = Window.partitionBy(*part).orderBy(*[F.col(o) for o in order])
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def doi_key(parity: bool = False) -> Column:
    """F2 key: lower-cased DOI.  Intent mode also turns blank DOIs into NULL;
    parity mode keeps the reference's behaviour (whitespace DOIs stay values)."""
    d = F.lower(F.col("doi"))
    return d if parity else blank_to_null(F.trim(d))


def dedup_doi(df: DataFrame, order_by="ord", nulls: str = "all") -> DataFrame:
    """DOI de-dup, case-insensitive.  ``nulls='one'`` reproduces the
    reference, where all NULL DOIs collapse to one row (quirk Q1)."""
    return keep_first(df, doi_key(parity=(nulls == "one")), order_by, nulls)


def dedup_title(df: DataFrame, order_by="ord") -> DataFrame:
    """title de-dup on the I3-normalised title (hashed shuffle key)."""
    return keep_first(df, long_key(norm_dedup("title")), order_by, "one")


def dedup_abstract(df: DataFrame, order_by="ord") -> DataFrame:
    """abstract de-dup on the I3-normalised abstract (hashed shuffle key)."""
    return keep_first(df, long_key(norm_dedup("abstract")), order_by, "one")


def _narrow(df: DataFrame, order_by: str, **keys: Column) -> DataFrame:
    """Only ``order_by``, which identifies a row, and the keys: what a chain of
    keep-first steps exchanges, whatever else the rows carry."""
    return df.select(F.col(order_by), *[k.alias(name) for name, k in keys.items()])


def _cascade(keys: DataFrame, order_by: str, doi_nulls: str) -> DataFrame:
    out = keep_first(keys, "__doi", order_by, doi_nulls)
    out = keep_first(out, "__title", order_by, "one").filter("__text")
    return keep_first(out, "__abstract", order_by, "one")


def _cascade_keys(doi_nulls: str) -> dict[str, Column]:
    return {"__doi": doi_key(parity=(doi_nulls == "one")), "__title": long_key(norm_dedup("title")),
            "__abstract": long_key(norm_dedup("abstract")),
            "__text": blank_to_null("abstract").isNotNull() & blank_to_null("title").isNotNull()}


def remove_repeated(df: DataFrame, order_by: str = "ord", doi_nulls: str = "all") -> DataFrame:
    """the cascade DOI -> title -> require title and abstract -> abstract.

    Each step sees only the survivors of the previous one, so the keys are not
    fused into one connected-components pass: that would remove more rows.  The steps run on
    digests of the keys; the rows themselves meet the survivors in one semi
    join on ``order_by``, which must be unique."""
    left = _cascade(_narrow(df, order_by, **_cascade_keys(doi_nulls)), order_by, doi_nulls)
    return df.join(left.select(order_by), order_by, "left_semi")


def singletons(df: DataFrame, keys, order_by: str = "ord") -> DataFrame:
    """rows whose key occurs exactly once (pandas ``keep=False``).

    Counted with a hash aggregate (map-side partial counts, so a hot key is
    pre-aggregated) and joined back on the unique ``order_by`` column, which
    spreads evenly however skewed the key is."""
    kcols = _cols(keys)
    keyed = df.select(F.col(order_by), *[k.alias(f"__k{i}") for i, k in enumerate(kcols)])
    once = (keyed.groupBy(*[f"__k{i}" for i in range(len(kcols))])
            .agg(F.count(F.lit(1)).alias("__n"), F.min(order_by).alias(order_by))
            .filter(F.col("__n") == 1)
            .select(order_by))
    return df.join(once, on=order_by, how="left_semi")


def review_dedup(df: DataFrame, order_by: str = "ord") -> DataFrame:
    """review-round de-dup -- lower-cased title, then the abstract
    lower-cased without spaces (no hyphen/newline rule); on digests, as F5."""
    out = _narrow(df, order_by, __title=long_key(F.lower("title")), __abstract=long_key(norm_review("abstract")))
    out = keep_first(keep_first(out, "__title", order_by, "one"), "__abstract", order_by, "one")
    return df.join(out.select(order_by), order_by, "left_semi")


def final_dedup(df: DataFrame, order_by: str = "ord") -> DataFrame:
    """F8: final-list de-dup -- lower-cased title, then lower-cased DOI keeping
    every row without DOI, then the F5 cascade; on digests, as F5."""
    out = _narrow(df, order_by, __plain=long_key(F.lower("title")), __raw=F.lower(F.col("doi")), **_cascade_keys("all"))
    out = keep_first(keep_first(out, "__plain", order_by, "one"), "__raw", order_by, "all")
    return df.join(_cascade(out, order_by, "all").select(order_by), order_by, "left_semi")
