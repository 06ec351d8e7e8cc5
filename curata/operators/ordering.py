"""Sorts, paging, per-group caps, draws and dense ids (survey G1-G5, B7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: Sequence[str | Column], desc: bool | Sequence[bool] = False) -> list[Column]:
    if isinstance(desc, bool):
        desc = [desc] * len(cols)
    out = []
    for c, d in zip(cols, desc):
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.desc() if d else col.asc())
    return out


def sort_records(df: DataFrame, by: Sequence[str], desc: bool | Sequence[bool] = False, tiebreak: str = "ord") -> DataFrame:
    """Total sort (range-partitioned by Spark); ``tiebreak`` makes it total."""
    return df.orderBy(*_order(list(by), desc), F.col(tiebreak))


def top_k(df: DataFrame, by: str, k: int, desc: bool = True, tiebreak: str = "ord") -> DataFrame:
    """G1: the k best rows -- ``TakeOrderedAndProject``: each task keeps its own
    k best, only k rows per task reach the final merge."""
    return df.orderBy(*_order([by], desc), F.col(tiebreak)).limit(k)


def page(df: DataFrame, order_by: Sequence[str], offset: int, size: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*[F.col(c) for c in order_by]).offset(offset).limit(size)


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """G3, keyset form for deep pages: rows after the last key seen."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def cap_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows per group, the first by ``order_by``.  Plans as a
    partial ``WindowGroupLimit`` before the shuffle, so a hot group sends at most
    n rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def draw_key(seed: int, col: str = "ord") -> Column:
    """Deterministic pseudo-random order: md5 of the row key and the seed."""
    return F.md5(F.concat(F.col(col).cast("string"), F.lit(f":{int(seed)}")))


def draw_batch(df: DataFrame, n: int, seed: int = 0, status: str = "unknown") -> DataFrame:
    """A reproducible random draw of ``n`` undecided rows (instead of the
    reference's one ``sample()`` at a time)."""
    cand = df.filter(F.col("status") == status)
    return cand.orderBy(draw_key(seed), F.col("ord")).limit(n)


def with_dense_id(df: DataFrame, order_by: str | Sequence[str] = "ord", out: str = "id") -> DataFrame:
    """Dense 1..n in the order of ``order_by`` (columns that are unique
    together), without a window over the data and without collecting anything.

    The rows are range-partitioned and sorted by ``order_by`` and written once as a stage
    table, with the number of their partition and their place in it.  The
    partitions' sizes, one row each, give the offsets; the id is offset + place.  So the input's plan runs once
    (counting reads the stage table), no task gets more than a range of the
    sampled order, and a recomputed task yields the same ids."""
    from ..sources.stages import cut

    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    place = F.monotonically_increasing_id()   # partition number << 33 | place in the partition
    staged = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                 .withColumns({"__p": F.shiftright(place, 33), "__i": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = staged.groupBy("__p").agg((F.max("__i") + 1).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))   # a row for each partition
    return (staged.join(F.broadcast(starts), "__p")
            .withColumn(out, (F.col("__start") + F.col("__i") + 1).cast("long")).drop("__p", "__i", "__start"))
