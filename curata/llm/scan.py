"""Scans over a globally sorted table: running sums by key, and digests of long concatenations.

Rows are range-partitioned by (key, order), so a key with a third of all rows lies in many
partitions.  Each task scans its range with a carry; what a range hands to the next is
one row for each partition, which is all that the driver sees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import staged

#: Bytes of a piece of a concatenation.
PIECE = 1 << 14


def sorted_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _prefixes(v: np.ndarray, new: np.ndarray, carry: int, xor: bool) -> np.ndarray:
    """Inclusive running sums (or exclusive ors) of ``v`` that start anew where ``new``; rows before continue ``carry``."""
    c = np.bitwise_xor.accumulate(v) if xor else np.cumsum(v)
    starts = np.flatnonzero(new)
    before = np.where(starts > 0, c[starts - 1], 0)
    base = np.r_[carry if xor else -carry, before].astype(np.int64)[np.cumsum(new)]
    return c ^ base if xor else c - base


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], add: Sequence[str] = (), xor: Sequence[str] = (), name: str = "running") -> DataFrame:
    """The rows of ``df`` and, for each column of ``add`` and ``xor`` (long, not null), ``run_<column>``:
    its sum (exclusive or) over the rows of the same ``key`` (longs, not null) up to and with this one in ``order``.
    The input's plan runs twice (range sampling), so it should be a stage table."""
    over = [*add, *xor]
    kinds = [c in xor for c in over]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema] + [StructField(f"run_{c}", LongType()) for c in over]
                        + [StructField("__part", IntegerType()), StructField("__first", ArrayType(LongType()))])
    arrow, runs = to_arrow_schema(schema), slice(len(df.columns), len(df.columns) + len(over))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, carry = TaskContext.get().partitionId(), None, None, [0] * len(over)
        for b in batches:
            if not b.num_rows:
                continue
            k = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in key])
            new = np.r_[last is None or (k[0] != last).any(), (k[1:] != k[:-1]).any(1)]
            found = [_prefixes(b.column(b.schema.get_field_index(c)).to_numpy(), new, at, x) for c, at, x in zip(over, carry, kinds)]
            first, last, carry = k[0].tolist() if first is None else first, k[-1].tolist(), [int(f[-1]) for f in found]
            extra = [pa.array(f) for f in found] + [pa.array(np.full(b.num_rows, part, np.int32)), pa.nulls(b.num_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *extra], arrow)], schema=arrow)
        if last is not None:  # what the next range must know
            end = {f.name: None for f in arrow} | dict(zip(key, last)) | {"__part": part, "__first": first}
            end |= dict(zip((f.name for f in list(arrow)[runs]), carry))
            yield pa.RecordBatch.from_pylist([end], schema=arrow)

    found = staged(sorted_ranges(df, [*key, *order]).mapInArrow(scan, schema), name)
    ends = found.filter("__first IS NOT NULL").select("__part", "__first", F.array(*key), *[f"run_{c}" for c in over]).collect()  # a row for each partition
    offsets, carried, total = [], None, []
    for part, first, last, *sums in sorted(ends):
        own = total if carried == first else [0] * len(over)
        if any(own):
            offsets.append((part, *first, *own))
        total = [(a ^ b if x else a + b) if last == first else a for a, b, x in zip(sums, own, kinds)]
        carried = last
    rows = found.filter("__first IS NULL").drop("__first")
    if not offsets:
        return rows.drop("__part")
    names = ", ".join([f"__k{i} long" for i in range(len(key))] + [f"__o{i} long" for i in range(len(over))])
    handed = df.sparkSession.createDataFrame(offsets, f"__p int, {names}")
    same = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(key)]
    both = rows.join(F.broadcast(handed), reduce(lambda x, y: x & y, same, F.col("__part") == F.col("__p")), "left")
    for i, (c, x) in enumerate(zip(over, kinds)):
        o = F.coalesce(f"__o{i}", F.lit(0).cast("long"))
        both = both.withColumn(f"run_{c}", F.col(f"run_{c}").bitwiseXOR(o) if x else F.col(f"run_{c}") + o)
    return both.select(*df.columns, *[f"run_{c}" for c in over])


def digests(pieces: DataFrame, key: Sequence[str], at: str, piece: str, separator: bytes, run: Sequence[str] = (), alone: str | None = None,
            name: str = "digests") -> DataFrame:
    """``key`` columns and ``sha256`` (lowercase hex) of the ``piece`` strings of a key joined in order of ``at`` (one string for each).

    ``pieces`` must be partitioned and sorted by key and ``at`` so that the rows of a key (and of the ``run`` columns) that lie in
    one partition follow each other without a gap in ``at``.  Each task joins them to pieces of about ``PIECE`` bytes; only these are
    shuffled by key, and a task streams through them, so a long concatenation is never in memory as a whole.
    Where the boolean ``alone`` is true the key's rows lie together, and its digest is final at once."""
    fields = {f.name: f.dataType for f in pieces.schema}
    kinds = ", ".join(f"{k} {fields[k].simpleString()}" for k in key)
    width, breaks = len(key), [*key, *run]
    first_schema = f"{kinds}, at long, piece binary, sha256 string"
    arrow, out_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (first_schema, f"{kinds}, sha256 string"))

    def batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start, before, parts, size, state = None, 0, None, [], 0, None

        def ended() -> tuple:
            return (*own[:width], start, *((separator.join(parts), None) if state is None else (None, state.hexdigest())))

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(len(breaks) + 3)]
            rows: list[tuple] = []
            for *k, a, text, whole in zip(*columns):
                raw = text.encode()
                if own != k or (size > PIECE and not whole):
                    if own is not None:
                        rows.append(ended())
                    own, start, parts, size, state = k, a, [], 0, hashlib.sha256(raw) if whole else None
                elif a == before:
                    continue
                elif whole:
                    state.update(separator)
                    state.update(raw)
                if not whole:
                    parts.append(raw)
                    size += len(raw) + 1
                before = a
            yield from batch(rows, arrow)
        if own is not None:
            yield from batch([ended()], arrow)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for b in batches:
            rows: list[tuple] = []
            for *k, raw in zip(*[b.column(i).to_pylist() for i in range(width + 1)]):
                if own != k:
                    if own is not None:
                        rows.append((*own, state.hexdigest()))
                    own, state = k, hashlib.sha256(raw)
                else:
                    state.update(separator)
                    state.update(raw)
            yield from batch(rows, out_schema)
        if own is not None:
            yield from batch([(*own, state.hexdigest())], out_schema)

    whole = F.col(alone) if alone else F.lit(False)
    joined = staged(pieces.select(*breaks, at, piece, whole.alias("alone")).mapInArrow(join, first_schema), name)
    longer = joined.filter("sha256 IS NULL").repartition(*key).sortWithinPartitions(*key, "at").select(*key, "piece")
    return joined.filter("sha256 IS NOT NULL").select(*key, "sha256").unionByName(longer.mapInArrow(digest, f"{kinds}, sha256 string"))
