"""Operator 2, exact uniform sharding by a hypergeometric communication matrix.

Rows lie in ``sources`` (by a hash of the row).  How many rows each source sends
to each shard follows, for a uniform random permutation cut into shards of fixed
sizes, a multivariate hypergeometric law: the matrix is drawn row by row from
the source counts.  Each source then permutes its rows (order by a random key)
and deals them out by the matrix row; after the exchange each shard permutes again.  The counts of shards
differ by at most one (law ``rows``), slots are gapless from 0.

Only ids, sizes and checksums move, never the texts.  The second permutation of a
shard is cut at the leading bits of its random key into blocks, whose starts come
from one small count table; so no task holds a whole shard.

The driver sees one count per source and draws ``sources x shards`` numbers (at
most 65,536 x shards, sent to the tasks as a table of that proven size).  All
else is DataFrame code.

Null texts have size 1 (no bytes, plus 1) and the checksum of the empty text.
Null ids are rows like others.  Repeated rows take one slot each; which of equal
rows takes which is indistinguishable.  An empty table gives an empty result;
other columns are not read.  The same rows and seed give the same shards.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged

ROWS_PER_SOURCE = 50_000
SOURCES = (1024, 65_536)


def hypergeometric(rng: random.Random, good: int, total: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement from ``total`` hit one of
    ``good``: inversion that walks outwards from the mode."""
    low, high = max(0, sample + good - total), min(sample, good)
    if low >= high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(total - good, sample - mode) - log_choose(total, sample))
    u = rng.random() - p
    if u < 0:
        return mode
    up = down = mode
    p_up = p_down = p
    while True:
        moved = False
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (total - good - sample + up + 1))
            up += 1
            u, moved = u - p_up, True
            if u < 0:
                return up
        if down > low:
            p_down *= down * (total - good - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u, moved = u - p_down, True
            if u < 0:
                return down
        if not moved or p_up + p_down < 1e-300:  # rounding left a rest of the unit interval
            return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each source for each shard: row sums are ``counts``, column sums ``sizes``."""
    rng, left = random.Random(seed), list(sizes)
    matrix = []
    for n in counts:
        row, pool = [], sum(left)
        for j, room in enumerate(left):
            k = hypergeometric(rng, room, pool, n) if j < len(left) - 1 else n
            pool -= room
            n -= k
            row.append(k)
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(id_text(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                       F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    total = rows.count()
    sources = min(SOURCES[1], max(SOURCES[0], total // ROWS_PER_SOURCE))
    own = ["doc_id", "size", "text_crc32"]

    def key(k: int):
        return F.xxhash64(F.lit(seed), F.lit(k), *own, "row")  # the row's place in the written table tells equal rows apart

    rows = rows.withColumn("source", F.pmod(key(0), F.lit(sources)).cast("int"))
    counts = sorted((r.source, r["count"]) for r in rows.groupBy("source").count().collect())  # at most `sources` rows
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [{"source": s, "ends": [sum(row[:j + 1]) for j in range(shards)]} for (s, _), row in zip(counts, matrix)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<source:int,ends:array<bigint>>>")))

    # permute within each source, deal out by the matrix
    bits = max(0, (sources // shards).bit_length() - 1)
    place = F.row_number().over(Window.partitionBy("source").orderBy(key(1), "row"))
    sent = staged(rows.withColumn("place", place).join(F.broadcast(table), "source")
                  .select(*own, F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard"), key(2).alias("key"))
                  .withColumn("block", F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)), "shard-sent")

    # permute within each shard: blocks of leading bits in order, rows by key in a block
    starts = (sent.groupBy("shard", "block").count()
              .withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).drop("count"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", *own)) + F.col("start") - 1
    return (sent.join(F.broadcast(starts), ["shard", "block"])
            .select(*own, F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
