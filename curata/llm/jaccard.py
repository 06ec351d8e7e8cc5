"""Operator 3, n-gram Jaccard self-join in size-banded tiles.

A document's set is its distinct 5-word shingles.  Two sets link when
100 * intersection >= ``percent`` * union; linked documents, and those they
reach, are one component.  Every link is found and verified exactly:

1. Equal texts and equal sets are one node (``sid``, a hash of the sorted set).
   Shingles that repeat inside a batch of documents are counted; the most frequent of the corpus (at
   most ``FREQUENT``) are the only ones whose order is by count.
2. Sets that link share a shingle among the first n - ceil(t n) + 1 of each,
   rarest first (any common order is exact; this one keeps copies' common passages out).  Those prefixes are
   exchanged by shingle; a shingle's sets, in order of size, are cut into blocks of ``TILE``.
3. A tile is a block, or two blocks of one shingle whose sizes can link.  In a
   tile a pair must pass the size bound, then the bitmap bound: each set
   has a bitmap of ``BITS`` where a shingle flips the bit its hash names, so the differing bits
   of two bitmaps are at most the differing shingles, and (n1 + n2 - bits) / 2 bounds the overlap from above.
   Before a pair's arrays are fetched, sets that fill this bitmap are bounded once more by a wider one.
4. Round 1 looks at single blocks and takes, for each set, its first and its nearest partner under the bounds: at
   most two pairs for each member.  They are verified by intersecting the sorted shingle arrays, and give
   components.  Round 2 goes through all tiles whose sets are not all in one
   component and takes every pair across components that passes the bounds: what it
   verifies are exactly the links still missing.  So a group of copies costs about as many verified
   pairs as it has members.

5. The number of links (``jaccard_links``): every link lies inside a component, so the sets of a component are
   dealt into blocks by hash, and each block, and each two blocks, of one component is a tile in which the
   intersections of all pairs are counted exactly.  A tile gives one number for each of its sets, not its
   pairs; a partner counts once for each of its rows.  In a component of two sets they link, without a tile.

Only sets that some pair needs are read again for their arrays: their documents' ids pass a bitset of
bounded size first, and the join with the pairs drops what it lets through by chance.  Nothing but that bitset and the frequent
shingles (both of fixed size) comes to the driver.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased.  Fewer than 5 words are one
shingle, the whole sequence.  Null and wordless texts have the empty set, link with nothing and are
their own component.  Rows are judged by their own text even where ids repeat; rows with a null
id link others but their component_id is null where no row of the component has an id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, map_rows, staged

WORDS, PERCENT = 5, 80
BITS, TILE = 1024, 1024
#: Shingles whose count takes part in the order, at most, and how often one must repeat in a batch to be counted.
FREQUENT, REPEATED = 500_000, 4
MEMO = 200_000
#: Shingles of one count of repeats, and rows that are Python values at a time.
COUNTED, ROWS = 2_000_000, 2048
#: Sets and shingles of a block of a component, in expectation, and shingles (columns) multiplied at a time.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 250_000, 4096
#: A shingle of at most so many sets of a tile is counted pair by pair.
FEW = 16
#: 64-bit words of the bitset of needed ids, at most.
BITSET_WORDS = 1 << 20

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and ASCII case only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        s += h[i:len(h) - size + 1 + i] * MIX[i % len(MIX)] + np.uint64(i // len(MIX))
        s ^= s >> np.uint64(29)
        s *= MIX[5]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def set_id(u: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(u.tobytes())).view(np.int64))) if len(u) else 0


def bitmap(u: np.ndarray, bits: int = BITS) -> bytes:
    """One bit for each hash value, flipped by each shingle that has it."""
    odd = np.bincount((u >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bitmap(u: np.ndarray) -> bytes | None:
    """For a set that fills the tiles' bitmap: one of at least two bits for each shingle."""
    return bitmap(u, 1 << (2 * len(u) - 1).bit_length()) if 2 * len(u) > BITS else None


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps; a wider one is folded to the other's width
    (a bit of the fold is flipped by the shingles of the bits folded on it)."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Lengths of the prefixes in which a set of n meets any that it links with,
    and any of its own size or more."""
    return n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


# --- tasks ------------------------------------------------------------------


def _sets(cols: dict, k: int) -> dict:
    """Rows of kind 0: each document's set; of kind 1: a shingle that repeats in this batch, and how often."""
    out = {c: [] for c in ("kind", "doc_id", "text_hash", "sid", "n", "bits", "wide")}
    seen: dict[int, np.ndarray] = {}
    held = 0

    def count() -> None:
        key, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        key, n = key[n >= REPEATED].view(np.int64).tolist(), n[n >= REPEATED].tolist()
        m = len(key)
        for c, v in zip(out.values(), ([1] * m, [None] * m, [None] * m, key, n, [None] * m, [None] * m)):
            c.extend(v)
        seen.clear()

    for doc_id, text_hash, text in zip(cols["doc_id"], cols["text_hash"], cols["text"]):
        u = shingles(text, k)
        sid = set_id(u)
        if len(u) and sid not in seen:
            seen[sid] = u
            held += len(u)
        for c, v in zip(out.values(), (0, doc_id, text_hash, sid if len(u) else None, len(u), bitmap(u) if len(u) else None, wide_bitmap(u))):
            c.append(v)
        if held >= COUNTED:
            count()
            held = 0
    if seen:
        count()
    return out


def _prefixes(cols: dict, k: int, percent: int, frequent) -> dict:
    keys, counts = frequent.value
    out: dict[str, list] = {"key": [], "sid": [], "n": [], "lead": []}
    seen = set()
    for text in cols["text"]:
        u = shingles(text, k)
        if not len(u) or (sid := set_id(u)) in seen:
            continue
        seen.add(sid)
        rank = np.zeros(len(u), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
            rank = np.where(keys[at] == u, counts[at], 0)
        order = np.argsort(rank, kind="stable")  # u is sorted: equal counts stay in order of hash
        p, lead = prefix_sizes(len(u), percent)
        out["key"].append(u[order[:p]].view(np.int64))
        out["sid"].append(np.full(p, sid))
        out["n"].append(np.full(p, len(u), np.int32))
        out["lead"].append(np.arange(p) < lead)
    empty = {"key": np.int64, "sid": np.int64, "n": np.int32, "lead": bool}
    return {c: np.concatenate(v) if v else np.empty(0, empty[c]) for c, v in out.items()}


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, size and set: the shingles that several sets
    share, cut into blocks of ``TILE`` sets in order of size.  At most one block of a
    shingle is held back, however many sets share it."""
    kinds = {"key": pa.int64(), "block": pa.int32(), "sid": pa.int64(), "n": pa.int32(), "lead": pa.bool_()}
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)]
    open_key, block = None, 0  # shingle whose earlier blocks are already out, and its next block

    def out(key, blocks, sid, n, lead):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key, blocks, sid, n, lead), kinds.values())], names=list(kinds))

    def finish(rows):
        """Whole shingles: number the blocks, drop shingles of one set."""
        nonlocal open_key, block
        key, sid, n, lead = rows
        if not len(key):
            return None
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        first = np.repeat(start, size)
        blocks = (np.arange(len(key)) - first) // TILE
        keep = np.repeat((size > 1) & np.logical_or.reduceat(lead, start), size)
        if open_key is not None and key[0] == open_key:
            blocks[:size[0]] += block
            keep[:size[0]] = True
        open_key, block = None, 0
        return out(key[keep], blocks[keep].astype(np.int32), sid[keep], n[keep], lead[keep]) if keep.any() else None

    for b in batches:
        rows = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        key, sid = rows[0], rows[1]
        once = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])] if len(key) else np.empty(0, bool)
        rows = [x[once] for x in rows]
        key = rows[0]
        if not len(key):
            continue
        last = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
        done = finish([x[:last] for x in rows])
        if done is not None:
            yield done
        held = [x[last:] for x in rows]
        while len(held[0]) > 2 * TILE:  # a frequent shingle: its full blocks go out
            if open_key is None:
                open_key, block = held[0][0], 0
            head = [x[:TILE] for x in held]
            yield out(head[0], np.full(TILE, block, np.int32), *head[1:])
            held, block = [x[TILE:] for x in held], block + 1
    done = finish(held)
    if done is not None:
        yield done


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first ``width`` columns, in lists that end with a tile."""
    held = None
    for b in batches:
        own = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        rows = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        m = len(rows[0])
        same = np.ones(m, bool)
        for c in rows[:width]:
            same &= c == c[-1]
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield [x[:last] for x in rows]
        held = [x[last:] for x in rows]
    if held is not None and len(held[0]):
        yield held


def _passing(rows: list[np.ndarray], width: int, percent: int, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) within a tile under the size and the bitmap bound, by rising d.
    The rows' columns are the tile's ``width``, then sid, n, lead, bits, ..."""
    n = rows[width + 1].astype(np.int64)
    lead = rows[width + 2].astype(bool)
    bits = np.frombuffer(b"".join(rows[width + 3]), np.uint64).reshape(len(n), -1)
    tile = np.zeros(len(n), np.int64)
    for c in rows[:width]:
        tile[1:] += c[1:] != c[:-1]
    tile = np.cumsum(tile > 0)
    i = np.arange(len(n))
    for d in range(1, len(n)):
        i = i[i < len(n) - d]
        i = i[tile[i] == tile[i + d]]
        if not len(i):
            return
        low, high = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
        small = np.where(n[i] < n[i + d], lead[i], np.where(n[i] > n[i + d], lead[i + d], lead[i] | lead[i + d]))
        near = i[small & (100 * low >= percent * high) & allowed(i, i + d)]
        for at in range(0, len(near), 65_536):
            j = near[at:at + 65_536]
            apart = np.bitwise_count(bits[j] ^ bits[j + d]).sum(1, dtype=np.int64)
            both = n[j] + n[j + d]
            j = j[(both - apart) * (100 + percent) >= 2 * percent * both]
            if len(j):
                yield j, j + d


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=PAIRS)


def _first_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Round 1: each set's first and nearest partner in its block (and the first set's nearest)."""
    for rows in _runs(batches, 2):
        sid = rows[2]
        first, nearest, after = (np.full(len(sid), -1) for _ in range(3))
        for i, j in _passing(rows, 2, percent, lambda i, j: np.ones(len(i), bool)):
            first[j] = i
            nearest[j] = np.where(nearest[j] < 0, i, nearest[j])
            after[i] = np.where(after[i] < 0, j, after[i])
        after[nearest >= 0] = -1
        for partner in (first, nearest, after):
            own = np.flatnonzero(partner >= 0)
            if len(own):
                yield _pairs(sid[partner[own]], sid[own])


def _across_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Round 2: all pairs of different components in a tile; of a tile of two
    blocks, those between the blocks."""
    for rows in _runs(batches, 3):
        own, other, sid, block, component = rows[1], rows[2], rows[3], rows[7], rows[8]

        def allowed(i, j):
            return (component[i] != component[j]) & ((own[i] == other[i]) | (block[i] != block[j]))
        for i, j in _passing(rows, 3, percent, allowed):
            yield _pairs(sid[i], sid[j])


def _arrays(cols: dict, k: int, needed) -> dict:
    """The sorted shingles of the documents whose id the bitset holds (of those
    without an id too), each set once in a batch."""
    out, seen = {"sid": [], "arr": []}, set()
    ids = np.array([0 if d is None else d for d in cols["doc_id"]], np.int64)
    wanted = in_bitset(needed.value, ids) | np.array([d is None for d in cols["doc_id"]], bool)
    for i in np.flatnonzero(wanted):
        u = shingles(cols["text"][i], k)
        if len(u) and (sid := set_id(u)) not in seen:
            seen.add(sid)
            out["sid"].append(sid)
            out["arr"].append(u.tobytes())
    return out


def _wide_bound(cols: dict, percent: int) -> dict:
    out = {"a": [], "b": []}
    for a, b, m, n, x, y in zip(cols["a"], cols["b"], cols["m"], cols["n"], cols["x"], cols["y"]):
        if (m + n - bits_apart(x, y)) * (100 + percent) >= 2 * percent * (m + n):
            out["a"].append(a)
            out["b"].append(b)
    return out


def _verify(cols: dict, percent: int) -> dict:
    out = {"a": [], "b": []}
    for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"]):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        if 100 * common >= percent * (len(x) + len(y) - common):
            out["a"].append(a)
            out["b"].append(b)
    return out


def intersections(arrays: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a square matrix (its diagonal is not filled in)."""
    m = len(arrays)
    owner = np.repeat(np.arange(m), [len(a) for a in arrays])
    _, column, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    times = count[column]
    out = np.zeros((m, m), np.int64)
    few = (times > 1) & (times <= FEW)
    row, col = owner[few], column[few]
    for d in range(1, FEW):
        same = col[d:] == col[:-d]
        if not same.any():
            break
        np.add.at(out, (row[:-d][same], row[d:][same]), 1)
    out += out.T
    many = times > FEW
    if many.any():
        row, col = owner[many], np.cumsum(np.r_[0, np.diff(column[many]) != 0])
        for at in range(0, int(col[-1]) + 1, COLUMNS):
            part = slice(*np.searchsorted(col, [at, at + COLUMNS]))
            has = np.zeros((m, COLUMNS), np.float32)
            has[row[part], col[part] - at] = 1
            out += (has @ has.T).astype(np.int64)  # at most COLUMNS: exact
    return out


def _tile_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each set of a tile the rows of the sets that it links with there; in a
    tile of two blocks only links between the blocks."""
    for rows in _runs(batches, 3):
        root, i, j, sid, block, copies, arr = rows
        start = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(start, np.r_[start[1:], len(sid)]):
            own = a + np.flatnonzero(np.r_[True, sid[a + 1:b] != sid[a:b - 1]])  # a set that was read twice
            sets = [np.frombuffer(x, np.uint64) for x in arr[own]]
            n = np.array([len(x) for x in sets])
            common = intersections(sets)
            link = 100 * common >= percent * (n[:, None] + n - common)
            if i[a] == j[a]:
                np.fill_diagonal(link, False)
            else:
                link &= block[own][:, None] != block[own]
            yield pa.RecordBatch.from_arrays([pa.array(sid[own]), pa.array(link @ copies[own])], names=["sid", "links"])


# --- bounded bitset of ids ----------------------------------------------------


def id_bitset(ids: DataFrame, column: str) -> np.ndarray:
    """A bitset that holds every id (and, by chance, others): words of 64 bits,
    a power of two in number and at most ``BITSET_WORDS``, whatever the number of ids."""
    n = ids.count()
    words = 1 << min(BITSET_WORDS.bit_length() - 1, max(6, (n // 4).bit_length()))
    h = F.pmod(F.col(column), F.lit(words * 64).cast("long"))
    got = (ids.filter(F.col(column).isNotNull())
           .select(F.shiftright(h, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))").alias("m"))
           .groupBy("w").agg(F.bit_or("m").alias("m")).collect())  # at most `words` rows
    out = np.zeros(words, np.uint64)
    for r in got:
        out[r.w] = np.int64(r.m).view(np.uint64)
    return out


def in_bitset(bitset: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = np.mod(ids, len(bitset) * 64)
    return (bitset[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) != 0


# --- components ----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node with an edge
    (a, b): large-star and small-star steps until nothing changes.  Neighbour lists are never
    gathered; each step is two minimum aggregates and joins, and its edges are written out."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()

    before = mark(e)
    while before.n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).distinct())
        e = staged(small, "edges")
        after = mark(e)
        if (after.n, after.h) == (before.n, before.h):
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- the join --------------------------------------------------------------------


class JaccardJoin:
    """The steps over one table; ``groups`` is the result."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, words: int = WORDS):
        self.docs, self.percent, self.words = id_text(docs), percent, words
        self.spark = docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with_hash = self.docs.withColumn("text_hash", F.xxhash64("text"))
        first = staged(map_rows(with_hash, "kind int, doc_id long, text_hash long, sid long, n int, bits binary, wide binary", _sets, words, rows=ROWS), "shingle-sets")
        self.sets = first.filter("kind = 0").drop("kind")
        self.nodes = staged(self.sets.filter("n > 0").groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")), "shingle-nodes")
        self.frequent = self._frequent(first.filter("kind = 1"))

    def _frequent(self, repeated: DataFrame):
        counts = repeated.groupBy(F.col("sid").alias("key")).agg(F.sum("n").alias("c"))
        counts = staged(counts, "shingle-counts")
        total, least = 0, 1 << 62
        for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("level")).count().orderBy(F.desc("level")).collect():  # levels: some 4 x 40
            if total + r["count"] > FREQUENT:
                break
            total, least = total + r["count"], r.level
        got = counts.filter(F.floor(F.log2("c") * 4) >= least).toArrow()  # at most FREQUENT rows
        keys, c = (np.asarray(got.column(x).to_numpy(), np.int64) for x in ("key", "c"))
        order = np.argsort(keys.view(np.uint64))
        return keys.view(np.uint64)[order], c[order]

    def members(self) -> DataFrame:
        """key, block, sid, n, lead: the sets that share a shingle of their prefixes."""
        shared = self.spark.sparkContext.broadcast(self.frequent)
        prefixes = map_rows(self.docs, "key long, sid long, n int, lead boolean", _prefixes, self.words, self.percent, shared, rows=ROWS)
        found = staged(prefixes.repartition(self.parts, "key").sortWithinPartitions("key", "n", "sid")
                       .mapInArrow(_members, "key long, block int, sid long, n int, lead boolean"), "members")
        shared.destroy()  # the table is written; nothing reads the counts again
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that link, by exact intersection.  The
        bitset lets some ids through that are not needed; the joins drop their arrays."""
        pairs = self._bounded(pairs)
        ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        needed = staged(ends.join(self.nodes.select("sid", "rep"), "sid").select("rep"), "needed")
        shared = self.spark.sparkContext.broadcast(id_bitset(needed, "rep"))
        arrays = staged(map_rows(self.docs, "sid long, arr binary", _arrays, self.words, shared, rows=ROWS), "arrays")
        shared.destroy()
        left = pairs.join(arrays.select(F.col("sid").alias("a"), F.col("arr").alias("x")), "a")
        both = left.join(arrays.select(F.col("sid").alias("b"), F.col("arr").alias("y")), "b")
        return staged(map_rows(both, "a long, b long", _verify, self.percent, rows=ROWS).distinct(), "links")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the bound of the wide bitmaps.  Pairs of small
        sets, which have none, pass: the tiles' bitmaps bound them as well."""
        wide = self.nodes.filter(F.col("wide").isNotNull())
        side = pairs.join(wide.select(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x")), "a", "left")
        both = side.join(wide.select(F.col("sid").alias("b"), "n", F.col("wide").alias("y")), "b", "left")
        both = staged(both.withColumn("large", F.col("x").isNotNull() & F.col("y").isNotNull()), "wide")
        large = map_rows(both.filter("large").drop("large"), "a long, b long", _wide_bound, self.percent, rows=ROWS)
        return staged(both.filter("NOT large").select("a", "b").unionByName(large), "bounded")

    def first_round(self, members: DataFrame) -> DataFrame:
        """At most two partners under the bounds for each member of a block."""
        percent = self.percent
        tiles = (members.join(self.nodes.select("sid", "bits"), "sid").select("key", "block", "sid", "n", "lead", "bits")
                 .repartition(self.parts, "key", "block").sortWithinPartitions("key", "block", "n", "sid"))
        return staged(tiles.mapInArrow(lambda b: _first_pairs(b, percent), "a long, b long").distinct(), "pairs")

    def second_round(self, members: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs across components that pass the bounds and were not tried yet."""
        percent = self.percent
        labelled = staged(members.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
                          .withColumn("component", F.coalesce("root", "sid")).drop("root"), "labelled")
        blocks = labelled.groupBy("key", "block").agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        mixed = blocks.filter("c0 <> c1").select("key", "block", F.col("block").alias("i"), F.col("block").alias("j"))
        several = blocks.join(blocks.filter("block > 0").select("key").distinct(), "key", "left_semi")
        a, b = several.alias("a"), several.alias("b")
        two = (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") < F.col("b.block"))
                      & (F.col("b.low") * percent <= F.col("a.high") * 100))
               .filter((F.least("a.c0", "b.c0") != F.greatest("a.c1", "b.c1")))
               .select("a.key", F.explode(F.array("a.block", "b.block")).alias("block"), F.col("a.block").alias("i"), F.col("b.block").alias("j")))
        tiles = (labelled.join(mixed.unionByName(two), ["key", "block"]).join(self.nodes.select("sid", "bits"), "sid")
                 .select("key", "i", "j", "sid", "n", "lead", "bits", "block", "component")
                 .repartition(self.parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "sid"))
        found = tiles.mapInArrow(lambda x: _across_pairs(x, percent), "a long, b long").distinct()
        return staged(found.join(tried, ["a", "b"], "left_anti"), "pairs")

    def links(self) -> DataFrame:
        """Verified links (a, b) of sets that give the components: every two sets
        that link are joined by a path of them."""
        members = self.members()
        tried = self.first_round(members)
        found = self.verified(tried)
        more = self.second_round(members, components(found), tried)
        return found if more.isEmpty() else found.unionByName(self.verified(more))

    def set_links(self, roots: DataFrame) -> DataFrame:
        """s, n_links of every set of ``roots``: rows of other sets that link with it."""
        percent = self.percent
        copies = self.sets.filter("n > 0").groupBy("sid").agg(F.count("*").alias("copies"))
        inside = staged(roots.withColumnRenamed("node", "sid").join(self.nodes.select("sid", "rep", "n"), "sid").join(copies, "sid"), "inside")
        whole = inside.groupBy("root").agg(F.count("*").alias("m"), F.sum("copies").alias("rows"), F.sum("n").alias("shingles"))
        inside = inside.join(whole, "root")
        two = inside.filter("m = 2").select("sid", (F.col("rows") - F.col("copies")).alias("links"))
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        more = staged(inside.filter("m > 2").select("root", "sid", "rep", "copies", blocks.alias("blocks"))
                      .withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int")), "several")
        shared = self.spark.sparkContext.broadcast(id_bitset(more, "rep"))
        arrays = map_rows(self.docs, "sid long, arr binary", _arrays, self.words, shared, rows=ROWS)
        tiles = (more.join(arrays, "sid").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "sid", "block", "copies", "arr")
                 .repartition(self.parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "sid"))
        counted = tiles.mapInArrow(lambda b: _tile_links(b, percent), "sid long, links long")
        return two.unionByName(counted).groupBy(F.col("sid").alias("s")).agg(F.sum("links").alias("n_links"))

    def groups(self, count: bool = False) -> DataFrame:
        """doc_id, n_shingles, component_id of every row; with ``count`` also n_links."""
        roots = components(self.links())
        found = self._named(roots)
        if not count:
            return found.drop("s")
        links = self.set_links(roots).withColumnRenamed("s", "sid")
        every = (self.sets.filter("n > 0").groupBy("sid").agg((F.count("*") - 1).alias("same"))
                 .join(links, "sid", "left").select(F.col("sid").alias("t"), (F.col("same") + F.coalesce("n_links", F.lit(0))).alias("n_links")))
        return (found.join(every, F.col("s") == F.col("t"), "left")
                .select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))

    def _named(self, roots: DataFrame) -> DataFrame:
        smallest = (self.nodes.select("sid", "rep").join(roots.withColumnRenamed("node", "sid"), "sid"))
        smallest = smallest.select("sid", "root").join(smallest.groupBy("root").agg(F.min("rep").alias("least")), "root").select("sid", "least")
        named = self.nodes.select("sid", "rep").join(smallest, "sid", "left").select(
            F.col("sid").alias("s"), F.coalesce("least", "rep").alias("component"))
        return (self.sets.join(named, F.col("sid") == F.col("s"), "left")
                .select("s", "doc_id", F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) of every document."""
    return JaccardJoin(docs, percent, words).groups()


def jaccard_links(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """As ``jaccard_groups``, and n_links: the other rows that link with the document's, those of equal texts and sets among them."""
    return JaccardJoin(docs, percent, words).groups(count=True)


def _by_bitset(batch: pa.RecordBatch, bitset, inside: bool) -> pa.RecordBatch:
    return batch.filter(pa.array(in_bitset(bitset.value, batch.column("__key").to_numpy()) == inside))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the one with the smallest id, and of
    rows that share it the one with the smallest hash of its text; rows without an id come after all
    others.  Rows equal in id and text are one document, of which one row stays.

    Only rows whose (id, text) is in the bitset of dropped and repeated ones are joined
    with these; all others pass without a shuffle."""
    join = JaccardJoin(docs, percent, words)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    roots = components(join.links()).withColumnRenamed("node", "sid")
    sets = join.sets.filter("n > 0").groupBy("sid").agg(F.min(place).alias("least")).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sets = staged(sets, "set-places")
    chosen = sets.select("sid", "root").join(sets.groupBy("root").agg(F.min("least").alias("first")), "root").select(F.col("sid").alias("s"), "first")
    rows = join.sets.groupBy("doc_id", "text_hash", "sid").agg(F.count("*").alias("rows"))
    judged = rows.join(chosen, F.col("sid") == F.col("s"), "left").withColumn("stays", F.col("sid").isNull() | place.eqNullSafe(F.col("first")))
    decided = staged(judged.filter("NOT stays OR rows > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.xxhash64("doc_id", "text_hash").alias("__at"),
        F.col("stays").alias("__stays"), F.col("rows").alias("__rows")), "decided")
    shared = docs.sparkSession.sparkContext.broadcast(id_bitset(decided, "__at"))
    own = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string"))).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("__text")))
    sure = map_batches(own, _by_bitset, shared, False).select(docs.columns)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    checked = map_batches(own, _by_bitset, shared, True).join(decided, same, "left").filter(F.coalesce("__stays", F.lit(True)))
    once = checked.filter(F.coalesce("__rows", F.lit(1)) == 1).select(docs.columns)
    more = checked.filter("__rows > 1").dropDuplicates(["__id", "__hash"]).select(docs.columns)
    return sure.unionByName(once).unionByName(more)
