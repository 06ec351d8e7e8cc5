"""Operator 10, packing documents into training sequences by vector best-fit.

A document is its token ids and an end id; only one longer than a sequence is cut.
Pieces are packed group by group, longest first.  A bin's state is a vector of
residual capacities -- tokens, documents, attention cost (sum of squared lengths) --
and a piece goes to the open bin that can hold it in *every* dimension and scores best:
least weighted norm of what would remain (``norm``), or greatest weighted dot product of demand and residual (``dot``).

The number of groups follows the number of pieces (about ``GROUP`` each, dealt
by a hash), so a task holds one group of bounded size.  Bins that a group
leaves under ``FULL`` of their capacity are opened again and their pieces packed together with those of other groups, in 64 times fewer groups.

The vocabulary's split pattern never matches white space, so a text's ids are those of its runs of other characters, one after the
other; a run that a worker's memo (bounded by bytes) holds is looked up, and the new ones of a block of texts go to the library
in one call.  A text with a code point above U+02FF goes to the library whole.  Null texts are empty (the end id alone).  Repeated rows are packed
once each; null ids are kept.  An empty table gives an empty result.  Token ids never leave the task
that made them: only lengths and checksums move.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import id_text, release, staged
from .tokens import OUTSIDE, blocks, narrow, special_split, tokenizer

VOCABULARY = "word_bpe_49k.json"
END = 1
CAPACITY = 4096
#: Documents in a sequence, and attention cost, at most; these two never bind
#: a full sequence and are there for callers that need them to.
DOCUMENTS, ATTENTION = CAPACITY, CAPACITY**2
WEIGHTS = (1.0, 0.01, 0.01)
GROUP, FULL = 2048, 0.98
#: Documents that are Python values at a time.
ROWS = 2048
#: Bytes that a worker's memo of encoded pre-tokens may take, by estimate; beyond it the memo starts anew.
MEMO = 72 << 20
#: Fixed value: the split pattern of this vocabulary.
PRETOKENS = narrow(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Texts with a code point that operator 1 sends to the library whole, or whose lower case is one, go there whole.
ODD = re.compile("[^" + "".join(re.escape(chr(c)) for c in range(0x300) if not OUTSIDE.search(chr(c)) and not OUTSIDE.search(chr(c).lower())) + "]")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Runs:
    """Ids, as little-endian bytes, of runs without white space.  Pre-tokens are kept while the memo is under ``MEMO`` bytes; runs of
    several pre-tokens (a word and its punctuation), of which there are many more, only as long as a block of texts needs them."""

    def __init__(self, name: str):
        self.name, self.memo, self.size = name, {}, 0
        vocabulary = tokenizer(name).get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each pre-token: all go to the library in one text, one space apart, and are told apart by their last ids."""
        ids = np.array(tokenizer(self.name).encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(parts):
            return [_ids(e.ids) for e in tokenizer(self.name).encode_batch_fast(parts, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[4 * i:4 * j] for i, j in zip([0, *ends], ends)]

    def learn(self, lists: list[list[str]]) -> tuple[dict, list[str]]:
        """A memo that holds the runs of ``lists``, and those of them that are to leave it afterwards."""
        new = set(chain.from_iterable(lists)).difference(self.memo)
        several = {x: PRETOKENS.findall(x) for x in new if not x.isalpha()}
        for x in [x for x, parts in several.items() if len(parts) == 1 and parts[0] == x]:
            del several[x]
        parts = list(new.difference(several).union(*several.values()).difference(self.memo))
        if parts:
            if self.size > MEMO:
                self.memo, self.size = {}, 0
                return self.learn(lists)
            found = self.encode(parts)
            self.memo.update(zip(parts, found))
            self.size += sum(map(len, parts)) + sum(map(len, found)) + 160 * len(parts)  # both objects' heads and the entry
        get = self.memo.__getitem__
        self.memo.update([(x, b"".join(map(get, own))) for x, own in several.items()])
        return self.memo, list(several)


@lru_cache(maxsize=2)
def known_runs(name: str) -> Runs:
    return Runs(name)


@lru_cache(maxsize=2)
def special_start(name: str) -> str:
    """What all special strings begin with: a text without it holds none."""
    return commonprefix([a.content for a in tokenizer(name).get_added_tokens_decoder().values()])


def encode(texts: list[str | None], name: str = VOCABULARY):
    """For each whole text its ids and the end id, as little-endian bytes."""
    runs, split, start = known_runs(name), special_split(name), special_start(name)
    end = _ids([END])
    for block in blocks([x or "" for x in texts]):
        lists, whole = [], []
        for x in block:
            if ODD.search(x) or (start in x and split.search(x)):
                whole.append(_ids(tokenizer(name).encode(x, add_special_tokens=False).ids))
                lists.append([])
            else:
                whole.append(b"")
                lists.append(x.lower().split())
        memo, leave = runs.learn(lists)
        get = memo.__getitem__
        for ids, found in zip(whole, lists):
            yield (ids or b"".join(map(get, found))) + end
        for x in leave:
            del memo[x]


def cut_pieces(docs: DataFrame, name: str, capacity: int) -> DataFrame:
    """Length and checksum of every piece of every document."""
    arrow = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                rows = []
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist(), name)):
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        release()

    return docs.mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, ...] = WEIGHTS,
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.  Longest first; ties in the given order."""
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    room, used = np.empty((3, n)), np.zeros(n, np.int64)  # residuals by dimension, tokens in use
    cap, w = np.array(capacities, float), np.array(weights, float)
    live = np.empty(0, np.int64)  # bins that can still take one token
    bins = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        free = room[:, live]
        fits = (free >= need[:, None]).all(0)
        if fits.any():
            left = (free - need[:, None]) / cap[:, None]
            score = -(w @ (left * left)) if rule == "norm" else w @ ((free / cap[:, None]) * (need / cap)[:, None])
            b = live[np.where(fits, score, -np.inf).argmax()]
        else:
            b, bins = bins, bins + 1
            room[:, b] = cap
            live = np.append(live, b)
        room[:, b] -= need
        where[i], offset[i] = b, used[b]
        used[b] += int(size)
        if room[0, b] < 1 or room[1, b] < 1 or room[2, b] < 1:
            live = live[live != b]
    return where, offset


def pack_pieces(pieces: DataFrame, groups: int, first: int, capacities: tuple[float, float, float], rule: str) -> DataFrame:
    """Pack each of ``groups`` hash groups; sequence ids start at ``first``."""
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = group.column("length").to_numpy()
        where, offset = best_fit(lengths, capacities, rule=rule)
        fill = np.bincount(where, weights=lengths)[where].astype(np.int64)
        g = group.column("g")[0].as_py()
        group = group.drop_columns(["g"])
        for name, column in (("sequence_id", first + (g << 24) + where), ("offset", offset), ("fill", fill)):
            group = group.append_column(name, pa.array(column, pa.int64()))
        return group

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, f"{PIECES}, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, documents: int = DOCUMENTS,
                   attention: int = ATTENTION, rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.
    ``attention`` is at least ``capacity`` squared wherever a document may fill a sequence."""
    if documents < 1 or attention < capacity**2:
        raise ValueError("a full piece must fit an empty sequence")
    caps = (float(capacity), float(documents), float(attention))
    pieces = staged(cut_pieces(id_text(docs), vocabulary, capacity), "pieces")
    full = (pieces.filter(F.col("length") == capacity)
            .withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))
    part = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(part.count() / GROUP))
    once = staged(pack_pieces(part, groups, 0, caps, rule), "packed")
    rest = once.filter(F.col("fill") < FULL * capacity)
    again = pack_pieces(rest.drop("sequence_id", "offset", "fill"), max(1, groups // 64), 1 << 60, caps, rule)
    return full.unionByName(once.filter(F.col("fill") >= FULL * capacity).drop("fill")).unionByName(again.drop("fill"))
