"""Words of whole texts, one row for each: Arrow splits a block of texts at a time.  Spark's ``regexp_extract_all`` over the same texts takes some ten
times as long, and the words' places and what stands between them would take another pass.

Classes are those of RE2; its Unicode version may be later than the JVM's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from .memory import release
from .text import WORD_CLASS

WORD, OTHER = f"{WORD_CLASS}+", f"[^{WORD_CLASS[1:-1]}]+"
#: Bytes of texts that are cut at a time.
BLOCK = 1 << 20


def blocks(b: pa.RecordBatch, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the last column, have about ``most`` bytes; a longer text is alone."""
    size = pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size, dtype=np.int64) - size) // most
    edges = [*(np.flatnonzero(np.diff(block, prepend=-1))).tolist(), b.num_rows]
    for first, end in zip(edges, edges[1:]):
        yield b.slice(first, end - first)


def split(texts: pa.Array, between: str) -> tuple[np.ndarray, pa.Array]:
    """What stands between matches of ``between``, but for empty strings, and the text of each."""
    lists = pc.split_pattern_regex(texts, between)
    own, found = pc.list_parent_indices(lists), lists.flatten()
    full = pc.not_equal(found, "")
    return own.filter(full).to_numpy(zero_copy_only=False), found.filter(full)


def gaps_before(texts: pa.Array) -> pa.Array:
    """What stands before each word; what ends a text is left out."""
    lists = pc.split_pattern_regex(texts, WORD)
    keep = np.ones(len(lists.flatten()), bool)
    keep[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)) - 1] = False
    return lists.flatten().filter(pa.array(keep))


def by_word(own: np.ndarray, found: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """An order of words that brings together those that are equal and of one text, where each such group begins in it, and the word of each."""
    coded = found.dictionary_encode()
    group = own * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order, first, found.take(pa.array(order[first]))


def _rows(df: DataFrame, text: Column, keep: Sequence[str], more: str, build: Callable[[pa.Array], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """The columns ``keep`` and those of ``more``: as many rows for each text as ``build`` makes of it."""
    own = df.select(*keep, text.alias("__text")).filter("__text IS NOT NULL")
    schema = StructType([own.schema[k] for k in keep] + StructType.fromDDL(more).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole):
                at, columns = build(b.column(b.num_columns - 1))
                if len(at):
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(len(keep))), *columns], names=schema.names)
        release()

    return own.mapInArrow(run, schema)


def words(df: DataFrame, text: Column, keep: Sequence[str] = (), name: str = "term") -> DataFrame:
    """A row for each word of ``text``."""
    def build(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        own, found = split(texts, OTHER)
        return own, [found]

    return _rows(df, text, keep, f"{name} string", build)


def ahead(df: DataFrame, text: Column, keep: Sequence[str], reach: int) -> DataFrame:
    """__word, __w, __g: every word, the (at most) ``reach`` words from there on and what is between them."""
    def build(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        own, found = split(texts, OTHER)
        gaps, n = gaps_before(texts), np.arange(len(own))
        some = np.minimum(reach, np.searchsorted(own, own, "right") - n)

        def lists(values: pa.Array, first: np.ndarray, size: np.ndarray) -> pa.Array:
            end = np.cumsum(size)
            at = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(first, size)
            return pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), values.take(pa.array(at)))

        return own, [found, lists(found, n, some), lists(gaps, n + 1, some - 1)]

    return _rows(df, text, keep, "__word string, __w array<string>, __g array<string>", build)


def folded(found: pa.Array, letters: dict[int, int]) -> pa.Array:
    """Words with others in place of some letters, none of them ASCII; each different word that may have such is looked at once."""
    coded = found.dictionary_encode()
    odd = pc.invert(pc.string_is_ascii(coded.dictionary))
    other = pa.array([w.translate(letters) for w in coded.dictionary.filter(odd).to_pylist()], found.type)
    return pc.replace_with_mask(coded.dictionary, odd, other).take(coded.indices)


def counted(df: DataFrame, text: Column, keep: Sequence[str], between: str = OTHER, letters: dict[int, int] | None = None) -> DataFrame:
    """term, tf: a row for each different word of ``text``, ``folded``, and how often it stands there."""
    def build(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        own, found = split(texts, between)
        order, first, terms = by_word(own, folded(found, letters or {}))
        return own[order[first]], [terms, pa.array(np.diff(first, append=len(order)), pa.int64())]

    return _rows(df, text, keep, "term string, tf long", build)
