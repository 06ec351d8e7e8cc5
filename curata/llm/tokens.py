"""Operator 1, token counts by the whole-token shortcut.

Byte-level BPE splits a text into pre-tokens and merges inside each of them.  A
pre-token that the vocabulary holds *and* that the library itself encodes as
one id needs no merging.  ``whole_tokens`` proves this once for every vocabulary string (each is
given to the library alone); counting then is one pass of the split pattern and
one dictionary lookup per pre-token, and only the rest is merged -- each distinct
one once per worker while the bounded memo holds it, in one library call per block of texts.

The split pattern runs in Python and is used only for texts whose every code
point is below U+0300 and on which both regular expression engines agree
(``tests/llm`` checks each of them); any other text goes to the library whole.

Nulls count as empty texts (0 bytes, 0 tokens); repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
No shuffle; a batch of texts is in memory at a time.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import id_text, map_rows

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct merged pre-tokens that a worker keeps; beyond it the memo starts anew.
MEMO = 600_000
#: Code points of texts whose pre-tokens are looked up at a time.
BLOCK = 1 << 20
#: Texts with a code point outside go to the library whole; so do U+001C..U+001F,
#: which the two engines class differently.
OUTSIDE = re.compile("[^\x00-\x1b\x20-\u02ff]")
#: Letters and numbers below U+0300, as classes of a pattern.
LETTERS, NUMBERS = ("".join(f"\\u{c:04x}" for c in range(0x300) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}"))


def narrow(pattern: str) -> re.Pattern:
    """A split pattern with its Unicode classes written out for code points below U+0300."""
    for a, b in ((r"[\p{L}]", f"[{LETTERS}]"), (r"[\p{N}]", f"[{NUMBERS}]"), (r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]"),
                 (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{NUMBERS}]")):
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


@lru_cache(maxsize=4)
def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def special_split(name: str) -> re.Pattern | None:
    """Splits a text at the strings of the special tokens."""
    special = sorted((a.content for a in tokenizer(name).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for U+0100 onwards in their order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def whole_tokens(name: str = VOCABULARY) -> frozenset[str]:
    """Vocabulary strings that are a text of their own, one pre-token, and that
    the library encodes as exactly one id."""
    t, to_byte = tokenizer(name), byte_of_char()
    texts = []
    for s in t.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(to_byte[c] for c in s).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [x for x in texts if (m := pattern.match(x)) and m.end() == len(x)]
    return frozenset(x for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


class Pieces:
    """What the library makes of single pre-tokens, kept by pre-token."""

    def __init__(self, name: str, value, known: dict):
        self.name, self.value, self.known, self.memo = name, value, known, dict(known)

    def learn(self, lists: list[list[str]]) -> dict:
        """The memo, after the pre-tokens that it lacks went to the library in one call."""
        new = list(set(chain.from_iterable(lists)).difference(self.memo))
        if new:
            if len(self.memo) > MEMO:
                self.memo = dict(self.known)
                return self.learn(lists)
            found = tokenizer(self.name).encode_batch_fast(new, add_special_tokens=False)
            self.memo.update(zip(new, (self.value(e.ids) for e in found)))
        return self.memo


@lru_cache(maxsize=2)
def _counts(name: str) -> tuple[Pieces, re.Pattern]:
    return Pieces(name, len, dict.fromkeys(whole_tokens(name), 1)), narrow(public_tokenizers.PATTERN)


def blocks(texts: list[str], size: int = BLOCK):
    """Runs of texts with about ``size`` code points together."""
    block, n = [], 0
    for x in texts:
        block.append(x)
        n += len(x)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def count_tokens(texts: list[str | None], name: str = VOCABULARY) -> list[int]:
    """Tokens of whole texts, as ``encode(text, add_special_tokens=False)`` gives them."""
    out: list[int] = []
    pieces, pattern = _counts(name)
    split = special_split(name)
    for block in blocks([x or "" for x in texts]):
        lists, extra = [], []
        for x in block:
            if OUTSIDE.search(x):
                lists.append([])
                extra.append(len(tokenizer(name).encode(x, add_special_tokens=False).ids))
            elif split is not None and (parts := split.split(x))[1:]:
                lists.append([p for part in parts[::2] for p in pattern.findall(part)])
                extra.append(len(parts) // 2)
            else:
                lists.append(pattern.findall(x))
                extra.append(0)
        get = pieces.learn(lists).__getitem__
        out += [n + sum(map(get, found)) for n, found in zip(extra, lists)]
    return out


def _batch(cols: dict, name: str, limit: int) -> dict:
    n = count_tokens(cols["text"], name)
    return {"doc_id": cols["doc_id"], "n_bytes": [len((x or "").encode()) for x in cols["text"]], "n_tokens": n,
            "over_limit": [k > limit for k in n]}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    return map_rows(id_text(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", _batch,
                    vocabulary, limit)
