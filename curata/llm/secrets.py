"""Operator 9, secret scans by sliding-window entropy.

Base rules (assign, access, hex) run over the whole text.  Besides, every
maximal run of token characters of ``MIN_RUN`` or more is a candidate: its
character class decides the window's threshold, and the Shannon entropy of each
window of ``WINDOW`` characters is kept up by incremental counts (one character
enters, one leaves).  A candidate is reported as ``entropy`` where some window
reaches the threshold, unless the allow-list knows it (UUIDs, digests named as
such, paths, alphabets, plain words) or a base span covers it.  Base spans are never suppressed.

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
repeated rows repeat their result; an empty table gives an empty result; only
the id and the text are read.  Time is linear in the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_batches, map_rows
from .pii import digest

KINDS = ["assign", "access", "hex"]
ORDER = KINDS + ["entropy"]

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

MIN_RUN, WINDOW = 20, 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Bits per character of a window that make a run of this class a secret; the
#: most that a window of 20 can have is log2(20) = 4.32 (log2(16) = 4 in hex).
THRESHOLD = {"hex": 3.0, "alnum": 3.5, "base64": 3.7, "letters": 3.85, "digits": 2.85}
TERMS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAMED = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|commit|checksum|digest|etag)\W{0,3}$", re.I | re.A)
ALPHABETS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
WORDS = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4})")
#: Words of a run of letters in camel case, and how many letters they have on average at least.
CAMEL, CAMEL_LENGTH = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 3.5


def char_class(run: str) -> str:
    """digits, letters (signs between them aside), hex, alnum or base64."""
    if not any(c.isalpha() for c in run):
        return "digits"
    if not any(c.isdigit() for c in run):
        return "letters"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def peak_entropy(run: str) -> float:
    """The highest Shannon entropy, in bits, of the windows of ``run``."""
    counts: dict[str, int] = {}
    total = best = 0.0
    for i, c in enumerate(run):
        if i >= WINDOW:
            n = counts[old := run[i - WINDOW]]
            counts[old] = n - 1
            total += TERMS[n - 1] - TERMS[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += TERMS[n + 1] - TERMS[n]
        if i >= WINDOW - 1:
            best = max(best, math.log2(WINDOW) - total / WINDOW)
    return best


def allowed(text: str, a: int, b: int) -> bool:
    """The allow-list: strings that look random or long and are no secrets."""
    run = text[a:b]
    if UUID.fullmatch(run.strip("-_/")) or NAMED.search(text[max(0, a - 16):a]):
        return True
    if run.strip("=") in ALPHABETS or len(set(run)) < 6:
        return True
    parts = [p for p in re.split(r"[/_=+-]+", run) if p]
    if len(parts) > 1 and all(WORDS.fullmatch(p) for p in parts):
        return True
    if all(p.isalpha() for p in parts):  # words in one case, or joined in camel case: some letters between capitals
        words = [w for p in parts for w in CAMEL.findall(p)]
        return sum(map(len, words)) >= CAMEL_LENGTH * len(words)
    return False


def scan(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans by start, then kind as listed."""
    base = []
    if "=" in text or ":" in text:
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more, order = [], sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))
    for m in RUN.finditer(text):
        a, b = m.span()
        before = bisect_right(starts, a)
        if before and reach[before - 1] >= b:  # a base span covers it
            continue
        kind = char_class(m.group())
        if peak_entropy(m.group()) >= THRESHOLD[kind] and not allowed(text, a, b):
            more.append(("entropy", a, b))
    spans = [(*s, True) for s in base] + [(*s, False) for s in more]
    return sorted(spans, key=lambda s: (s[1], ORDER.index(s[0])))


def _batch(cols: dict) -> dict:
    return {"doc_id": cols["doc_id"],
            "spans": [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in scan(x or "")] for x in cols["text"]]}


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by start, then kind."""
    return map_rows(id_text(docs), "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", _batch)


def secret_digest(docs: DataFrame) -> DataFrame:
    return digest(find_secrets(docs), KINDS)


MASK = "[SECRET]"


def masked(text: str | None) -> str | None:
    """The text with every span, and what overlaps it, replaced by one mask."""
    if not text:
        return text
    out, at, open_at = [], 0, None
    for a, b in sorted((a, b) for _, a, b, _ in scan(text)):
        if open_at is not None and a < at:  # overlaps the one before
            at = max(at, b)
            continue
        out += [text[at:a], MASK]
        open_at, at = a, b
    return "".join([*out, text[at:]])


def _mask(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [masked(x) for x in batch.column("text").to_pylist()]
    new = {"text": texts, "n_chars": [None if x is None else len(x) for x in texts]}
    return pa.RecordBatch.from_arrays(
        [pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the spans masked in ``text`` and
    ``n_chars`` (where there is one) counted anew."""
    return map_batches(docs, _mask)
