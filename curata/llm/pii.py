"""Operator 4, personal data by weak supervision.

One pass over the whole texts finds the base spans (email, ip, card, phone) and
looser candidates that the base rules miss (numbers without a country code,
spelled-out addresses, social security and account numbers).  Four labelers
vote on every span -- ``rule`` (format and check digits), ``gazetteer`` (top-level
domains, issuer and reserved ranges), ``context`` (cue words before the span)
and ``shape`` (what it touches, repeated digits).  Their votes are counted over
all spans of the corpus (at most kinds x 3^4 x shapes rows come to the driver),
expectation-maximisation estimates how far each labeler can be trusted per kind,
and a logistic span classifier is trained on the resulting soft labels.  Base
spans stay whatever it says; a candidate is kept when its probability reaches
``threshold`` and no base span overlaps it.

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
repeated rows repeat their result; an empty table gives an empty result; only
the id and the text are read.  Matching is linear in the text: no pattern here
is retried from inside a run it has already read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, staged

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["ssn", "iban", "handle"]
ORDER = KINDS + EXTRA
LABELERS = ["rule", "gazetteer", "context", "shape"]

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates that the base rules do not give.
LOOSE = {
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "handle": re.compile(r"(?<![0-9A-Za-z])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63})+"),
}

#: Fixed values of the gazetteer and of the context labeler.
DOMAINS_TOP = set("com org net edu gov mil int info biz io co de fr es uk us it nl pt pl ru cn jp br in ca au ch at be se no".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38", "22", "23", "24", "25", "26", "27")
RESERVED = {"0", "10", "127", "255"}
CUES = {
    "email": "mail email e-mail contact write reach".split(),
    "handle": "mail email e-mail contact write reach".split(),
    "ip": "ip host server address from login client".split(),
    "card": "card visa mastercard amex credit debit pay".split(),
    "phone": "phone tel telephone call mobile cell fax contact".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account bank".split(),
}
AGAINST = "version release isbn issn order invoice item sku serial chapter section figure table page price".split()
CONTEXT = 32
WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(s: str) -> bool:
    """Length and check digits (mod 97)."""
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, a: int, b: int) -> int:
    """Where the account number in a match ends: capitals after it may look like
    another group.  The longest end at a space with right check digits, else the match's."""
    ends = [b] + [i for i in range(b - 1, a, -1) if text[i] == " "]
    return next((e for e in ends if iban(text[a:e])), b)


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one ``@``: the run of local characters before it, as far
    as the last match or ``@``, and a dotted domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    numbers = re.search("[0-9]", text)
    if numbers is None:
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser matches that no base span overlaps; of overlapping ones the first kind stays."""
    taken, out, found = [(a, b) for _, a, b in base], [], []
    if re.search("[0-9]", text):
        found += [(k, m.start(), m.end()) for k in ("ssn", "phone") for m in LOOSE[k].finditer(text)]
        found += [("iban", m.start(), iban_end(text, *m.span())) for m in LOOSE["iban"].finditer(text)]
    if "at]" in text or "at)" in text:
        found += [("handle", m.start(), m.end()) for m in LOOSE["handle"].finditer(text)]
    for kind in dict.fromkeys(k for k, _, _ in found):  # the matches of one kind do not overlap each other
        taken.sort()
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for k, a, b in found:
            before = bisect_left(starts, b) if k == kind else 0
            if k == kind and not (before and reach[before - 1] > a):
                taken.append((a, b))
                out.append((k, a, b))
    return out


def votes(text: str, kind: str, a: int, b: int, base: bool) -> list[int]:
    """One vote of each labeler: 1 personal, -1 not, 0 abstains."""
    s, d = text[a:b], digits_of(text[a:b])
    rule = 1 if base else {"phone": 7 <= len(d) <= 15, "ssn": d[:3] not in ("000", "666") and d[:1] != "9",
                           "iban": kind == "iban" and iban(s), "handle": True}[kind] * 2 - 1
    if kind in ("email", "handle"):
        top = re.split(r"[^A-Za-z0-9-]+", s.strip(".])"))[-1].lower()
        gazetteer = 1 if top in DOMAINS_TOP else 0
    elif kind == "ip":
        gazetteer = -1 if s.split(".")[0] in RESERVED else 1
    elif kind == "card":
        gazetteer = 1 if d.startswith(ISSUERS) else 0
    elif kind == "phone":
        gazetteer = 1 if s.startswith("+") and d[:1] != "0" else 0
    else:
        gazetteer = 0
    before = set(WORD.findall(text[max(0, a - CONTEXT):a].lower()))
    context = 1 if before.intersection(CUES[kind]) else -1 if before.intersection(AGAINST) else 0
    touching = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    shape = -1 if touching or (d and len(set(d)) == 1) else 1
    return [rule, gazetteer, context, shape]


def size_class(a: int, b: int) -> int:
    return min(4, (b - a) // 8)


def _find(cols: dict) -> dict:
    out = []
    for text in cols["text"]:
        text = text or ""
        base = base_spans(text)
        spans = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in candidates(text, base)]
        out.append([{"kind": k, "start": a, "end": b, "base": own, "votes": votes(text, k, a, b, own), "size": size_class(a, b)}
                    for k, a, b, own in spans])
    return {"doc_id": cols["doc_id"], "spans": out}


SPANS = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>,size:int>>"


def reliabilities(kinds: list[str], vote: np.ndarray, n: np.ndarray, rounds: int = 50):
    """Expectation-maximisation over vote patterns (rows) with counts ``n``:
    per kind the prior and, per labeler, P(vote | class).  Labelers that agree
    with the others get weight; the start is a majority vote.  Returns the
    posterior of each pattern and the tables."""
    post = np.clip(0.5 + 0.2 * vote.sum(1), 0.05, 0.95)
    tables = {}
    for kind in sorted(set(kinds)):
        rows = np.array([k == kind for k in kinds])
        v, w, p = vote[rows] + 1, n[rows].astype(float), post[rows]
        for _ in range(rounds):
            prior = (w @ p + 1) / (w.sum() + 2)
            given = np.empty((2, v.shape[1], 3))
            for c, q in ((1, p), (0, 1 - p)):
                for j in range(v.shape[1]):
                    # pseudo-counts: a labeler is taken to be right more often than not
                    given[c, j] = np.bincount(v[:, j], weights=w * q, minlength=3) + ([1, 2, 4] if c else [4, 2, 1])
                given[c] /= given[c].sum(1, keepdims=True)
            logs = np.log(given[:, np.arange(v.shape[1]), v]).sum(2) + np.log([[1 - prior], [prior]])
            p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        post[rows], tables[kind] = p, (prior, given)
    return post, tables


def features(kind: list[str], vote: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Kind, each labeler's vote and the size class, one-hot, with a constant."""
    k = np.array([[x == y for y in ORDER] for x in kind], float).reshape(len(kind), len(ORDER))
    v = np.stack([vote == x for x in (-1, 0, 1)], 2).reshape(len(kind), -1).astype(float)
    z = (np.asarray(size)[:, None] == np.arange(5)).astype(float)
    return np.hstack([k, v, z, np.ones((len(kind), 1))])


def train(kind: list[str], vote: np.ndarray, size: np.ndarray, n: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the span classifier: logistic regression by gradient descent
    on EM's soft labels, every pattern weighted by the logarithm of its count."""
    if not len(n):
        return np.zeros(len(ORDER) + 3 * len(LABELERS) + 6)
    soft, _ = reliabilities(kind, vote, n)
    x, w = features(kind, vote, size), np.log1p(n.astype(float))
    w, b = w / w.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        b -= 2.0 * (x.T @ (w * (1 / (1 + np.exp(-(x @ b))) - soft)) + 1e-3 * b)
    return b


def _keep(cols: dict, weights: list[float], threshold: float) -> dict:
    w, out = np.array(weights), []
    for spans in cols["spans"]:
        p = []
        if spans:
            x = features([s["kind"] for s in spans], np.array([s["votes"] for s in spans]), np.array([s["size"] for s in spans]))
            p = (1 / (1 + np.exp(-(x @ w)))).tolist()
        kept = [{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["base"], "score": q}
                for s, q in zip(spans, p) if s["base"] or q >= threshold]
        out.append(sorted(kept, key=lambda s: (ORDER.index(s["kind"]), s["start"])))
    return {"doc_id": cols["doc_id"], "spans": out}


def personal_data(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base, score), by kind as in
    ``ORDER``, then start."""
    found = staged(map_rows(id_text(docs), SPANS, _find), "pii-candidates")
    seen = (found.select(F.explode("spans").alias("s"))
            .groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.size").alias("size"))
            .agg(F.count("*").alias("n")).collect())  # at most len(ORDER) * 3^4 * 5 rows
    seen = sorted(seen, key=lambda r: (r.kind, r.votes, r.size))
    weights = train([r.kind for r in seen], np.array([r.votes for r in seen]).reshape(len(seen), len(LABELERS)),
                    np.array([r["size"] for r in seen]), np.array([r.n for r in seen]))
    return map_rows(found, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>",
                    _keep, weights.tolist(), threshold)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
