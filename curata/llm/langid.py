"""Operator 5, language identification by a byte convolutional network.

A text's UTF-8 bytes are read in windows of ``WINDOW`` (the last one ends with
the text; a short text is padded with zeros).  Filters of several widths run over a window's bytes, each
filter's greatest response is kept (max pooling, ReLU), and a softmax layer gives
the languages' probabilities; a text's are the mean over its windows.  The network is
trained in numpy by Adam on windows of a bounded sample of labelled rows.

A filter over bytes is a sum of table look-ups, one per place in the filter.  For whole tables the
look-ups of neighbouring places are joined into tables over byte pairs, which
give the same sums with half the look-ups.

Null texts and texts without any letter are ``und`` with score 0; so is every
text where no row has both a text and a language to learn from.  Rows with a null id are never learnt from.  Repeated
rows repeat their result; an empty table gives an empty result.  Predictions see the text
alone.  A few hundred windows are in memory at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, map_rows

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
#: Labelled documents of each language that are learnt from, in expectation
#: (chosen by a hash of id and text), and whole windows of each, evenly over the text (two short ones come on top).
PER_LANGUAGE, WINDOWS_EACH = 600, 3
#: Score under which a text's other languages together are as likely as its own.
MAJORITY = 0.5
EPOCHS, BATCH, RATE = 12, 64, 0.01
LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts that lie at ``bounds[i]:bounds[i + 1]`` of ``data``, and the text of each."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-size // WINDOW))
    owner = np.repeat(np.arange(len(size)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(nth * WINDOW, np.maximum(size[owner] - WINDOW, 0))
    at = (bounds[owner] + start)[:, None] + np.arange(WINDOW)
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(at.shape, np.uint8)
    out[at >= bounds[owner + 1][:, None]] = 0
    return out, owner


class Network:
    """tables[w][k]: what byte b at place k of a filter of width w adds, by filter."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter in each window, and where."""
        best, where = [], []
        for w, t in self.tables.items():
            r = sum(t[k][x[:, k:WINDOW - w + 1 + k]] for k in range(w))
            p = r.argmax(1)
            where.append(p)
            best.append(np.take_along_axis(r, p[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        weight = len(y) / (len(self.languages) * np.bincount(y, minlength=len(self.languages)))
        parts = [*self.tables.values(), self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                own = order[at:at + BATCH]
                xb, yb = x[own], y[own]
                z, where = self.pooled(xb)
                h = np.maximum(z, 0)
                p = softmax(h @ self.out + self.bias)
                p[np.arange(len(yb)), yb] -= 1
                p *= (weight[yb] / len(yb))[:, None].astype(np.float32)
                dz = (p @ self.out.T) * (z > 0)
                grads = []
                for i, (w, t) in enumerate(self.tables.items()):
                    g, d = np.zeros_like(t), dz[:, i * FILTERS:(i + 1) * FILTERS]
                    rows, cols = np.arange(len(xb))[:, None], np.arange(FILTERS)[None]
                    for k in range(w):
                        np.add.at(g[k], (xb[rows, where[i] + k], np.broadcast_to(cols, d.shape)), d)
                    grads.append(g)
                grads += [h.T @ p + 1e-3 * self.out, p.sum(0)]
                step += 1
                for q, g, m, v in zip(parts, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def pair_tables(self) -> list[list[tuple[int, np.ndarray, bool]]]:
        """For each width: (place, table, over pairs) whose sum is the filter."""
        out = []
        for w, t in self.tables.items():
            own = []
            for k in range(0, w - 1, 2):
                own.append((k, (t[k][None, :, :] + t[k + 1][:, None, :]).reshape(65_536, FILTERS), True))  # low byte first
            if w % 2:
                own.append((w - 1, t[w - 1], False))
            out.append(own)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(net: Network, tables: list, x: np.ndarray, block: int = 64) -> np.ndarray:
    """Softmax of every window of ``x``."""
    out = []
    for at in range(0, len(x), block):
        xb = x[at:at + block]
        one = xb.astype(np.intp)
        two = one[:, :-1] + (one[:, 1:] << 8)
        pooled = []
        for w, own in zip(WIDTHS, tables):
            n, r = WINDOW - w + 1, None
            for k, t, pairs in own:
                part = t.take((two if pairs else one)[:, k:k + n], axis=0)
                r = part if r is None else np.add(r, part, out=r)
            pooled.append(r.max(1))
        out.append(softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.bias))
    return np.concatenate(out) if out else np.empty((0, len(net.languages)), np.float32)


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return lang, score
    tables = net.__dict__.setdefault("_pairs", net.pair_tables())
    rows = [i for i, x in enumerate(texts) if x and LETTER.search(x)]
    at = 0
    while at < len(rows):
        own, size = [], 0
        while at < len(rows) and (not own or size < 1 << 20):
            own.append((rows[at], texts[rows[at]].encode()))
            size += len(own[-1][1])
            at += 1
        data = np.frombuffer(b"".join(b for _, b in own), np.uint8)
        x, owner = windows(data, np.cumsum([0, *[len(b) for _, b in own]]))
        p = probabilities(net, tables, x)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        mean = np.add.reduceat(p, starts, axis=0) / np.diff(np.append(starts, len(owner)))[:, None]
        for (i, _), q in zip(own, mean):
            lang[i], score[i] = net.languages[int(q.argmax())], float(min(1.0, q.max()))
    return lang, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(cols: dict, each: int) -> dict:
    texts, langs = [], []
    for text, lang in zip(cols["text"], cols["lang"]):
        raw = text.encode()
        x, _ = windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for k in np.unique(np.linspace(0, len(x) - 1, each).astype(int)):
            texts.append(x[k].tobytes())
            langs.append(lang)
        for k in range(2):  # short texts are padded: learn from short ones too
            size = 24 + zlib.crc32(raw, k) % 104
            at = zlib.crc32(raw, k + 7) % max(1, len(raw) - size)
            texts.append(raw[at:at + size].ljust(WINDOW, b"\0"))
            langs.append(lang)
    return {"lang": langs, "bytes": texts}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, each: int = WINDOWS_EACH) -> Network | None:
    """Learn from ``each`` windows of about ``per_language`` rows of every
    language, out of the rows that are not held out.  A row is taken by a hash of its id and text against
    the language's rate, and rows equal in both are one, so an id or text that stands often does not fill the sample."""
    rows = (id_text(docs, "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
            .filter(~held_out(F.col("doc_id"))))
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not n:
        return None
    rate = F.create_map(*[F.lit(x) for lang in sorted(n) for x in (lang, min(1.0, per_language / n[lang]))])
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(drawn < F.element_at(rate, F.col("lang"))).dropDuplicates(["doc_id", "text", "lang"])
    got = map_rows(sample, "lang string, bytes binary", _sample, each).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.bytes)))
    languages = sorted({r.lang for r in got})
    x = np.frombuffer(b"".join(bytes(r.bytes) for r in got), np.uint8).reshape(len(got), WINDOW)
    return Network(languages).fit(x, np.array([languages.index(r.lang) for r in got]))


def _predict(cols: dict, net) -> dict:
    lang, score = predict(net.value, cols["text"])
    return {"doc_id": cols["doc_id"], "lang_pred": lang, "score": score}


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the network is
    trained on ``docs`` unless one is given.  The network (under 200 KB) is broadcast."""
    net = net or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    found = map_rows(id_text(docs), "doc_id long, lang_pred string, score double", _predict, shared)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _identified(batch: pa.RecordBatch, net, least: float) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    if net.value is None:  # nothing to learn from: only texts without a letter are known to have no language
        return batch.filter(pa.array([bool(x and LETTER.search(x)) for x in texts], pa.bool_()))
    lang, score = predict(net.value, texts)
    return batch.filter(pa.array([k != "und" and s >= least for k, s in zip(lang, score)], pa.bool_()))


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has an identified language
    (with a score of ``least`` or more, if a caller asks for one); ``und`` rows go.  Where no row can be learnt from,
    every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return map_batches(docs, _identified, shared, least)
