"""Operator 7, a quality classifier by co-training.

Two views of a document: its *content* (hashed byte-pair frequencies of the whole
text) and its *page metadata* (source, declared language, length and
layout: lines, repeated lines, case, digits, marks).  A logistic classifier per view
is trained on a bounded sample of labelled documents; over ``ROUNDS`` each one labels
the documents of an unlabelled pool it is surest of, by class in the labels'
proportion, and these go to the *other* view's training set.  Both views are then
calibrated on labelled documents kept out of the training (a logistic fit
of the label on the view's margin), and the mean of their calibrated log-odds scores every document.

Null texts count as empty.  Null or unseen sources and languages share a
feature.  A document with several labels has their mean, ties count as good;
labels without a document, and null labels, are not used.  With no label of one class every score
is the share of good labels (0.5 without any).  Repeated rows repeat their score; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

#: Labelled documents learnt from, and a pool of unlabelled ones, in expectation; chosen by a hash.  The pool is a sample of the
#: unlabelled rows: every document is scored, but only these exchange pseudo-labels.
LABELLED, POOL = 6000, 6000
#: Labelled documents kept for the calibration: those whose hash falls in this share.
CALIBRATION = 0.3
ROUNDS, PER_ROUND = 6, 0.04
CONTENT, NAMES = 512, 24


def content_view(text: str) -> np.ndarray:
    """Frequencies of hashed byte pairs, as square roots (they sum to 1 before)."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 2:
        return np.zeros(CONTENT, np.float32)
    pairs = ((b[:-1] << 8 | b[1:]) * np.uint32(2_654_435_761)) >> np.uint32(32 - CONTENT.bit_length() + 1)
    return np.sqrt(np.bincount(pairs, minlength=CONTENT) / len(pairs)).astype(np.float32)


def metadata_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Source and language by hash, length and layout."""
    out = np.zeros(2 * NAMES + 10, np.float32)
    for k, name in enumerate((source, lang)):
        out[k * NAMES + (zlib.crc32(name.encode()) % (NAMES - 1) + 1 if name else 0)] = 1
    n = len(text)
    if n:
        lines = text.split("\n")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = points[points < 128]
        kinds = np.bincount(KIND[low], minlength=5) / n
        out[2 * NAMES:] = (np.log1p(n) / 10, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 8,
                           1 - len(set(lines)) / len(lines), *kinds[:5], 1 - len(low) / n)
    return out


#: Kinds of ASCII: marks, upper case, lower case, digits, white space.
KIND = np.array([1 if chr(c).isupper() else 2 if chr(c).islower() else 3 if chr(c).isdigit() else 4 if chr(c).isspace() else 0
                 for c in range(128)])


class Logistic:
    """Logistic regression on standardised features, by full gradient with momentum."""

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        good = y.mean()
        weight = np.where(y > 0.5, 0.5 / max(good, 1e-6), 0.5 / max(1 - good, 1e-6)) / len(y)
        self.w, self.b, vw, vb = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
        rate = rate * 20 / x.shape[1] ** 0.5
        for _ in range(steps):
            g = weight * (1 / (1 + np.exp(-np.clip(z @ self.w + self.b, -50, 50))) - y)
            vw, vb = 0.8 * vw + z.T @ g + decay * self.w, 0.8 * vb + g.sum()
            self.w, self.b = self.w - rate * 0.2 * vw, self.b - rate * 0.2 * vb
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w + self.b


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the margin the log-odds of the label (Newton's method)."""
    a, b = 1.0, 0.0
    x = np.column_stack([margin, np.ones(len(margin))])
    prior = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # soft targets
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, x.T @ (p - prior))
    return float(max(a, 0.0)), float(b)


class CoTrained:
    """Both views' classifiers with their calibration."""

    def __init__(self, views, fits):
        self.views, self.fits = views, fits

    def odds(self, x: list[np.ndarray]) -> list[np.ndarray]:
        return [a * v.margin(z) + b for v, (a, b), z in zip(self.views, self.fits, x)]


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, share: float = PER_ROUND):
    """Train one classifier per view; in each round the surest of the pool, by
    one view, go to the other's training set."""
    sets = [(x[k], y) for k in (0, 1)]
    left = np.arange(len(pool[0]))
    good = y.mean()
    for _ in range(rounds):
        views = [Logistic().fit(*s) for s in sets]
        taken: list[np.ndarray] = []
        for k, v in enumerate(views):
            free = np.setdiff1d(left, np.concatenate(taken)) if taken else left
            n = max(1, int(share * len(pool[0])))
            up, down = min(len(free), max(1, round(n * good))), min(len(free), max(1, round(n * (1 - good))))
            if up + down > len(free):
                break
            m = v.margin(pool[k][free])
            order = np.argsort(m, kind="stable")
            order = order[np.r_[0:down, len(order) - up:len(order)]]
            sure = (m[order] > 0) == (np.arange(len(order)) >= down)  # of the class it would be labelled with
            own, label = free[order[sure]], (np.arange(len(order)) >= down)[sure].astype(float)
            sets[1 - k] = (np.concatenate([sets[1 - k][0], pool[1 - k][own]]), np.concatenate([sets[1 - k][1], label]))
            taken.append(own)
        left = np.setdiff1d(left, np.concatenate(taken)) if taken else left
    return [Logistic().fit(*s) for s in sets]


def _features(cols: dict) -> dict:
    texts = [t or "" for t in cols["text"]]
    return {"doc_id": cols["doc_id"], "content": [content_view(t).tolist() for t in texts],
            "page": [metadata_view(t, s, g).tolist() for t, s, g in zip(texts, cols["source"], cols["lang"])]}


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | float:
    """The two calibrated views, or the share of good labels where there is
    nothing to separate.  The sample's ids (bounded by ``labelled`` + ``pool``) are
    sent to the documents; texts are not shuffled."""
    spark = docs.sparkSession
    drawn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
           .dropna().groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("y")))
    size = own.agg(F.count("*").alias("n"), F.avg("y").alias("good")).first()
    if not size.n or size.good in (0.0, 1.0):
        return 0.5 if not size.n else float(size.good)
    chosen = own.filter(drawn < min(1.0, labelled / size.n)).collect()  # about `labelled` rows of two numbers
    total = docs.count()
    known = spark.createDataFrame([(r.doc_id, r.y) for r in chosen] or [(None, None)], "id long, y int")
    rows = id_text(docs, "source", "lang").join(F.broadcast(known), F.col("doc_id") == F.col("id"), "left")
    by_row = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    free = (rows.filter(F.col("y").isNull() & (by_row > 1 - min(1.0, pool / max(total, 1)))).dropDuplicates(["doc_id", "text"])
            .select("doc_id", "text", "source", "lang"))
    # one row of each labelled id, however many bear it
    one = rows.filter(F.col("y").isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct("text", "source", "lang"), F.xxhash64("text", "source", "lang")).alias("d"))
    sample = free.unionByName(one.select("doc_id", "d.text", "d.source", "d.lang"))
    got = map_rows(sample, "doc_id long, content array<float>, page array<float>", _features).collect()
    if not got:
        return float(size.good)
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.content))
    y_of = {r.doc_id: r.y for r in chosen}
    x = [np.array([r[k] for r in got], float).reshape(len(got), -1) for k in ("content", "page")]
    y = np.array([y_of.get(r.doc_id, -1) for r in got])
    kept = np.array([zlib.crc32(b"calibrate%d" % (r.doc_id or 0)) % 1000 < 1000 * CALIBRATION for r in got], bool)
    learn, check, free = (y >= 0) & ~kept, (y >= 0) & kept, y < 0
    if len(set(y[learn])) < 2:
        return float(size.good)
    if len(set(y[check])) < 2:
        check = learn
    views = co_train([v[learn] for v in x], y[learn].astype(float), [v[free] for v in x])
    return CoTrained(views, [calibration(v.margin(z[check]), y[check].astype(float)) for v, z in zip(views, x)])


def _score(cols: dict, shared) -> dict:
    model = shared.value
    n = len(cols["text"])
    out = {"doc_id": cols["doc_id"]}
    if isinstance(model, float):
        return out | {"content_score": [model] * n, "page_score": [model] * n, "score": [model] * n}
    texts = [t or "" for t in cols["text"]]
    x = [np.array([content_view(t) for t in texts], float),
         np.array([metadata_view(t, s, g) for t, s, g in zip(texts, cols["source"], cols["lang"])], float)]
    odds = [np.clip(o, -30, 30) for o in model.odds(x)]
    p = [1 / (1 + np.exp(-o)) for o in (*odds, (odds[0] + odds[1]) / 2)]
    return out | {k: v.tolist() for k, v in zip(("content_score", "page_score", "score"), p)}


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, content_score, page_score, score (probability of quality 1) and
    ``good`` (score reaches ``threshold``) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    found = map_rows(id_text(docs, "source", "lang"), "doc_id long, content_score double, page_score double, score double", _score, shared)
    return found.withColumn("good", F.col("score") >= threshold)
