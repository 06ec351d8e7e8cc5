"""TF-IDF encoder and vector index: plain sums, full scans, pruned cells, edge rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import encoder as E
from curata.operators import ordering as G
from curata.operators import relevance as S
from curata.operators import vector_index as V

TEXTS = [(1, "The cat sat. The cat ran"), (2, "a dog ran <b>home</b>"), (3, None), (4, "... 12"), (5, "cat"), (6, "Café cafe")]


def plain(texts):
    def words(t):
        return [w for w in re.split(r"[\W\d_]+", re.sub("<[^>]+>", " ", (t or "").lower()).replace("é", "e")) if w]
    tf = {i: Counter(words(t)) for i, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    return {i: {w: n * idf[w] for w, n in c.items()} for i, c in tf.items()}, idf


def cosine(a, b):
    dot = sum(v * b.get(w, 0) for w, v in a.items())
    n = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return dot / n if n else 0.0


@pytest.mark.parametrize("frequent", [0, 2, 50_000])
def test_weights_and_relevance(spark, monkeypatch, frequent):
    monkeypatch.setattr(E, "FREQUENT", frequent)
    docs = spark.createDataFrame([(*t, "clash") for t in TEXTS], "ord long, text string, term string")
    stats = E.fit(docs)
    vectors, idf = plain(TEXTS)
    assert {r.term: round(r.idf, 9) for r in stats.collect()} == {w: round(v, 9) for w, v in idf.items()}
    got = {(r.ord, r.term): r.weight for r in E.term_weights(docs, "ord", "text", stats, frequent).collect()}
    assert got.keys() == {(i, w) for i, v in vectors.items() for w in v} and all(math.isclose(x, vectors[i][w]) for (i, w), x in got.items())
    about = spark.createDataFrame([("the cat",), ("a dog at home",), ("unheard words",)], "text string")
    want = {i: sum(cosine(v, {w: idf[w] for w in q.split() if w in idf}) for q in ("the cat", "a dog at home")) / 3 for i, v in vectors.items()}
    found = {r.ord: r.semantic_score for r in E.tfidf_relevance(docs, about, stats, 0.0).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[i], want[i], abs_tol=1e-9) for i in want)
    assert {r.ord for r in E.tfidf_relevance(docs, about, stats, 0.2).collect()} == {i for i, x in want.items() if x >= 0.2}


def test_repeated_keys_are_counted_together(spark):
    texts = [*TEXTS, (1, "cat cat dog"), (None, "a dog"), (None, "dog, dog"), (7, "<i>Über</i>-cat42x"), (5, None)]
    docs = spark.createDataFrame(texts, "ord long, text string")
    stats = E.fit(docs)
    holding = Counter(w for _, t in texts for w in plain([(0, (t or "").replace("Ü", "u"))])[0][0])
    assert {r.term: r.df for r in stats.collect()} == holding
    for some in (docs, docs.filter("ord > 1 AND ord <> 5")):  # with and without repeated keys
        want = Counter()
        for r in some.collect():
            for w, n in Counter(x for x in re.split(r"[\W\d_]+", re.sub("<[^>]+>", " ", (r.text or "").lower()).translate(str.maketrans("éü", "eu"))) if x).items():
                want[r.ord, w] += n
        for frequent in (0, 50_000):
            assert {(r.ord, r.term): r.tf for r in E.term_weights(some, "ord", "text", stats, frequent).collect()} == dict(want)


def test_words_of_a_text_are_counted_where_it_lies(spark):
    docs = spark.createDataFrame(TEXTS, "ord long, text string")
    counts = E.word_counts(docs, "ord")
    plan = E.term_weights(docs, "ord", "text", E.fit(docs, counts=counts), counts=counts)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord" not in plan and "Generate" not in plan and "MapInArrow" not in plan
    assert {(r.ord, r.term): r.tf for r in counts.collect()} == {(i, w): n for i, t in TEXTS for w, n in Counter(re.findall("[a-z]+", re.sub("<[^>]+>", " ", (t or "").lower()).replace("é", "e"))).items()}


def test_projection_estimates_the_cosine(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(150)
    E.save(E.fit(docs), str(tmp_path / "stats"))
    stats = E.load(spark, str(tmp_path / "stats"))
    coded = {r.doc_id: np.array(r.embedding) for r in E.encode(docs, stats, "doc_id", dim=1024).collect()}
    vectors, _ = plain([(r.doc_id, r.text) for r in docs.collect()])
    ids = [i for i in coded if vectors[i]][:60]
    off = [abs(float(coded[a] @ coded[b]) - cosine(vectors[a], vectors[b])) for a in ids for b in ids]
    assert len(coded) == 150 and max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_encode_edge_rows(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    stats = E.fit(docs)
    rows = {r.id: r.embedding for r in E.encode(docs, stats).collect()}
    assert all(len(v) == 128 for v in rows.values()) and not any(rows[3]) and not any(rows[4])
    assert math.isclose(sum(x * x for x in rows[1]), 1, abs_tol=1e-5)
    assert E.encode(docs.limit(0), stats).count() == 0 and E.fit(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        E.encode(docs, stats, dim=100)


def clustered(n=3000, groups=40, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, [float(x) for x in centres[i % groups] * 3 + rng.normal(size=dim) * 0.4]) for i in range(n)]


def test_index_equals_the_full_scan_and_reads_less(spark, tmp_path):
    rows = clustered()
    df = spark.createDataFrame([*rows, (-1, None), (-2, [0.0] * 24), (-3, rows[0][1]), (-4, rows[0][1])], "ord long, embedding array<double>")
    index = V.build(df, str(tmp_path / "ix"), key="ord", cells=40)
    again = V.open_index(spark, str(tmp_path / "ix"), key="ord")
    rng, read = np.random.default_rng(2), []
    full = df.cache()
    for q in [rows[k][1] for k in (0, 17)] + [list(rng.normal(size=24)), [-x for x in rows[5][1]]]:
        scored = S.semantic_scores(full, q).withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
        want = [(r.ord, round(r.semantic_score, 9)) for r in G.top_k(scored, "semantic_score", 25).collect()]
        found, cells = again.top_k(q, 25)
        assert [(r.ord, round(r.semantic_score, 9)) for r in found.collect()] == want
        read.append(len(cells))
        for t in (0.9, 0.3, -1.0):
            found, cells = index.above(q, t)
            assert sorted(r.ord for r in found.collect()) == sorted(r.ord for r in scored.filter(F.col("semantic_score") >= t).collect())
    assert max(read[:2]) <= 8 and sum(read) < 4 * len(index.cells) / 2
    found, cells = index.above(rows[0][1], 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(cells) < 8 and "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")
    full.unpersist()


def test_index_edge_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "ord long, embedding array<float>")
    index = V.build(empty, str(tmp_path / "a"), key="ord")
    assert len(index.cells) == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "ord long, embedding array<float>")
    index = V.build(zero, str(tmp_path / "b"), key="ord")
    found, _ = index.above([1.0, 0.0], -0.5)
    assert found.count() == 2
