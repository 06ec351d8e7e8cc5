import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from curata.operators import relevance as S
from curata.sources import tables


def test_centroid_equals_pairwise_mean(spark):
    e = tables.table(spark, SF_SMALL, "embeddings")
    seeds = e.filter(F.col("label") == 1)
    cand = e.filter(F.col("label") != 1)
    got = {r.vec_id: r.semantic_score for r in S.relevance_to_seeds(cand, seeds, -1.0).collect()}
    sv = np.array([np.array(r.embedding, dtype=float) for r in seeds.collect()])
    sv /= np.linalg.norm(sv, axis=1, keepdims=True)
    for r in cand.collect():
        v = np.array(r.embedding, dtype=float)
        want = float(np.mean(sv @ (v / np.linalg.norm(v))))
        assert abs(got[r.vec_id] - want) < 1e-9


def test_semantic_filter_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])],
                               "ord long, embedding array<float>")
    out = S.semantic_filter(df, [1.0, 0.0], 0.6)
    assert sorted(r.ord for r in out.collect()) == [1, 2]
    assert S.semantic_filter(df, [1.0, 0.0], 2.0).count() == 0


def test_encoder_counts_every_word(spark):
    """Words of one letter and of more than fifteen reach the vector; hand-computed cosines."""
    df = spark.createDataFrame([(1, "characterization characterization"), (2, "characterization"), (3, "x"), (4, "characterization x")], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in S.hashing_encoder(df, "text", dim=4096).collect()}
    assert abs(v[1] @ v[2] - 1) < 1e-6 and abs(v[2] @ v[3]) < 1e-6 and abs(v[4] @ v[2] - 0.5 ** 0.5) < 1e-6


def test_encoder_unit_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "")], "id long, text string")
    out = {r.id: r.embedding for r in S.hashing_encoder(df, "text", dim=16).collect()}
    assert abs(sum(x * x for x in out[1]) - 1.0) < 1e-5
    assert sum(abs(x) for x in out[2]) == 0.0
