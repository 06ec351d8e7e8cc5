"""Learnt language identification: counts, likelihoods, margin, edge rows, held-out accuracy."""

import math
from collections import Counter

from curata.operators import language_model as LM

SF = "/root/testdata/sf0.01"
EN, DE = "the cat and the dog were in the house with us", "der hund und die katze waren mit uns in dem haus"


def learnt(spark):
    return LM.fit(spark.createDataFrame([(EN, "en"), (DE, "de"), (None, "en"), ("x", None), ("12 34", "fr")], "text string, lang string"))


def test_table_is_the_smoothed_likelihood(spark):
    model = learnt(spark)
    assert model.languages == ("de", "en")  # a text without letters teaches nothing
    data = f" {EN} ".encode()
    n = Counter(zip(data, data[1:]))
    for (a, b), c in n.items():
        assert math.isclose(model.table[a << 8 | b, 1], math.log((c + 1) / (sum(n.values()) + LM.PAIRS)))
    assert model.table.shape == (65_536, 2)


def test_margin_and_edge_rows(spark):
    model = learnt(spark)
    data = [(1, "The DOG, the cat!"), (2, "Der Hund; die Katze"), (3, None), (4, ""), (5, "12 !!"), (6, "zzzz"), (1, "The DOG, the cat!"), (7, "the " * 2_000_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "id int, text string, margin string")
    rows = sorted((r.id, r.language, r.lead) for r in LM.with_language(df, model, margin="lead").collect())
    by = {r[0]: r for r in rows}
    assert len(rows) == len(data) and by[1][1] == "en" and by[2][1] == "de" and by[7][1] == "en"
    assert all(by[i][1:] == ("unknown", None) for i in (3, 4, 5)) and by[1][2] > 0.1 > by[6][2] >= 0
    sure = LM.filter_learned_language(df, model, "text", "en", min_margin=0.1)
    assert sorted(r.id for r in sure.collect()) == [1, 1, 7] and sure.columns == df.columns
    nothing = LM.fit(df.limit(0).selectExpr("text", "text AS lang"))
    assert {r.language for r in LM.with_language(df, nothing).collect()} == {"unknown"}
    assert LM.with_language(df.limit(0), model).count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(map(tuple, LM.count_pairs(docs.repartition(k)).collect())) for k in (1, 7))
    assert one == many


def test_held_out_accuracy(spark):
    from curata.plans import catalog
    rows = catalog.q_learned_language_accuracy(spark, SF).collect()
    assert sum(r.n_right for r in rows) >= 0.99 * sum(r.n for r in rows) and sum(r.n for r in rows) > 200


def test_long_texts_are_scored_in_pieces():
    """The memory of a score does not grow with the text; the pairs at the pieces' borders count once."""
    import tracemalloc

    import numpy as np
    table = np.log(np.random.default_rng(3).random((LM.PAIRS, 5)))
    model = LM.LanguageModel(tuple("abcde"), table)
    texts = [np.random.default_rng(4).integers(0, 256, n).astype(np.uint8).tobytes() for n in (3_000_000, 2, LM.BLOCK, LM.BLOCK + 1, LM.BLOCK + 2, 50)]
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for x, own in zip(texts, got):
        data = np.frombuffer(x, np.uint8).astype(int)
        assert np.allclose(table[data[:-1] * 256 + data[1:]].mean(0), own)
    assert peak < 60 << 20
