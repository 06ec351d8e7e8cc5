"""Language network and quality co-training: accuracy on rows that were not learnt from, edge rows."""

import zlib

import numpy as np

from curata.llm import catalog, langid, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = catalog.op5_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_pair_tables_give_the_filters_sums():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"])
    x = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    z, _ = net.pooled(x)
    plain = langid.softmax(np.maximum(z, 0) @ net.out + net.bias)
    assert np.allclose(langid.probabilities(net, net.pair_tables(), x), plain, atol=1e-4)


def test_windows_cover_every_byte():
    for size in (0, 1, 255, 256, 257, 700):
        data = np.arange(size) % 251 + 1
        x, owner = langid.windows(data.astype(np.uint8), np.array([0, size]))
        assert len(x) == max(1, -(-size // 256)) and not owner.any()
        assert set(x.ravel()) - {0} == set(data)


def test_language_edge_rows(spark):
    rows = [(i, "the cat and the dog " * 20, "en") for i in range(40)] + [(100 + i, "чёрный кот и белый пёс " * 20, "ru") for i in range(40)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 456 !?", None), (903, "the dog" * 60_000, None), (904, "кот", None), (None, "the", "en"), (0, "the cat", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, i): r for i, r in enumerate(langid.identify(df).collect())}
    pred = {k[0]: r.lang_pred for k, r in got.items()}
    assert len(got) == len(rows) and pred[900] == pred[901] == pred[902] == "und"
    assert pred[903] == "en" and pred[904] == "ru"
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = langid.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_quality_on_rows_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    scored = quality.score_quality(docs, labels.filter("doc_id % 4 <> 1")).collect()
    assert len(scored) == docs.count()
    out = [(r.score, y[r.doc_id]) for r in scored if r.doc_id in y and r.doc_id % 4 == 1]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.97


def test_quality_edge_rows(spark):
    rows = [(i, "plain words here. " * 9, "en", "s") for i in range(60)] + [(100 + i, "$$$ &&& !!! ### " * 9, "en", None) for i in range(60)]
    rows += [(900, None, None, None), (901, "", "xx", "new"), (902, "words " * 80_000, "en", "s"), (None, "x", "en", "s"), (1, "plain words here.", "en", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]] + [(5, None), (77777, 1), (None, 1), (6, 1)], "doc_id long, quality int")
    got = quality.score_quality(df, labels).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and min(score[50], score[902]) > 0.5 > score[150]
    assert quality.score_quality(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(df, labels.filter("quality = 1")).collect()} == {1.0}


def test_views_exchange_labels():
    rng = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], 400)
    a, b = y[:, None] * 2 + rng.normal(0, 0.9, (800, 3)), y[:, None] * 2 + rng.normal(0, 0.9, (800, 3))
    own = np.r_[0:6, 400:406]
    views = quality.co_train([a[own], b[own]], y[own], [a, b])
    assert all(((v.margin(x) > 0) == (y > 0.5)).mean() > 0.9 for v, x in zip(views, (a, b)))
