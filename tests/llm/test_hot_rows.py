"""Equal rows, rows without an id and repeated ids do not gather in one task or fill a sample."""

from collections import Counter

from pyspark.sql import functions as F

from curata.llm import langid, merkle, quality, sharding


def test_equal_rows_are_dealt_over_sources(spark, monkeypatch):
    kept = {}
    whole = sharding.staged

    def staged(df, name):
        kept[name] = whole(df, name)
        return kept[name]

    monkeypatch.setattr(sharding, "staged", staged)
    df = spark.range(6000).selectExpr("7L AS doc_id", "'same text' AS text")
    rows = sharding.shard_rows(df).collect()
    sent = kept["shard-sent"]
    assert max(r["count"] for r in sent.groupBy("shard", "block").count().collect()) < 60
    assert sorted(Counter(r.shard for r in rows).values()) == [375] * 16
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(375)) for s in range(16))


def test_rows_without_an_id_lie_in_many_ranges(spark):
    texts = [f"text number {i} of the rows without an id. " * 3 for i in range(300)]
    data = [(None, t) for t in texts] + [(i, f"document {i}. " * 4) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = merkle.against_neighbours(df)
    assert rows.count() == len(data)
    order = [r.text for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    want = Counter()
    for own, after in zip(order, order[1:] + order[:1]):
        half = len(own) // 2
        want[merkle.fingerprint(own), merkle.fingerprint(own[:len(own) - half] + after[:half])] += 1
    assert Counter((r.fingerprint, r.edited_fingerprint) for r in rows.collect()) == want
    plan = [r for r in df.filter("doc_id IS NULL").select((F.shiftright(F.xxhash64("text"), 58)).alias("r")).groupBy("r").count().collect()]
    assert max(r["count"] for r in plan) < 30


def test_a_repeated_id_does_not_fill_the_samples(spark, monkeypatch):
    seen = []
    whole = langid.map_rows

    def counted(df, *args, **kwargs):
        seen.append(df.count())
        return whole(df, *args, **kwargs)

    monkeypatch.setattr(langid, "map_rows", counted)
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "s")] * 4000 + [(3, f"der hund {i} lief in das haus", "de", "s") for i in range(2000)],
                                 "doc_id long, text string, lang string, source string")
    assert langid.train(docs, per_language=50) is not None and seen[-1] < 150
    monkeypatch.setattr(quality, "map_rows", counted)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert seen[-1] <= 2
