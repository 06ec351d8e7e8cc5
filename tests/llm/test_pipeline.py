"""The pipeline's stages against plain versions, on the given tables and on edge rows."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from curata.llm import decontaminate as D, langid, packing, secrets
from curata.llm.common import staged

from .test_decontaminate import plain as plain_overlaps
from .test_jaccard import plain_groups
from .test_packing_sharding import check_sequences

SF = "/root/testdata/sf0.01"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]

    df = staged(stages["language"](spark, docs, SF), "t")
    net = langid.train(docs)
    lang, _ = langid.predict(net, [r.text for r in rows.values()])
    rows = {d: r for (d, r), k in zip(rows.items(), lang) if k != "und"}
    assert df.columns == columns and sorted(df.collect()) == sorted(rows.values())

    df = staged(stages["near_duplicates"](spark, df, SF), "t")
    groups = plain_groups([(d, r.text) for d, r in rows.items()])
    rows = {d: rows[d] for d, _, c in groups if d == c}
    assert df.columns == columns and sorted(df.collect()) == sorted(rows.values()) and len(rows) < len(groups)

    df = staged(stages["decontamination"](spark, df, SF), "t")
    leaks = {d for d, _ in plain_overlaps([(d, r.text) for d, r in rows.items()], items)}
    rows = {d: r for d, r in rows.items() if d not in leaks}
    assert leaks and df.columns == columns and sorted(df.collect()) == sorted(rows.values())

    df = staged(stages["secrets"](spark, df, SF), "t")
    found = {r.doc_id: r for r in df.collect()}
    assert df.columns == columns and set(found) == set(rows)
    hit = [d for d, r in rows.items() if secrets.scan(r.text)]
    assert hit and all(not secrets.scan(found[d].text) and secrets.MASK in found[d].text and found[d].n_chars == len(found[d].text) for d in hit)
    assert all(found[d] == r for d, r in rows.items() if d not in hit)

    packed = stages["packing"](spark, df, SF).collect()
    check_sequences(packed, 4096)
    want = Counter()
    for d, ids in zip(found, packing.encode([r.text for r in found.values()])):
        want[d] = len(ids) // 4
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    assert sorted(r[:5] for r in P.run(spark, SF).collect()) == sorted(r[:5] for r in packed)


def test_stages_on_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, rows int"
    data = [(1, None), (2, ""), (3, "12 34"), (4, "the cat sat on the mat today"), (4, "the cat sat on the mat today"), (5, "the cat sat on the mat today"),
            (None, "no id for this the text"), (None, "no id for this the text"), (6, 'the token = "abcdefabcdef0123" here'), (7, "the long " * 60_000)]
    df = spark.createDataFrame([(d, t, "en", None, None, 1, 2) for d, t in data], schema)
    out = df
    for _, stage in P.STAGES[:-1]:
        out = staged(stage(spark, out, SF), "t")
        assert out.columns == df.columns
    rows = out.collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:20]) for r in rows) == [
        (0, "no id for this the t"), (4, "the cat sat on the m"), (6, 'the [SECRET]" here'), (7, "the long the long th")]
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def stage(spark, name, df):
    return dict(P.STAGES)[name](spark, df, SF)


def test_language_keeps_texts_where_nothing_can_be_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars").limit(200)
    docs = staged(docs.unionByName(spark.createDataFrame([(-1, "12 34"), (-2, None), (-3, "")], "doc_id long, text string"), allowMissingColumns=True), "t")
    assert sorted(r.doc_id for r in stage(spark, "language", docs).collect()) == sorted(
        r.doc_id for r in docs.collect() if r.text and langid.LETTER.search(r.text))
    held = docs.withColumn("lang", F.lit("fr")).filter(langid.held_out(F.col("doc_id")))  # all labelled rows are held out
    assert stage(spark, "language", held).count() == held.filter("text RLIKE '[A-Za-z]'").count() > 0


def test_language_drops_texts_without_a_greater_language(spark):
    parts = {k: " ".join(a + b + a for a in letters for b in letters) + " " for k, letters in (("x", "abcd"), ("y", "klmn"), ("z", "uvwy"))}
    data = [(i, parts[k] * (4 + i % 5), k) for i, k in enumerate("xyz" * 40)]
    data += [(1000 + i, "".join((parts[k] * 20)[:256 * 4] for k in "xyz"), k) for i, k in enumerate("xyz")]
    df = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in stage(spark, "language", df).collect()) == list(range(120))


def test_near_duplicates_by_id_and_text(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near = base + " more"
    other, third = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    data = [(1, base), (1, other), (1, other), (2, near), (3, third), (None, near), (None, third + " end"), (None, "alone is this row here today"),
            (None, "alone is this row here today"), (4, None), (4, ""), (4, ""), (5, "x"), (5, "x"), (None, base)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 9) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long, root int")
    rows = sorted(((r.doc_id or 0, r.text or "") for r in stage(spark, "near_duplicates", df).collect()))
    assert rows == sorted([(1, base), (1, other), (3, third), (0, "alone is this row here today"), (4, ""), (4, ""), (5, "x")])


def test_short_items_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog ran by the lake in the rain"), (3, "what is the tallest mountain of all")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "dog ran"), (3, "What is the tallest mountain"), (4, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [1, 2]
    assert {r.doc_id: (r.n_items, r.n_short) for r in D.contamination(docs, items).collect()} == {1: (1, 1), 2: (2, 2), 3: (2, 1)}
    assert D.clean(docs, items, shortest=1).count() == 0
