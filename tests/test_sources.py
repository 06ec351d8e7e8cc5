import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from curata.sources import landed_fixture as X
from curata.sources import payloads as P
from curata.sources import stages, tables


def test_every_source_parses_and_normalises(spark):
    pl = X.landed_payloads(tables.papers(spark, SF_SMALL))
    total = 0
    for name in P.sources():
        out = P.normalise(P.raw_rows(pl, name), name)
        n = out.count()
        assert n > 0
        assert out.filter(F.col("database") != name).count() == 0
        total += n
    assert total == tables.papers(spark, SF_SMALL).count()     # records without a key all stay


def test_unknown_source_is_a_clear_error():
    import pytest
    with pytest.raises(KeyError):
        P.source("pubmed")


def test_pick_link_cases(spark):
    df = spark.createDataFrame(
        [(1, [("self", "u1"), ("scopus", "u2")]), (2, []), (3, None), (4, [("self", "u3")])],
        "i int, link array<struct<`@ref`: string, `@href`: string>>")
    got = {r.i: (r.a, r.b) for r in df.select("i", P.pick_link("link", "scopus").alias("a"),
                                                P.pick_link("link").alias("b")).collect()}
    assert got == {1: ("u2", "u1"), 2: (None, None), 3: (None, None), 4: (None, "u3")}


def test_scopus_id(spark):
    df = spark.createDataFrame([("e1", "SCOPUS_ID:9"), ("", "SCOPUS_ID:8"), (None, "x")], "eid string, `dc:identifier` string")
    assert [r.s for r in df.select(P.scopus_id().alias("s")).collect()] == ["e1", "8", ""]


def test_csv_quarantine(spark):
    d = tempfile.mkdtemp(prefix="curata-csv-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write('id,title\n1,"multi\nline"\nnot-a-number,b\n3,c\n')
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    good, bad = P.quarantined(P.read_papers_csv(spark, d, schema, on_bad="quarantine", multiline=True), os.path.join(d + "-stage", "t"))
    assert rows(good, "id", "title") == [(1, "multi\nline"), (3, "c")]
    assert bad.count() == 1


def test_stage_is_built_once(spark):
    root = tempfile.mkdtemp(prefix="curata-stage-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    a = stages.stage(spark, "s1", build, root=root)
    b = stages.stage(spark, "s1", build, root=root)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_payload_totals(spark):
    df = spark.createDataFrame([('{"total": 7}',), ('{"result": [{"total": "9"}]}',), ("<feed><totalResults>4</totalResults></feed>",),
                                ('{"search-results": {"opensearch:totalResults": "3"}}',), ("garbage",),
                                ('<feed><opensearch:totalResults xmlns:opensearch="u">12</opensearch:totalResults></feed>',)], "body string")
    assert [r.total for r in P.payload_totals(df).collect()] == [7, 9, 4, 3, 0, 12]
    one = spark.createDataFrame([("core", '{"total": 7, "totalHits": 5}'), ("semantic_scholar", '{"total": 7, "totalHits": 5}'), ("?", '{"total": 7}')],
                                "source string, body string")
    assert [r.total for r in P.payload_totals(one).collect()] == [5, 7, 0]


def test_order_is_unique_from_ingest_to_merge(spark):
    """Pages of more than 150 records, the same page number in two queries, a NULL key: nothing is lost, `ord` stays unique."""
    import json
    from curata.plans import curation as M

    def page(q, n, size):
        recs = [{"id": f"{q}{n}-{i}", "doi": None if i % 9 == 0 else f"10.1/{q}{n}-{i}", "title": f"title {q}{n} {i}",
                 "abstract": f"the text of the record and for it {q} {n} {i}", "publication_date": "2020"} for i in range(size)]
        return ("r" + q + str(n), "core", q, q, n, json.dumps({"totalHits": size, "results": recs}))

    pl = spark.createDataFrame([page("qa", 0, 200), page("qa", 1, 200), page("qb", 0, 200), page("qb", 5000, 3)],
                               "request_id string, source string, query_name string, query_value string, page long, body string")
    rows_ = M.ingest(pl, ["core"])
    assert rows_.count() == rows_.select("ord").distinct().count() == 603
    p = M.preprocess(pl.withColumn("source", F.col("source")))
    assert p.count() == 603
    p = stages.cut(p, "t")
    selected = p.filter(F.col("ord") % 2 == 0)
    edges = p.select(F.col("ord").alias("citing_ord"), ((F.col("ord") * 7) % 603).alias("cited_ord"))
    vectors = p.select("id", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>").alias("embedding"))
    snow = M.snowball(selected, edges, p, p.limit(0), vectors, 0.0, p)
    merged = M.merge_final(selected, snow)
    n = merged.count()
    assert n == merged.select("ord").distinct().count() == merged.select("id").distinct().count() == 603


def test_append_adds_rows(spark):
    d = tempfile.mkdtemp(prefix="curata-append-")
    for fmt in ("parquet", "csv"):
        for part in (spark.range(3), spark.range(3, 5)):
            stages.write_stage(part, os.path.join(d, fmt), "append", fmt)
    assert spark.read.parquet(os.path.join(d, "parquet")).count() == 5
    assert rows(spark.read.option("header", True).csv(os.path.join(d, "csv"))) == [(str(i),) for i in range(5)]


def test_checkpoint_folder_must_be_shared_off_local(spark):
    import pytest
    from curata.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
