import datetime
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from curata.sources import tables
from curata.streaming import incremental as K


def test_landing_restart_adds_nothing(spark):
    root = K.run_folder(spark, "test-landing")
    schema = tables.table(spark, SF_SMALL, "documents").schema
    stream = lambda: tables.papers_from(K.file_stream(spark, SF_SMALL, "documents.parquet", schema)).select("ord")
    target, ckpt = os.path.join(root, "t"), os.path.join(root, "c")
    K.land_incrementally(stream(), target, ckpt)
    n1 = K.read_landed(spark, target).count()
    K.land_incrementally(stream(), target, ckpt)          # restart: no new files, no new rows
    landed = K.read_landed(spark, target)
    assert n1 == landed.count() == landed.select("ord").distinct().count() == 200


def test_decision_stream_matches_batch(spark):
    from curata.operators import joins
    root = K.run_folder(spark, "test-decisions")
    labels = K.file_stream(spark, SF_SMALL, "labels.parquet", tables.table(spark, SF_SMALL, "labels").schema)
    K.run_updates(K.decision_status_stream(tables.decisions_from(labels)), os.path.join(root, "t"), os.path.join(root, "c"))
    got = {r.id: r.status for r in K.current_status(spark, os.path.join(root, "t")).collect()}
    want = {r["id"]: r["__decision"] for r in joins.latest_decisions(tables.decisions(spark, SF_SMALL)).collect()}
    assert got == want and len(got) > 0


def _write(spark, folder, name, data, schema):
    """One Parquet file of its own in ``folder``."""
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, name))


def test_landing_of_several_files_with_a_restart_between(spark):
    root = K.run_folder(spark, "test-files")
    target, ckpt = os.path.join(root, "t"), os.path.join(root, "c")
    for n in range(3):
        _write(spark, root, "in", [(n * 10 + i,) for i in range(4)], "ord long")
        stream = K.file_stream(spark, os.path.join(root, "in"), "*.parquet", spark.range(1).selectExpr("id AS ord").schema, max_files=1)
        K.land_incrementally(stream, target, ckpt)
        assert rows(K.read_landed(spark, target)) == [(m * 10 + i,) for m in range(n + 1) for i in range(4)]


def test_stream_dedup_over_batches(spark):
    """A duplicate in a later file goes, one beyond the lateness bound does not, rows without a key all stay."""
    root = K.run_folder(spark, "test-dedup")
    schema = "ord long, doi string, day int"
    files = [[(1, "a", 0), (2, None, 0), (3, None, 0)], [(4, "a", 1), (5, "b", 1), (6, None, 1)], [(7, "c", 400)], [(8, "a", 401), (9, "c", 401)]]
    for data in files:
        _write(spark, root, "in", data, schema)
        s = K.file_stream(spark, os.path.join(root, "in"), "*.parquet", spark.createDataFrame([], schema).schema, max_files=1)
        s = s.withColumn("event_time", F.timestamp_seconds((F.col("day") + 20_000) * 86400))
        K.run_append(K.stream_dedup(s, "doi", "event_time", "30 days"), os.path.join(root, "t"), os.path.join(root, "c"))
    out = spark.read.parquet(os.path.join(root, "t"))
    assert [r[0] for r in rows(out, "ord")] == [1, 2, 3, 5, 6, 7, 8]


def test_status_updates_and_running_progress(spark):
    """Each batch writes the records that changed; the current table and the progress follow."""
    root = K.run_folder(spark, "test-updates")
    schema = "id long, round string, status string, ts timestamp"
    at = lambda d: datetime.datetime(2024, 1, d)
    papers = spark.range(1, 5).select("id", F.lit("unknown").alias("status"))
    seen = []
    for data in ([(1, "abstract", "included", at(1)), (2, "abstract", "included", at(1))], [(2, "abstract", "not included", at(2))],
                 [(2, "abstract", "included", at(1)), (3, "abstract", "excluded", at(3))]):
        _write(spark, root, "in", data, schema)
        s = K.file_stream(spark, os.path.join(root, "in"), "*.parquet", spark.createDataFrame([], schema).schema, max_files=1)
        K.run_updates(K.decision_status_stream(s), os.path.join(root, "t"), os.path.join(root, "c"))
        now = K.current_status(spark, os.path.join(root, "t"))
        p = K.running_progress(papers, now).first()
        seen.append((p.included, p.excluded, p.progress))
    assert seen == [(2, 0, 50.0), (1, 1, 50.0), (1, 2, 75.0)]
    assert rows(now, "id", "status") == [(1, "included"), (2, "not included"), (3, "excluded")]
    changed = {r._batch: r.n for r in spark.read.parquet(os.path.join(root, "t")).groupBy("_batch").agg(F.count("*").alias("n")).collect()}
    assert changed[0] == 2 and changed[1] == 1
    assert rows(K.compact(spark, os.path.join(root, "t"), os.path.join(root, "now")), "id", "status") == rows(now, "id", "status")


def test_streams_over_tables_of_several_files(spark):
    """A table that is a folder of files gives the rows of the same table in one file."""
    from curata.plans import catalog
    root = K.run_folder(spark, "test-folders")
    docs = [(i, f"Title {i}. Text", "en", "web", 10) for i in range(1, 60)]
    _write(spark, root, "documents.parquet", docs[:30], "doc_id long, text string, lang string, source string, n_chars long")
    _write(spark, root, "documents.parquet", docs[30:], "doc_id long, text string, lang string, source string, n_chars long")
    for part in ([(1, 1, 0), (2, 0, 1)], [(5, 1, 1), (6, 1, 0)]):
        _write(spark, root, "labels.parquet", part, "doc_id long, quality int, toxic int")
    assert rows(catalog.q_incremental_landing(spark, root), "ord") == [(i,) for i in range(1, 60)]
    keys = [r.doi_key for r in catalog.q_stream_dedup(spark, root).collect()]
    assert len(keys) == 59 and keys.count(None) == 3 and len(set(keys)) == 57
    assert rows(catalog.q_decision_status_stream(spark, root), "id", "status") == [(2, "included"), (3, "not included"), (6, "excluded"), (7, "included")]


def test_cascade_lands_as_many_files_as_the_table_has_splits(spark):
    from curata.plans import catalog
    from curata.session import checkpoint_dir
    root = K.run_folder(spark, "test-splits")
    for n in range(7):
        _write(spark, root, "documents.parquet", [(n * 20 + i, f"Title {n} {i}. Text", "en", "web", 10) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    streams = os.path.join(checkpoint_dir(spark), "streams")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "2000")
    try:
        before = set(os.listdir(streams))
        out = catalog.q_stream_cascade(spark, root)
        (own,) = [f for f in os.listdir(streams) if f not in before]
        assert len([f for f in os.listdir(os.path.join(streams, own, "landed")) if f.endswith(".parquet")]) >= 7
        assert len(os.listdir(os.path.join(streams, own, "_checkpoint", "commits"))) >= 3
        assert rows(out, "ord") == rows(catalog.q_dedup_cascade(spark, root), "ord")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
