"""Stages keyed by inputs and parameters: interrupted surveys, changed inputs, half-written stages, observed rows."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from curata.plans import catalog, curation
from curata.sources import stages, tables


def test_stage_is_valid_for_its_inputs_and_parameters(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    spark.range(10).write.parquet(src)

    def run(limit, params=None):
        store = stages.StageStore(spark, root)
        rows = store.stage("part", spark.read.parquet(src).filter(F.col("id") < limit), params=params)
        return store.log[0][1], rows.count()

    assert run(5) == (True, 5) and run(5) == (False, 5)
    assert run(7) == (True, 7) and run(5, params=["x"]) == (True, 5) and run(5) == (False, 5)
    spark.range(3).write.mode("append").parquet(src)  # another state of the input
    assert run(5) == (True, 8) and run(5) == (False, 8)
    # what an interrupted build leaves is no stage
    for name in os.listdir(root):
        shutil.rmtree(os.path.join(root, name, "manifest"))
    assert run(5) == (True, 8)


def test_fingerprint_does_not_depend_on_the_session(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).selectExpr("id", "id % 2 AS k").write.parquet(path)

    def plan(s):
        a = s.read.parquet(path)
        return a.join(a.groupBy("k").agg(F.transform(F.collect_list("id"), lambda x: x + 1).alias("l")), "k").filter("id > 1")

    assert stages.fingerprint(plan(spark)) == stages.fingerprint(plan(spark.newSession()))
    assert stages.fingerprint(plan(spark)) != stages.fingerprint(plan(spark).filter("id > 2"))


def test_interrupted_survey_goes_on(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "survey")

    def run(**change):
        store = stages.StageStore(spark, root)
        args = dict(papers=tables.papers(spark, SF_SMALL), decisions=tables.decisions(spark, SF_SMALL), edges=tables.citations(spark, SF_SMALL),
                    vectors=tables.all_vectors(spark, SF_SMALL), start=catalog.E2E_FROM, end=catalog.E2E_TO, title_terms=catalog.TITLE_TERMS,
                    abstract_words=catalog.ABSTRACT_WORDS, snowball_threshold=catalog.S2_T) | change
        return sorted(map(tuple, curation.survey_stages(**args, store=store)["final"].select("id", "ord", "title").collect())), dict(store.log)

    whole = curation.snowball

    def fails(*a, **k):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(curation, "snowball", fails)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(curation, "snowball", whole)
    want = sorted(map(tuple, catalog.q_survey_end_to_end(spark, SF_SMALL).select("id", "ord", "title").collect()))
    rows, log = run()
    assert rows == want and [n for n, built in log.items() if not built] == ["cleaned", "retrieved-abstract", "retrieved-full_text"]
    rows, log = run()
    assert rows == want and not any(log.values())
    _, log = run(snowball_threshold=catalog.S2_T + 0.05)
    assert [n for n, built in log.items() if built] == ["snowball", "snowballed-abstract", "snowballed-full_text"]
    _, log = run(title_terms=[*catalog.TITLE_TERMS, "zzzz"])
    assert log["cleaned"] and all(log.values())


def test_counts_are_observed(spark, tmp_path):
    store = stages.StageStore(spark, str(tmp_path / "s"))
    store.stage("a", spark.range(7).toDF("x"), params=1)
    store.stage("none", spark.range(0).toDF("x"), params=2)
    assert {r.stage: r.n_rows for r in store.counts().collect()} == {"a": 7, "none": 0}
