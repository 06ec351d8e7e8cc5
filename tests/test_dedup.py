import re

from pyspark.sql import functions as F

from conftest import papers_df, rows
from curata.operators import dedup


def _p(ord, doi=None, title="t", abstract="a"):
    return {"ord": ord, "id": ord, "doi": doi, "title": title, "abstract": abstract}


def test_null_dois_intent_keeps_all_parity_keeps_one(spark):
    df = papers_df(spark, [_p(1), _p(2), _p(3), _p(4, "10.1/X"), _p(5, "10.1/x")])
    assert [r[0] for r in rows(dedup.dedup_doi(df, nulls="all"), "ord")] == [1, 2, 3, 4]
    assert [r[0] for r in rows(dedup.dedup_doi(df, nulls="one"), "ord")] == [1, 4]


def test_blank_doi_is_null_in_intent_mode_only(spark):
    df = papers_df(spark, [_p(1, "  "), _p(2, " "), _p(3, "  ")])
    assert len(rows(dedup.dedup_doi(df, nulls="all"), "ord")) == 3
    assert [r[0] for r in rows(dedup.dedup_doi(df, nulls="one"), "ord")] == [1, 2]   # '  ' twice, ' ' once


def test_title_variants_collapse(spark):
    df = papers_df(spark, [_p(3, title="Deep Learning"), _p(1, title="deep-learning"),
                           _p(2, title="Deep\nLearning"), _p(4, title="Deep Learnings")])
    assert [r[0] for r in rows(dedup.dedup_title(df), "ord")] == [1, 4]


def test_abstract_dedup_under_different_titles(spark):
    df = papers_df(spark, [_p(1, title="a", abstract="Same text"), _p(2, title="b", abstract="same-text"),
                           _p(3, title="c", abstract="other")])
    assert [r[0] for r in rows(dedup.dedup_abstract(df), "ord")] == [1, 3]


def test_cascade_is_not_connected_components(spark):
    # 1 and 2 share a DOI (2 goes); 2 and 3 share a title -- but 2 is gone, so
    # 3 survives the title step.  Fusing the keys would remove 3 as well.
    df = papers_df(spark, [_p(1, "10.1/a", "first", "x1"), _p(2, "10.1/a", "second", "x2"),
                           _p(3, "10.1/b", "second", "x3")])
    assert [r[0] for r in rows(dedup.remove_repeated(df), "ord")] == [1, 3]


def test_cascade_requires_text_before_abstract_step(spark):
    df = papers_df(spark, [_p(1, "10.1/a", "", "same"), _p(2, "10.1/b", "t2", "same"),
                           _p(3, "10.1/c", "t3", None)])
    assert [r[0] for r in rows(dedup.remove_repeated(df), "ord")] == [2]


def test_cascade_idempotent_and_subset(spark):
    from curata.sources import tables
    p = tables.papers(spark, "/root/testdata/sf0.001")
    once = dedup.remove_repeated(p)
    twice = dedup.remove_repeated(once)
    a, b = rows(once, "ord"), rows(twice, "ord")
    assert a == b
    assert set(a) <= set(rows(p, "ord"))


def test_singletons(spark):
    df = papers_df(spark, [_p(1, "a"), _p(2, "a"), _p(3, "b"), _p(4, None), _p(5, None)])
    assert [r[0] for r in rows(dedup.singletons(df, F.col("doi")), "ord")] == [3]


def test_keep_first_plans_partial_limit_before_shuffle(spark):
    from curata.sources import tables
    p = tables.papers(spark, "/root/testdata/sf0.001")
    plan = dedup.dedup_doi(p)._jdf.queryExecution().executedPlan().toString()
    # the partial WindowGroupLimit sits under the exchange: a hot key sends one row per task
    assert "WindowGroupLimit" in plan


def test_review_dedup(spark):
    df = papers_df(spark, [_p(1, title="A", abstract="x y"), _p(2, title="a", abstract="q"),
                           _p(3, title="b", abstract="X Y"), _p(4, title="c", abstract="x-y")])
    assert [r[0] for r in rows(dedup.review_dedup(df), "ord")] == [1, 4]


def test_final_dedup_keeps_rows_without_doi(spark):
    df = papers_df(spark, [_p(1, None, "t1", "a1"), _p(2, None, "t2", "a2"), _p(3, "d", "T1", "a3")])
    assert [r[0] for r in rows(dedup.final_dedup(df), "ord")] == [1, 2]


def test_no_text_crosses_the_cascades_exchanges(spark):
    """Every exchange of the three chains carries digests; titles and abstracts stay where they are until the one semi join."""
    from curata.sources import tables
    p = tables.papers(spark, "/root/testdata/sf0.001")
    for chain in (dedup.remove_repeated, dedup.review_dedup, dedup.final_dedup):
        left = chain(p)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in left.splitlines() if "Window [" in line]
        assert windows and not any(re.search(r"\b(title|abstract)#", line) for line in windows)
        assert left.count("LeftSemi") == 1


def test_doi_case_variants_are_in_the_records(spark):
    from curata.sources import tables
    p = tables.papers(spark, "/root/testdata/sf0.1")
    n, folded = p.select(F.countDistinct("doi"), F.countDistinct(F.lower("doi"))).first()
    assert n > folded
