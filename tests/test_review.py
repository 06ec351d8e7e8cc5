import datetime

from conftest import papers_df, rows
from curata.operators import joins, review


def _dec(spark, data):
    return spark.createDataFrame([(i, "abstract", s, datetime.datetime(2024, 1, d)) for i, s, d in data],
                                 "id long, round string, status string, ts timestamp")


def test_latest_decision_wins_and_is_idempotent(spark):
    df = papers_df(spark, [{"id": i, "ord": i, "status": "unknown"} for i in (1, 2, 3)])
    dec = _dec(spark, [(1, "included", 1), (1, "not included", 2), (2, "included", 1)])
    once = joins.apply_decisions(df, dec)
    assert rows(once, "id", "status") == [(1, "not included"), (2, "included"), (3, "unknown")]
    assert rows(joins.apply_decisions(once, dec), "id", "status") == rows(once, "id", "status")


def test_progress_zero_rows(spark):
    df = papers_df(spark, [{"id": 1, "ord": 1, "status": "unknown"}]).limit(0)
    r = review.review_progress(df).first()
    assert (r.total, r.progress) == (0, 0.0)


def test_progress_counts(spark):
    df = papers_df(spark, [{"id": i, "ord": i, "status": s} for i, s in
                           enumerate(["unknown", "included", "not included", "excluded"])])
    r = review.review_progress(df).first()
    assert (r.total, r.unknown, r.included, r.excluded, r.progress) == (4, 1, 1, 2, 75.0)


def test_review_round_resets_status_and_renumbers(spark):
    df = papers_df(spark, [{"id": i, "ord": 10 * i, "title": f"t{i}", "abstract": f"a{i}", "status": "unknown"}
                           for i in range(1, 5)])
    dec = _dec(spark, [(2, "included", 1), (4, "included", 1), (3, "not included", 1)])
    inc, removed, _ = review.review_round(df, dec, "abstract")
    assert rows(inc, "id", "ord", "status") == [(1, 20, "unknown"), (2, 40, "unknown")]
    assert rows(removed, "ord") == [(30,)]


def _rounds(spark, data):
    return spark.createDataFrame([(i, r, s, datetime.datetime(2024, 1, d)) for i, r, s, d in data],
                                 "id long, round string, status string, ts timestamp")


def test_rounds_are_decided_apart(spark):
    """Included in the abstract round, excluded later in the full-text round: the abstract round still includes it."""
    df = papers_df(spark, [{"id": i, "ord": i, "title": f"t{i}", "abstract": f"a{i}", "status": "unknown"} for i in (1, 2)])
    dec = _rounds(spark, [(1, "abstract", "included", 1), (1, "full_text", "excluded", 2), (2, "abstract", "included", 1)])
    inc, removed, _ = review.review_round(df, dec, "abstract")
    assert rows(inc, "ord") == [(1,), (2,)] and removed.count() == 0
    inc, removed, _ = review.review_round(df, dec, "full_text")
    assert inc.count() == 0 and rows(removed, "ord", "status") == [(1, "excluded")]
    assert rows(joins.apply_decisions(df, dec), "id", "status") == [(1, "excluded"), (2, "included")]


def test_survey_reviews_what_it_snowballs(spark):
    """Only records that both rounds include reach the final list, retrieved or snowballed."""
    from pyspark.sql import functions as F
    from curata.plans import curation
    texts = {i: f"the record of the number {i} and its text for this and that {i}" for i in range(1, 9)}
    day = datetime.date(2020, 5, 5)
    df = papers_df(spark, [{"id": i, "ord": i, "doi": f"10.1/{i}", "title": f"title {i}", "abstract": t, "status": "unknown",
                            "publication_date": day if i < 6 else datetime.date(1999, 1, 1)} for i, t in texts.items()], extra=["lang"])
    dec = _rounds(spark, [(1, "abstract", "included", 1), (1, "full_text", "included", 2), (2, "abstract", "included", 1), (2, "full_text", "excluded", 2),
                          (3, "abstract", "not included", 1), (6, "abstract", "included", 1), (6, "full_text", "included", 2), (7, "abstract", "included", 1)])
    edges = spark.createDataFrame([(6, 1), (7, 1), (8, 2), (3, 1)], "citing_ord long, cited_ord long")
    vectors = curation.record_vectors(df)
    got = curation.survey_stages(df, dec, edges, vectors, "2010-01-01", None, [], [], -1.0)
    assert rows(got["included"], "record_id", "status") == [(1, "included")]
    assert rows(got["removed"], "record_id") == [(2,), (3,)]
    assert rows(got["snowball"], "record_id") == [(4,), (5,), (6,), (7,)]      # 8 cites an excluded one, 3 is decided
    assert rows(got["final"], "title", "status") == [("title 1", "included"), ("title 6", "included")]
    some = curation.survey_stages(df, dec, edges, vectors, "2010-01-01", None, [], [], -1.0,
                                  query_vec=F.array(*[F.lit(0.0)] * 256), semantic_threshold=0.5)
    assert some["semantic"].count() == 0 and some["final"].count() == 0


def test_records_without_a_vector_are_encoded(spark):
    from curata.plans import curation
    df = papers_df(spark, [{"id": 1, "ord": 1, "title": "a b", "abstract": "c"}, {"id": 2, "ord": 2, "title": "a b", "abstract": None}])
    stored = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    out = {r.id: r.embedding for r in curation.record_vectors(df, stored).collect()}
    assert out[1] == [1.0, 0.0, 0.0] and len(out[2]) == 3 and abs(sum(x * x for x in out[2]) - 1) < 1e-5


def test_undecided_ignores_the_case_of_dois(spark):
    orig = papers_df(spark, [{"id": 1, "ord": 1, "doi": "10.1/abc"}, {"id": 2, "ord": 2, "doi": " 10.1/DEF"}, {"id": 3, "ord": 3, "doi": "10.1/def "}])
    sel = papers_df(spark, [{"id": 9, "ord": 9, "doi": "10.1/ABC"}])
    assert rows(joins.undecided(orig, sel, orig.limit(0), sel.limit(0)), "id") == [(2,)]


def test_undecided_clean_vs_parity(spark):
    orig = papers_df(spark, [{"id": i, "ord": i, "doi": d} for i, d in [(1, "a"), (2, "b"), (3, None), (4, None)]])
    sel = papers_df(spark, [{"id": 1, "ord": 1, "doi": "a"}])
    cites = papers_df(spark, [{"id": 5, "ord": 5, "doi": "b"}, {"id": 6, "ord": 6, "doi": "c"}])
    rem = papers_df(spark, [{"id": 9, "ord": 9, "doi": "z"}]).limit(0)
    clean = rows(joins.undecided(orig, sel, cites, rem, "clean"), "id")
    assert clean == [(2,), (3,), (4,), (6,)]
    parity = rows(joins.undecided(orig, sel, cites, rem, "parity"), "id")
    assert parity == [(6,)]          # b twice, a twice, NULLs twice: all dropped (quirk Q5)
