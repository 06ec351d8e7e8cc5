from conftest import papers_df, rows
from curata.operators import filters


def _p(ord, title="t", abstract="a", date=None, score=None):
    import datetime
    return {"ord": ord, "id": ord, "title": title, "abstract": abstract,
            "publication_date": datetime.date.fromisoformat(date) if date else None, "semantic_score": score}


def test_require_text_treats_empty_as_missing_but_keeps_spaces(spark):
    df = papers_df(spark, [_p(1, ""), _p(2, None), _p(3, " "), _p(4, "x", "")])
    assert [r[0] for r in rows(filters.require_text(df), "ord")] == [3]


def test_title_block_is_substring_any_case(spark):
    df = papers_df(spark, [_p(1, "Progressive nets"), _p(2, "A REVIEW"), _p(3, "Deep nets")])
    assert [r[0] for r in rows(filters.exclude_title_terms(df), "ord")] == [3]


def test_abstract_block_is_whole_word(spark):
    df = papers_df(spark, [_p(1, abstract="Éthesis here"), _p(2, abstract="a synthesis"),
                           _p(3, abstract="PhD Thesis."), _p(4, abstract="thesis_x"), _p(5, abstract="(thesis)")])
    assert [r[0] for r in rows(filters.exclude_abstract_words(df), "ord")] == [1, 2, 4]


def test_date_range_inclusive_and_open(spark):
    df = papers_df(spark, [_p(1, date="2020-01-01"), _p(2, date="2020-12-31"), _p(3, date="2021-01-01"), _p(4)])
    assert [r[0] for r in rows(filters.between_dates(df, "2020-01-01", "2020-12-31"), "ord")] == [1, 2]
    assert [r[0] for r in rows(filters.between_dates(df, None, "2020-06-01"), "ord")] == [1]
    assert [r[0] for r in rows(filters.between_years(df, 2021, None), "ord")] == [3]


def test_score_threshold_inclusive(spark):
    df = papers_df(spark, [_p(1, score=0.5), _p(2, score=0.49999), _p(3, score=0.7)])
    assert [r[0] for r in rows(filters.score_at_least(df, 0.5), "ord")] == [1, 3]


def test_declared_language_only_if_column_exists(spark):
    df = papers_df(spark, [_p(1)])
    assert filters.filter_language(df, "en").count() == 1


def test_empty_block_lists_drop_nothing(spark):
    df = papers_df(spark, [_p(1, "A review", "thesis. x"), _p(2)])
    assert filters.exclude_title_terms(df, []).count() == filters.exclude_abstract_words(df, []).count() == 2


def test_year_range_is_pushed_to_the_scan(spark):
    from curata.sources.stages import cut
    df = cut(papers_df(spark, [_p(1, date="2020-05-01"), _p(2, date="2021-05-01")]), "years")
    out = filters.between_years(df, 2021, 2021)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(publication_date" in plan and out.count() == 1
