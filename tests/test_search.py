import pytest

from conftest import papers_df, rows
from curata.operators import search


def _df(spark, texts):
    return papers_df(spark, [{"ord": i, "id": i, "title": "", "abstract": t} for i, t in enumerate(texts)])


def test_normalize_query_operators_and_artifact():
    assert search.normalize_query("Â'ml' && 'edge' || 'fog'") == "'ml' AND 'edge' OR 'fog'"
    assert search.normalize_query("'a & b' and 'c | d'") == "'a & b' AND 'c | d'"
    assert search.normalize_query("'x' ¦ y") == "'x' OR y"


def test_unbalanced_quote_is_an_error():
    with pytest.raises(ValueError):
        search.lex_query("'machine learning AND x")


def test_and_binds_tighter_than_or(spark):
    df = _df(spark, ["alpha", "beta gamma", "beta", "gamma"])
    got = rows(search.boolean_search(df, "alpha OR beta AND gamma", ["abstract"]), "ord")
    assert [r[0] for r in got] == [0, 1]
    got = rows(search.boolean_search(df, "(alpha OR beta) AND gamma", ["abstract"]), "ord")
    assert [r[0] for r in got] == [1]


def test_whole_phrase_case_insensitive_and_hyphen(spark):
    df = _df(spark, ["Machine-Learning rocks", "machinelearning", "a machine learning system", "machine\nlearning"])
    got = rows(search.boolean_search(df, "'machine learning'", ["abstract"]), "ord")
    assert [r[0] for r in got] == [0, 2, 3]


def test_prefix_term(spark):
    df = _df(spark, ["learners", "learn", "relearn"])
    assert [r[0] for r in rows(search.boolean_search(df, "learn*", ["abstract"]), "ord")] == [0, 1]


def test_synonyms_expand_to_or_group(spark):
    df = _df(spark, ["deep nets", "neural nets", "trees"])
    got = rows(search.boolean_search(df, "'deep'", ["abstract"], {"deep": ["neural"]}), "ord")
    assert [r[0] for r in got] == [0, 1]
    assert search.synonyms_for("'deep' AND x", {"Deep": ["neural"], "y": ["z"]}) == {"deep": ["neural"]}


def test_single_term_equals_whole_word_contains(spark):
    from curata.sources import tables
    p = tables.papers(spark, "/root/testdata/sf0.001")
    a = search.boolean_search(p, "'with'", ["abstract"]).count()
    b = p.filter("lower(translate(abstract, '-\n', '  ')) rlike '(?<![\\\\p{L}\\\\p{N}_])with(?![\\\\p{L}\\\\p{N}_])'").count()
    assert a == b > 0


def test_keyword_filter_lemmatises(spark):
    df = _df(spark, ["two studies of classes", "one study", "a class"])
    got = rows(search.filter_keywords(df.withColumn("title", df.abstract), ["study"]), "ord")
    assert [r[0] for r in got] == [0, 1]


@pytest.mark.parametrize("bad", ["'a' AND", "('a' OR 'b'", "'a' 'b'", "AND 'a'"])
def test_malformed_queries_fail_loudly(spark, bad):
    df = _df(spark, ["a b"])
    with pytest.raises(Exception):
        search.boolean_search(df, bad, ["abstract"]).count()


def test_one_field_must_satisfy_the_whole_query(spark):
    df = papers_df(spark, [{"ord": 1, "id": 1, "title": "edge", "abstract": "learning"}, {"ord": 2, "id": 2, "title": "edge", "abstract": "edge learning"},
                           {"ord": 3, "id": 3, "title": "learning at the edge", "abstract": None}, {"ord": 4, "id": 4, "title": None, "abstract": "fog"}])
    find = lambda q, **kw: [r[0] for r in rows(search.boolean_search(df, q, **kw), "ord")]
    assert find("edge AND learning") == [2, 3]
    assert find("edge AND learning", across_fields=True) == [1, 2, 3]
    assert find("learning OR fog") == [1, 2, 3, 4]


def test_keyword_text_is_built_once(spark):
    df = _df(spark, ["two studies of classes", "x"])
    plan = search.filter_keywords(df, ["study", "class", "two"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
