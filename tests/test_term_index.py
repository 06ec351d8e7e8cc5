"""Positional term index: the scan's rows for phrases, prefixes, odd terms, synonyms; parts read; edge rows."""

import pytest

from conftest import SF_SMALL
from curata.operators import search
from curata.operators import term_index as T
from curata.sources import tables

QUERIES = ["'that is' AND (thing OR 'it was') OR \"ouen\"", "thing && ('with the' || 'for')", "the", "tion* AND de", "'in the th*' OR nothinglikeit",
           "('of the' OR \"is a\") AND ('and' OR und)", "nothinglikeit", "'the, '", "'ing. the' OR 'er*'", "'is,' OR '(x'"]
TEXTS = [(1, "state-of-the-art: C++", "a b  c"), (2, "State of the\nart", None), (3, None, "state of  the art"), (4, "", "xstate of the art"),
         (5, "naïve café_x 42", "the state of the arts"), (6, "a, b c", "c++ a"), (7, "state", "of the art"), (8, "b c" + " " * 50_000, "state of the art")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    p = tables.papers(spark, SF_SMALL)
    return p, T.build(p, str(tmp_path_factory.mktemp("terms")), parts=32)


@pytest.mark.parametrize("query", QUERIES)
def test_rows_are_those_of_the_scan(index, query):
    p, ix = index
    for across in (False, True):
        want = {r.ord for r in search.boolean_search(p, query, across_fields=across).collect()}
        assert {r.ord for r in ix.search(p, query, across_fields=across).collect()} == want


def test_reads_only_the_parts_of_its_words(spark, index):
    _, ix = index
    parts = ix.parts([("thing", False), ("tion", True), ("nothinglikeit", False), ("the", False)])
    assert ("nothinglikeit", False) not in parts and all(b - a < 16 for a, b in parts.values())
    a, b = parts["the", False]
    assert b > a  # a frequent word fills parts of its own
    plan = ix.occurrences("thing", False, parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters", 1)[1][:120] and "EqualTo(term,thing)" in plan
    rows = ix.lexicon().count()
    assert rows == spark.read.parquet(f"{ix.path}/postings").select("term").distinct().count()


def test_hand_written_texts(spark, tmp_path):
    df = spark.createDataFrame([(*r, 0, "clash") for r in TEXTS], "ord long, title string, abstract string, pos int, term string")
    ix = T.build(df, str(tmp_path / "ix"), parts=3)
    for query in ("'state of the art'", "'state-of-the-art'", "'state of the art*'", "'c++'", "'a b'", "'b c'", "'a, b'", "café_x AND 42", "naïve OR '42'",
                  "'the state' AND arts", "'c+*'", "state AND 'of the art'"):
        for across in (False, True):
            want = sorted(r.ord for r in search.boolean_search(df, query, across_fields=across).collect())
            assert sorted(r.ord for r in ix.search(df, query, across_fields=across).collect()) == want, query
    syn = {"state": ["c++", "a b"]}
    assert sorted(r.ord for r in ix.search(df, "state", syn).collect()) == sorted(r.ord for r in search.boolean_search(df, "state", synonyms=syn).collect())
    assert ix.search(df, "state").columns == df.columns


def test_repeated_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "c"), (1, "a b", "c"), (2, "b a", "c")], "ord long, title string, abstract string")
    ix = T.build(df, str(tmp_path / "a"), parts=2)
    assert sorted(r.ord for r in ix.search(df, "'a b'").collect()) == [1, 1]
    empty = df.limit(0)
    ix = T.build(empty, str(tmp_path / "b"))
    assert ix.search(empty, "a AND 'b c'").count() == 0


def test_postings_gather_the_occurrences_of_a_block_of_texts(spark):
    df = spark.createDataFrame([(1, "A b-a, a"), (2, "a" + " a" * 600), (3, None), (None, "a")], "ord long, t string").coalesce(1)
    found = T.postings(df, ["t"])
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "mapinarrow" in plan and "regexp" not in plan and "generate" not in plan
    rows = found.collect()
    assert all(r.n == len(r.ord) == len(r.pos) <= T.ROW and r.field == 0 for r in rows) and len(rows) < 10
    places = sorted((r.term, r.gap, -1 if o is None else o, p) for r in rows for o, p in zip(r.ord, r.pos))
    assert places == sorted([("a", "", 1, 0), ("b", " ", 1, 1), ("a", " ", 1, 2), ("a", ", ", 1, 3), ("a", "", -1, 0), ("a", "", 2, 0), *(("a", " ", 2, i) for i in range(1, 601))])


def test_a_sample_of_the_texts_says_where_parts_begin(spark, tmp_path, monkeypatch):
    p = tables.papers(spark, SF_SMALL)
    monkeypatch.setattr(T, "TEXTS", 20)
    ix = T.build(p, str(tmp_path / "ix"), parts=12)
    assert spark.read.parquet(f"{ix.path}/postings").groupBy("part").count().count() > 6
    for query in QUERIES[:4]:
        assert {r.ord for r in ix.search(p, query).collect()} == {r.ord for r in search.boolean_search(p, query).collect()}
