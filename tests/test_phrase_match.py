"""Table-valued synonyms and lemmas by vocabulary: the scan with the same mapping, hand-written phrases, passes, edge rows."""

import pytest

from conftest import SF_SMALL
from pyspark.sql import functions as F

from curata.operators import phrase_match as P
from curata.operators import search
from curata.sources import tables

TEXTS = [(1, "state-of-the-art", "a b  c"), (2, "State of the\nart", None), (3, None, "state of  the art"), (4, "", "xstate of the art"), (5, "a b, c", "abc ab"),
         (5, "a b, c", "abc ab"), (6, "b" + " " * 60_000 + "c", "a b"), (7, "naïve_x", "abcdef")]
PHRASES = ["state of the art", "A-B", "a b, c", "ab*", "b c", "abcd*", "a b*", "state of the a*", "naïve_x", "n*", "", None, "(x", "x)", "zz", "b  c"]


def test_hits_are_those_of_the_terms(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in TEXTS], "ord long, title string, abstract string, keyword string, g int")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(PHRASES)] * 2, "phrase string, number int")
    for per_pass in (P.PER_PASS, 3):
        got = {(r.ord, r.field, r.phrase) for r in P.phrase_hits(df, table, per_pass=per_pass).collect()}
        want = set()
        for p in PHRASES:
            if p and p not in ("(x", "x)"):  # no words to look up: refused
                for i, f in enumerate(("title", "abstract")):
                    want |= {(r.ord, i, p) for r in df.filter(search.term_condition(search._term(p), f)).collect()}
        assert got == want and len(got) > 15
    assert P.phrase_hits(df, table.limit(0)).count() == 0 and P.phrase_hits(df.limit(0), table).count() == 0
    assert P.phrase_hits(df, table).columns == ["ord", "field", "number", "phrase"]


@pytest.mark.parametrize("query", ["thing AND (for OR 'it was')", "'that is' OR thing", "tion* AND thing"])
def test_synonym_table_equals_the_mapping(spark, query):
    p = tables.papers(spark, SF_SMALL)
    mapping = {"thing": ["with the", "of the", "nothing"], "for": ["und der", "th*", "this was"], "tion*": ["that"], "other": ["the"]}
    table = spark.createDataFrame([(k, v) for k, vs in mapping.items() for v in vs], "keyword string, phrase string")
    for across in (False, True):
        want = sorted(r.ord for r in search.boolean_search(p, query, synonyms={k: v for k, v in mapping.items() if k != "tion*"}, across_fields=across).collect())
        got = P.boolean_search_table(p, query, table.filter("keyword <> 'tion*'"), across_fields=across)
        assert sorted(r.ord for r in got.collect()) == want and got.columns == p.columns


def test_thousands_of_phrases_in_one_pass(spark):
    p = tables.papers(spark, SF_SMALL)
    table = P.vocabulary(p).selectExpr("token AS phrase")
    n = table.count()
    hits = P.phrase_hits(p, table, ["abstract"])
    assert n > 3000 and hits.select("phrase").distinct().count() == n


def test_lemmas(spark):
    text = ("analyses of mice and the gas of species; a study, studies of models and a model; classes, class; buses bus lenses lens boxes box; churches church; "
            "wolves wolf women woman wishes wish ass asses thes the miss his hi quizzes quiz s ss data always this")
    words = P.vocabulary(spark.createDataFrame([(text,), (None,), ("",)], "abstract string"))
    lemma = {r.token: r.lemma for r in P.lemma_table(words).collect()}
    assert len(lemma) == words.count()
    want = {"analyses": "analysis", "mice": "mouse", "gas": "gas", "species": "species", "studies": "study", "models": "model", "classes": "class", "buses": "bus",
            "lenses": "lens", "boxes": "box", "churches": "church", "wolves": "wolf", "women": "woman", "wishes": "wish", "asses": "ass", "miss": "miss", "his": "his",
            "thes": "the", "data": "datum", "s": "s", "always": "always", "this": "this", "bus": "bus", "lens": "lens", "class": "class"}
    assert {w: lemma[w] for w in want} == want
    forms = P.keyword_forms(spark.createDataFrame([("study",), ("Analyses",), ("unheard",)], "keyword string"), P.lemma_table(words))
    assert {(r.keyword, r.phrase) for r in forms.collect()} == {("study", "study"), ("study", "studies"), ("Analyses", "analyses"), ("unheard", "unheard")}
    assert P.lemma_table(words.limit(0)).count() == 0


def test_texts_are_cut_by_arrow(spark):
    """Words, and the words ahead of them, of texts of every size; no regular expression of the JVM goes over the texts."""
    import random
    import re

    from curata.functions import words as W
    rng = random.Random(5)
    texts = [None, "", "  ", "one", " -é_1 ,x", "naïve 中文 x²", "b" + " " * 3000]
    texts += ["".join(rng.choice(["ab", "ü", "7", "_", " ", ", ", "\t", "-"]) for _ in range(n)) for n in (5, 400, 400_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, abstract string").coalesce(1)
    found, reach = [], []
    for k, x in enumerate(texts):
        own, gaps = re.findall(r"\w+", x or ""), re.split(r"\w+", x or "")
        found += [(k, w) for w in own]
        reach += [(k, w, tuple(own[i:i + 3]), tuple(gaps[i + 1:i + len(own[i:i + 3])])) for i, w in enumerate(own)]
    assert sorted(tuple(r) for r in W.words(df, F.col("abstract"), ["k"]).collect()) == sorted(found)
    got = W.ahead(df, F.col("abstract"), ["k"], 3).collect()
    assert sorted((r.k, r[1], tuple(r[2]), tuple(r[3])) for r in got) == sorted(reach)
    assert "regexp_extract_all" not in P.vocabulary(df)._jdf.queryExecution().toString()
    hits = P.phrase_hits(df, spark.createDataFrame([("ab",), ("ü 7",)], "phrase string"), ["abstract"], key="k")
    assert "regexp_extract_all" not in hits._jdf.queryExecution().toString()
