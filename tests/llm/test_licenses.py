"""License scans: base places by plain search, edited notices, the SQL twin, edge rows."""

import re

import duckdb

from curata.llm import catalog, licenses as L

SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def key(row):
    return str(tuple(row))


def test_documents_equal_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = catalog.op12_license_scan(spark, SF).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sum(r.n_base > 0 for r in rows) > 20 and all((r.score > 0) == (r.labels != "") for r in rows)


def edited():
    mit, bsd = (dict(L.NOTICES)[x].split() for x in ("mit", "bsd"))
    return [
        (1, "x " * 20 + " ".join(mit[:30] + ["extra", "words"] + mit[30:60] + mit[63:]) + " y"),  # put in, left out
        (2, " ".join(mit[:20])),  # too little of it
        (3, None), (4, "MIT License MIT license, mit-license cc by cc by"), (4, "MIT License MIT license, mit-license cc by cc by"), (4, "apache licenses"),
        (None, "GNU General Public License"), (None, "gnu general public  domain license"), (5, ""), (5, "Apache License"), (6, "éMIT License éapache"),
        (7, " ".join(mit) * 3), (8, " ".join(mit[:40]) + " other " * 50 + " ".join(mit[40:])),  # two halves far apart: no span of them counts
        (9, " ".join(bsd) + " GNU general public license"), (10, "KCC by cc by"), (11, "license " * 3000 + "mit " * 3000)]


def test_edited_notices_and_edge_rows(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in edited()], "doc_id long, text string, template string, words long")
    rows = L.license_scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((plain(*r) for r in edited()), key=key)
    by = {r.doc_id: r for r in rows}
    assert by[1].labels == "mit" and 0.9 < by[1].score < 1 and by[2].labels == "" and by[7].labels == "mit" and by[8].labels == ""
    assert by[9].labels == "bsd,gpl" and by[9].base_labels == "gpl"
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", edited())
    want = sorted(con.execute(catalog.SQL["op12_license_scan"]).fetchall(), key=key)
    assert sorted((tuple(r) for r in L.license_scan(spark.createDataFrame(edited(), "doc_id long, text string")).collect()), key=key) == want


def test_spans_and_votes(spark):
    known = L.templates(spark)
    docs = spark.createDataFrame(edited()[:1], "doc_id long, text string")
    found = L.hits(docs, known)
    span, = L.license_spans(found, known).collect()
    n = len(dict(L.NOTICES)["mit"].split())
    runs = {r.diagonal for r in found.filter("template IS NOT NULL AND length > 4").collect()}
    assert (span.start, span.label, span.phrase) == (20, "mit", False) and runs >= {20, 22, 19} and abs(span.end - 20 - n) < 12
    assert span.votes >= n - 3 - 3 * (L.K_NOTICE - 1) - 12


def test_no_python_and_narrow_shuffles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = L.hits(docs, L.templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
