"""A third of all rows on one key: results must stay whole and exact."""

import datetime

from pyspark.sql import functions as F

from conftest import rows
from curata.operators import dedup, joins
from curata.schema import conform

N = 3000


def _records(spark):
    df = spark.range(N).select(
        F.col("id").alias("ord"), (F.col("id") + 1).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("10.1/HOT")).otherwise(F.concat(F.lit("10.1/"), F.col("id").cast("string"))).alias("doi"),
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("abstract "), F.col("id").cast("string")).alias("abstract"),
        F.lit("unknown").alias("status"))
    return conform(df)


def test_keep_first_hot_key(spark):
    out = dedup.dedup_doi(_records(spark))
    assert out.count() == N - N // 3 + 1
    assert out.filter(F.col("doi") == "10.1/HOT").select("ord").first()[0] == 0


def test_singletons_hot_key(spark):
    out = dedup.singletons(_records(spark), F.col("doi"))
    assert out.count() == N - N // 3


def test_latest_decision_hot_id(spark):
    t0 = datetime.datetime(2024, 1, 1)
    dec = spark.range(N).select(F.lit(1).cast("long").alias("id"), F.lit("abstract").alias("round"),
                                F.when(F.col("id") == N - 1, F.lit("excluded")).otherwise(F.lit("included")).alias("status"),
                                (F.lit(t0) + F.make_interval(secs=F.col("id").cast("double"))).alias("ts"))
    out = joins.apply_decisions(_records(spark), dec)
    assert rows(out.filter(F.col("id") == 1), "status") == [("excluded",)]
    assert out.count() == N


def test_citation_expansion_hot_cited(spark):
    recs = _records(spark)
    edges = spark.range(N).select(F.col("id").alias("citing_ord"),
                                  F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("long").alias("cited_ord"))
    selected = recs.filter(F.col("ord").isin(7, 8))
    out = joins.expand_citations(selected, edges, recs)
    want = edges.filter(F.col("cited_ord").isin(7, 8)).select("citing_ord").distinct().count()
    assert out.count() == want > N // 3


def test_enrich_hot_lookup_key(spark):
    recs = _records(spark).select("ord", "doi", F.lit(None).cast("string").alias("abstract"))
    lk = _records(spark).select("doi", "ord", F.col("abstract").alias("a"))
    out = joins.enrich_abstract(recs, [(lk, "doi", "a", "ord")])
    assert out.count() == N
    assert rows(out.filter(F.col("doi") == "10.1/HOT").select("abstract").distinct()) == [("abstract 0",)]
