from conftest import papers_df, rows
from curata.operators import ordering


def test_dense_id_contiguous_on_sparse_order(spark):
    ords = [5, 10 ** 12 + 3, 7, 2 * 10 ** 12, 1 << 21, 0]
    df = papers_df(spark, [{"ord": o} for o in ords])
    got = rows(ordering.with_dense_id(df), "ord", "id")
    assert [i for _, i in got] == [1, 2, 3, 4, 5, 6]


def test_dense_id_over_several_partitions_and_columns(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), (F.col("id") * 7919 % 5000).alias("ord"))
    out = ordering.with_dense_id(df.repartition(9), ["a", "b"], "n").collect()
    assert [r.n for r in sorted(out, key=lambda r: (r.a, r.b))] == list(range(1, 5001))
    assert ordering.with_dense_id(df.limit(0)).count() == 0
    plan = ordering.with_dense_id(df)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan     # the input's plan ran once, into the stage table


def test_cap_per_group_and_draw(spark):
    df = papers_df(spark, [{"ord": i, "database": "a" if i % 3 else "b", "status": "unknown"} for i in range(30)])
    from pyspark.sql import functions as F
    capped = ordering.cap_per_group(df, ["database"], [F.col("ord")], 2)
    assert rows(capped, "database", "ord") == [("a", 1), ("a", 2), ("b", 0), ("b", 3)]
    d1 = [r.ord for r in ordering.draw_batch(df, 5, seed=3).collect()]
    d2 = [r.ord for r in ordering.draw_batch(df, 5, seed=3).collect()]
    assert d1 == d2 and len(set(d1)) == 5


def test_page(spark):
    df = papers_df(spark, [{"ord": i} for i in range(20)])
    assert [r.ord for r in ordering.page(df, ["ord"], 5, 3).collect()] == [5, 6, 7]
