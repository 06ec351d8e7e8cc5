"""The cascade batch by batch: every order of arrival gives the survivors of one batch; retractions; replays; late rows; edge rows."""

import random

from conftest import papers_df
from curata.operators import dedup
from curata.operators.incremental_dedup import IncrementalCascade


def records(n=120, seed=1):
    rng = random.Random(seed)

    def some(values, empty):
        return rng.choice(values) if rng.random() > empty else rng.choice([None, ""])

    return [{"id": i, "ord": i, "doi": some([f"10.1/{k}" for k in range(25)] + ["10.1/A", "10.1/a"], 0.3), "title": some([f"Title {k}" for k in range(40)] + ["title-1"], 0.1),
             "abstract": some([f"abstract {k}" for k in range(45)], 0.1)} for i in range(n)]


def survivors(df):
    return sorted(r.ord for r in dedup.remove_repeated(df).collect())


def test_any_order_of_batches(spark, tmp_path):
    for seed in (1, 2):
        rows = records(seed=seed)
        df = papers_df(spark, rows).cache()
        order = list(range(len(rows)))
        random.Random(seed).shuffle(order)
        state, known, kept = IncrementalCascade(spark, str(tmp_path / f"s{seed}")), [], set()
        for i, part in enumerate((order[:50], order[50:53], order[53:])):
            known += part
            batch = df.filter(df["ord"].isin(part))
            change = state.merge(batch, i).collect()
            assert all((r.ord in kept) == (r.change == "retracted") for r in change)
            kept ^= {r.ord for r in change}
            want = survivors(df.filter(df["ord"].isin(known)))
            assert sorted(kept) == want == sorted(r.ord for r in state.survivors().collect())
        assert sorted(r.ord for r in state.select(df).collect()) == want
        df.unpersist()


def test_retraction_and_return(spark, tmp_path):
    def batch(*rows):
        return papers_df(spark, [dict(zip(("id", "ord", "doi", "title", "abstract"), (r[0], *r))) for r in rows])

    state = IncrementalCascade(spark, str(tmp_path / "s"))
    state.merge(batch((10, "10.1/x", "one", "a"), (11, None, "One", "b")), 0)
    assert [r.ord for r in state.survivors().collect()] == [10]  # 11 has the title of 10
    change = {(r.ord, r.change) for r in state.merge(batch((5, "10.1/X", "five", "c")), 1).collect()}
    assert change == {(10, "retracted"), (5, "added"), (11, "added")}  # 10 loses its DOI to 5, and 11 comes back
    again = {(r.ord, r.change) for r in state.merge(batch((5, "10.1/X", "five", "c")), 1).collect()}
    assert again == change and sorted(r.ord for r in state.survivors().collect()) == [5, 11]  # a replayed batch
    assert state.merge(batch((5, "10.1/X", "five", "c"), (10, None, "other", "z")), 2).collect() == []  # rows that are there already
    assert state.merge(batch().limit(0), 3).collect() == []
    assert sorted(r.ord for r in state.survivors().collect()) == [5, 11]


def test_stream_in_many_batches(spark, tmp_path):
    from curata.streaming import incremental as K
    rows = records(90, 7)
    df = papers_df(spark, rows)
    src = str(tmp_path / "src")
    for k in range(3):
        df.filter(df["ord"] % 3 == 2 - k).coalesce(1).write.mode("append").parquet(src)
    stream = K.file_stream(spark, src, "*.parquet", df.schema, max_files=1)
    args = (stream, str(tmp_path / "state"), str(tmp_path / "ckpt"))
    K.stream_cascade(*args)
    papers_df(spark, [{"id": 500, "ord": -1, "doi": "10.1/3", "title": "late", "abstract": "late one"}]).coalesce(1).write.mode("append").parquet(src)
    state = K.stream_cascade(*args)  # goes on where it stopped; a late row with the smallest ord
    assert sorted(r.ord for r in state.survivors().collect()) == survivors(spark.read.parquet(src))
