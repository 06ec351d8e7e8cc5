"""Packing: ids, cuts, capacities, fill.  Sharding: law, slots, the drawn matrix."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from curata.llm import catalog, packing, sharding

SF = "/root/testdata/sf0.01"


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_the_library():
    t = library()
    texts = [s for c in range(0x300) for s in (f"A{chr(c)}b", f" {chr(c)} 1", chr(c) * 3, f"1{chr(c)}'S\n x")]
    texts += ["It's <|endoftext|> x<|startoftext|>", "漢字 é é", "ΑΣ ΑΣ.", None, "", "it''ll '' we've"]
    want = [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode(texts)] == want


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_documents_are_packed_whole_and_tight(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.op10_best_fit_packing(spark, SF).collect()
    by = check_sequences(rows, 4096)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(texts)
    t = library()
    for d, got in pieces.items():
        ids = np.array(t.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        assert sorted(got) == [(k, s, len(c := ids[s:s + 4096]), zlib.crc32(c.tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) * 1.01 + 1


def test_every_capacity_holds():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 200, 3000)
    for rule in ("norm", "dot"):
        where, offset = packing.best_fit(lengths, (1000.0, 9.0, 120_000.0), rule=rule)
        for b in range(where.max() + 1):
            own = lengths[where == b]
            assert 0 < len(own) <= 9 and own.sum() <= 1000 and (own**2).sum() <= 120_000
            o = np.sort(offset[where == b])
            assert o[0] == 0
    free, _ = packing.best_fit(lengths, (1000.0, 1000.0, 1e6))
    assert free.max() + 1 <= -(-lengths.sum() // 1000) + 1


def test_packing_edge_rows(spark):
    data = [(1, None), (2, ""), (3, "word " * 40_000), (4, "twin"), (4, "twin"), (None, "x")]
    df = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, length int")
    rows = packing.pack_documents(df).collect()
    check_sequences(rows, 4096)
    assert Counter(r.doc_id for r in rows) == Counter({1: 1, 2: 1, 3: 10, 4: 2, None: 1})
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_shards_hold_the_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = catalog.op2_uniform_shards(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id, len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_edge_rows(spark):
    data = [(1, None), (2, ""), (None, "é"), (None, "é")] + [(9, "same")] * 100
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, shard string")
    rows = sharding.shard_rows(df, shards=5).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 104 and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)
    assert sharding.shard_rows(df.limit(0)).count() == 0
    few = sharding.shard_rows(df.limit(3)).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}


def test_matrix_sums_and_law():
    m = sharding.communication_matrix([5, 0, 17, 8], [8, 7, 8, 7], seed=4)
    assert [sum(r) for r in m] == [5, 0, 17, 8] and [sum(c) for c in zip(*m)] == [8, 7, 8, 7]
    rng, n = random.Random(1), 20_000
    got = Counter(sharding.hypergeometric(rng, 7, 20, 9) for _ in range(n))
    from math import comb
    for k in range(8):
        p = comb(7, k) * comb(13, 9 - k) / comb(20, 9)
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_each_row_reaches_each_shard_evenly(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").cache()
    seen, pairs = Counter(), 0
    for seed in range(12):
        shard = {r.doc_id: r.shard for r in sharding.shard_rows(df, shards=4, seed=seed).collect()}
        seen.update(zip(shard.keys(), shard.values()))
        pairs += sum(shard[2 * i] == shard[2 * i + 1] for i in range(200))
    by_row = Counter(d for d, _ in seen.elements())
    assert set(by_row.values()) == {12}
    assert abs(pairs / 2400 - 99 / 399) < 0.05  # two given rows share a shard as in a uniform permutation
