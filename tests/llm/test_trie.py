"""Prefix trie: plain rebuilding and counting, small blocks and rounds, edge rows, hot conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from curata.llm import catalog, scan, trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        own[c].sort(key=lambda r: r[:2])
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(int(c / 20) * 20, [])
        seq = [r[2:] for r in base[:h]] + [r[2:] for r in own[c][h:]]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        last = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[q] for q in kids[p]) + (len(nodes[p]) - 1) * last
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items())


def got(df):
    return sorted(tuple(r[c] for c in RESULT) for r in df.collect())


def test_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got(catalog.op11_prefix_trie(spark, SF)) == want
    rows = trie.prefix_trie(df, block=16, base=20).collect()  # many blocks, several rounds
    assert sorted(tuple(r[c] for c in RESULT) for r in rows) == want
    # the tour: every place once, a subtree between its node's arcs, parents around children
    assert sorted([r.enter for r in rows] + [r.exit for r in rows]) == list(range(2 * len(rows)))
    by = {(r.conv_id, r.depth): r for r in rows}
    assert all(by[r.parent_conv_id, r.depth - 1].enter < r.enter < r.exit < by[r.parent_conv_id, r.depth - 1].exit for r in rows if r.depth)


def test_edge_rows(spark):
    data = [(0, 0, "user", "a b"), (0, 1, "assistant", None), (0, 2, None, "c"), (0, 3, "user", "x"), (1, None, "user", "first"), (1, 0, "user", "second"),
            (1, 1, "user", "third"), (1, 1, "user", "third"), (1, 2, "user", "fourth"), (2, 0, "user", ""), (None, 0, "user", "gone"), (None, 1, "u", "gone"),
            (25, 0, "user", "no base"), (-3, 0, "user", "a b"), (-3, 1, "user", "z z z")]
    df = spark.createDataFrame([(*r, r[0], "clash") for r in data], SCHEMA + ", depth long, id string")
    assert got(trie.prefix_trie(df)) == plain(data)
    assert got(trie.prefix_trie(df.union(df))) == plain(data + data)
    assert got(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_deep_and_wide(spark):
    rng = random.Random(3)
    data = [(c, t, "user", rng.choice("ab") + " w") for c in range(0, 900, 3) for t in range(rng.randrange(1, 9))]
    data += [(5000, t, "user", f"t{t}") for t in range(700)] + [(5020, t, "user", f"t{t}") for t in range(650)]  # long paths
    df = spark.createDataFrame(data, SCHEMA)
    want = plain(data)
    assert got(trie.prefix_trie(df)) == want == got(trie.prefix_trie(df, block=7, base=5))


def test_hot_conversation_is_cut(spark):
    data = [(40, t, "user", f"t{t}") for t in range(4000)] + [(c, 0, "user", "x") for c in range(2000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    turns = trie.numbered_turns(df)
    assert {(r.conv_id, r.pos) for r in turns.collect()} == {(c, t) for c, t, *_ in data} | {(40, 4000)}  # 40 also has the turn of range(2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in scan.sorted_ranges(turns, ["conv_id", "pos"]).selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 2000  # the conversation lies in several ranges


def test_digests_stream_long_lists(spark):
    data = [(k, i) for k in (1, 2, 3) for i in range(9000 if k == 2 else 5 * k)]
    df = spark.createDataFrame(data, "k long, at long").selectExpr("k", "at", "CAST(at AS STRING) AS s")
    want = {k: hashlib.sha256(",".join(str(i) for q, i in data if q == k).encode()).hexdigest() for k in (1, 2, 3)}
    assert {r.k: r.sha256 for r in scan.digests(scan.sorted_ranges(df, ["k", "at"]), ["k"], "at", "s", b",").collect()} == want
    alone = df.selectExpr("k", "at", "s", "true AS alone").repartition(3, "k").sortWithinPartitions("k", "at")
    assert {r.k: r.sha256 for r in scan.digests(alone, ["k"], "at", "s", b",", alone="alone").collect()} == want
