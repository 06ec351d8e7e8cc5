"""Spaced seeds: lossless masks, every overlap found, nothing else, edge rows."""

import itertools
import random
import re

import regex
from pyspark.sql import functions as F

from curata.llm import catalog, decontaminate as D

SF = "/root/testdata/sf0.01"


def test_masks_are_lossless():
    for gone in itertools.combinations(range(D.WINDOW), D.SUBSTITUTED):
        assert any(not {o + x for x in mask} & set(gone) for mask in D.MASKS for o in range(D.WINDOW - mask[-1]))


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def plain(docs, items):
    """Best window of every document against every item, by anchors on single tokens."""
    out = {}
    index = {}
    for item, text in items:
        w = words(text)
        for j, x in enumerate(w):
            index.setdefault(x, []).append((item, j, w))
    for doc, text in docs:
        own = words(text)
        seen = set()
        for i, x in enumerate(own):
            for item, j, w in index.get(x, ()):
                if (item, i - j) in seen:
                    continue
                seen.add((item, i - j))
                lo, hi = max(0, i - j), min(len(own), len(w) + i - j)
                eq = [own[k] == w[k - i + j] for k in range(lo, hi)]
                best = max((sum(eq[s:s + D.WINDOW]) for s in range(len(eq) - D.WINDOW + 1)), default=0)
                if best >= D.WINDOW - D.SUBSTITUTED:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def test_documents_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(docs, items).collect()}
    assert got == want and len(got) > 5
    rows = catalog.op8_decontaminate(spark, SF).collect()
    assert {r.doc_id for r in rows if r.contaminated} == {d for d, _ in want} and len(rows) == docs.count()
    assert D.clean(docs, items).count() == docs.count() - len({d for d, _ in want})
    passes = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(docs, items, per_pass=1500).collect()}
    assert passes == want


def test_substitutions_and_edge_rows(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(30)]
    docs, want = [], {}
    for n in range(60):
        changed = list(item)
        for k in rng.sample(range(30), n % 9):
            changed[k] = f"x{n}"
        docs.append((n, "Start here, " + " -- ".join(changed).upper() + ". The end.", "keep"))
    docs += [(100, None, "a"), (101, "", "a"), (102, " ".join(item[:12]), "a"), (103, " ".join(item[4:17]), "a"), (103, " ".join(item[4:17]), "a"),
             (None, " ".join(item), "a"), (104, "filler " * 90_000 + " ".join(item[3:20]), "a"), (105, "w1 " * 500, "a")]
    items = [(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(item)), (None, " ".join(f"q{i}" for i in range(20)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, n_items string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain([(d, t) for d, t, _ in docs], [(i, t) for i, t in items if t])
    assert {(r.doc_id, r.item_id): r.matched for r in D.overlaps(df, bench).collect()} == want
    rows = D.contamination(df, bench).collect()
    assert len(rows) == len(docs) and sum(r.doc_id == 103 and r.contaminated and r.n_items == 2 for r in rows) == 2
    left = D.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert D.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert D.contamination(df.limit(0), bench).count() == 0


def test_main_path_has_no_python(spark):
    plan = catalog.op8_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parts_are_lossless():
    for n in range(1, D.WINDOW):
        allowed = n - D.least_equal(n)
        assert [x for a, b in D.parts(n) for x in range(a, b)] == list(range(n))
        for gone in itertools.combinations(range(n), allowed):
            assert any(not set(range(a, b)) & set(gone) for a, b in D.parts(n))


def test_short_items(spark):
    """Items of 1 to 12 tokens, quoted whole, with substitutions, cut off, and out of order."""
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 13)] + [(50, "i3x0 i3x1 i3x2"), (51, "--")]
    docs, want = [], set()
    for n in range(1, 13):
        own = items[n - 1][1].split()
        for changes in range(3):
            for _ in range(4):
                w = list(own)
                for k in rng.sample(range(n), min(n, changes)):
                    w[k] = "other"
                docs.append((len(docs), ("" if rng.random() < 0.3 else "Said: ") + " ".join(w).upper() + rng.choice(["", "! he said"])))
                if sum(a != b for a, b in zip(own, w)) <= (1 if n >= 7 else 0):
                    want |= {(docs[-1][0], n)} | ({(docs[-1][0], 50)} if n == 3 else set())
        if n > 2:
            docs += [(len(docs), " ".join(own[:-2])), (len(docs) + 1, " ".join(reversed(own)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.overlaps(df, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in D.overlaps(df, bench, per_pass=60).collect()} == want
    assert {r.doc_id for r in D.clean(df, bench, shortest=1).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_scripts_without_spaces(spark):
    zh, ja, th = "中国的首都是北京它是一个非常古老的城市", "日本で一番高い山は富士山ですがとても美しい", "กรงเทพมหานครเปนเมองหลวงของประเทศไทย"
    docs = [(1, "他说" + zh + "对吗"), (2, "前置き" + ja.replace("高", "低") + "。"), (3, "ค" + th + "ค"), (4, "中国的首都在哪里"), (5, "nothing here")]
    items = [(1, zh), (2, ja), (3, th)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.overlaps(df, bench).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_long_and_repeated_items_are_dealt_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(D, "PIECE", 40)
    item = [f"w{rng.randrange(500)}" for _ in range(400)]
    docs, want = [], {}
    for k in range(60):
        at, n = rng.randrange(0, 380), rng.randrange(11, 20)
        part = item[at:at + n]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "other"
        docs.append((k, " ".join([f"x{k}"] * 20 + part + [f"y{k}"] * 20)))
    items = [(1, " ".join(item))] * 300 + [(2, " ".join(item[:100])), (3, "same " * 50)]
    docs.append((99, "same " * 200))
    want = plain(docs, [(1, " ".join(item)), (2, " ".join(item[:100])), (3, "same " * 50)])
    spread = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (D.SEEDS_PER_PASS, 200):
        got = {(r.doc_id, r.item_id): (r.matched, r.item_tokens) for r in D.overlaps(spread, table, per_pass=per_pass).collect()}
        assert {k: m for k, (m, _) in got.items()} == want and all(n == {1: 400, 2: 100, 3: 50}[i] for (_, i), (_, n) in got.items())


def test_rows_of_positions_join_up(spark, monkeypatch):
    """Passages, long and short, that lie across the edges of a document's rows."""
    monkeypatch.setattr(D, "ROW", 16)
    rng = random.Random(9)
    item, short = [f"w{rng.randrange(60)}" for _ in range(45)], [f"s{i}" for i in range(8)]
    docs, want_short = [], set()
    for k in range(60):
        at, n = rng.randrange(0, 32), rng.randrange(11, 46)
        part = item[at:at + n]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "other"
        quoted = short[:6] + ["other"] * (k % 3) + short[6 + k % 3:]
        docs.append((k, " ".join([f"x{k}"] * k + part + [f"y{k}"] * (k % 5) + quoted + ["z"] * (k % 7))))
        want_short |= {(k, 2)} if k % 3 < 2 else set()
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(item))]
    want = plain(docs, items[::2])
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (D.SEEDS_PER_PASS, 100):
        got = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(df, bench, per_pass=per_pass).collect()}
        assert {k: m for k, m in got.items() if k[1] != 2} == want and {k for k in got if k[1] == 2} == want_short


def test_hits_do_not_carry_their_document(spark):
    """A document of 80,000 tokens that quotes an item 2000 times: with its whole array in each hit they would take over 100 GB."""
    item = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(item * 2000)), (2, "nothing here " * 20)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, "w1 w2 w3")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched) for r in D.overlaps(df, bench).collect()} == {(1, 7, 13), (1, 8, 13), (1, 9, 3)}
    own = df.select("doc_id", F.lit(0).alias("text_hash"), D.token_hashes(F.col("text")).alias("tokens"))
    long = bench.filter("item_id = 7").select(F.col("item_id").alias("item"), D.token_hashes(F.col("text")).alias("theirs"))
    sizes = D.first_hits(own, long).select(F.size("near")).toPandas()
    assert sizes.iloc[:, 0].max() < 3 * D.WINDOW and len(sizes) <= 4 * 2000 * len(D.MASKS)


def test_unspaced_blocks_hold_the_scripts():
    blocks = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), D.UNSPACED)) + "]")
    scripts = regex.compile("[" + "".join(rf"\p{{{x}}}" for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar")) + "]")
    letter = regex.compile(r"[\p{L}\p{N}]")
    odd = [hex(c) for c in range(0x110000) if letter.match(chr(c)) and bool(blocks.match(chr(c))) != bool(scripts.match(chr(c)))]
    assert len(odd) < 700, odd[:50]
