"""Jaccard join against brute force over all pairs; blocks, bounds, edge rows."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from curata.llm import catalog, jaccard

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows, percent=80):
    """doc -> (size, smallest id of its component), all pairs that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                common[j] += 1
            index[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df, **kw):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, **kw).collect())


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in catalog.op3_jaccard_join(spark, SF).collect())
    assert found == plain_groups(rows)
    assert sum(d != c for d, _, c in found) > 50


def variants(seed, n, size, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own[:rng.randrange(size - size // 10, size + 1)]))
    return out


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_copies_around_the_threshold(spark, monkeypatch, tile):
    """Groups of variants whose pairs lie on both sides of the threshold, over several blocks."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = variants(1, 90, 60, 6) + variants(2, 60, 200, 14) + variants(3, 30, 9, 2) + ["the same words again and again"] * 20
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(9)
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))) + " " + passage for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == plain_groups(rows)
    if tile == 8:
        assert got(df, percent=60) == plain_groups(rows, 60)


def test_exact_boundary(spark):
    """8 of 10 shingles in common is a link, 7 of 10 and 79 of 99 are not."""
    w = [f"a{i}" for i in range(200)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[:12] + ["b", "c"])), (3, " ".join(w[20:33])), (4, " ".join(w[21:33])),
            (5, " ".join(w[50:150])), (6, " ".join(w[60:150] + ["q"] * 3)), (7, "ONE two"), (8, "one TWO"), (9, "one two three"), (10, "É x"), (11, "é x")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for n in range(1, 400):
        p, lead = jaccard.prefix_sizes(n, 80)
        assert p == n - -(-80 * n // 100) + 1 and lead == n - -(-160 * n // 180) + 1
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        bits = sum((x ^ y).bit_count() for x, y in zip(jaccard.bitmap(a), jaccard.bitmap(b)))
        assert jaccard.bits_apart(jaccard.bitmap(a), jaccard.bitmap(b)) == bits
        assert (len(a) + len(b) - bits) / 2 >= len(np.intersect1d(a, b))
    for n in (513, 3000, 20_000):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 9:], rng.integers(0, 1 << 62, n, dtype=np.uint64)]))
        bits = jaccard.bits_apart(jaccard.wide_bitmap(a), jaccard.wide_bitmap(b))
        assert (len(a) + len(b) - bits) / 2 >= len(np.intersect1d(a, b)) and bits > n // 2
    assert jaccard.wide_bitmap(a[:512]) is None and len(jaccard.wide_bitmap(a[:513])) * 8 == 2048


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(259, 3), (-5, 7), (900, 901), (901, 900)]
    out = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161)) and {out[x] for x in [3, 7, *range(200, 260)]} == {-5}
    assert out[901] == out[900] == 900 and len(out) == len(set(itertools.chain(*edges)))


def test_bitset_holds_every_id(spark):
    ids = [1, 63, 64, -1, -64, 1 << 40, (1 << 62) + 5]
    bits = jaccard.id_bitset(spark.createDataFrame([(i,) for i in ids] + [(None,)], "x long"), "x")
    assert jaccard.in_bitset(bits, np.array(ids)).all() and not jaccard.in_bitset(bits, np.array([2, 62, 100])).any()


def test_edge_rows(spark):
    long = "word " * 3 + " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, long), (7, long + " tail"), (8, "twin text of five words"),
            (8, "twin text of five words"), (9, " ")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int")
    assert got(df) == plain_groups(rows)
    assert got(df.limit(0)) == [] and got(df.filter("doc_id < 4")) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    nulls = spark.createDataFrame([(None, "p q r s t u v"), (12, "p q r s t u v"), (None, "alone here now")], "doc_id long, text string")
    assert sorted(jaccard.jaccard_groups(nulls).collect(), key=str) == sorted([(None, 3, 12), (12, 3, 12), (None, 1, None)], key=str)


def plain_links(rows, percent=80):
    """doc -> other rows that link with it, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    n = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            n[i] += 1
            n[j] += 1
    return sorted((d, k) for (d, _), k in zip(rows, n))


@pytest.mark.parametrize("block", [7, 256])
def test_every_link_is_counted(spark, monkeypatch, block):
    """Components of many different near copies, copies of them, pairs and loners, in one and in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    texts = variants(11, 70, 60, 6) + variants(12, 40, 200, 14) + variants(13, 2, 90, 2)
    texts += texts[:9] + texts[5:12] + ["twin one two three four five"] * 4 + ["", None, "alone here"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.jaccard_links(df).collect()
    assert sorted((r.doc_id, r.n_links) for r in out) == plain_links(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_groups(rows)
    assert max(r.n_links for r in out) > 20


def test_links_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = catalog.op3_jaccard_links(spark, SF).collect()
    assert sorted((r.doc_id, r.n_links) for r in out) == plain_links(rows)


def test_intersections_of_a_tile(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 8)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80), dtype=np.uint64)) for _ in range(40)]
    out = jaccard.intersections(sets)
    assert all(out[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)
