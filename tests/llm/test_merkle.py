"""Merkle fingerprints: equality, likeness, edits, and the neighbours against a plain loop."""

import hashlib
import random

from curata.llm import catalog, merkle


def test_equal_texts_and_roots():
    a = "One. Two!\nThree.\n\nFour? " * 20
    assert merkle.fingerprint(a) == merkle.fingerprint("" + a)
    assert merkle.fingerprint(None) == merkle.fingerprint("")
    seen = {merkle.fingerprint(x) for x in ("", " ", "\n", "\n\n", "a", "a\n", "a.", "a. b", "a .b", ".", "..")}
    assert len(seen) == 11
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("x")) == 0.0


def test_an_edit_is_located_and_lowers_likeness():
    rng = random.Random(3)
    lines = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(8)) + f" {i}.\n" for i in range(200)]
    a = merkle.fingerprint("".join(lines))
    b = merkle.fingerprint("".join(lines[:90] + ["new line here.\n"] + lines[91:]))
    c = merkle.fingerprint("".join(lines[:90] + ["put in.\n"] + lines[90:]))
    assert len(merkle.differing(a, b)) <= 2 and merkle.differing(a, a) == []
    assert 0.98 < merkle.likeness(a, b) < 1 and 0.98 < merkle.likeness(a, c) < 1
    assert merkle.likeness(a, merkle.fingerprint("".join(reversed("".join(lines))))) < 0.05


def plain(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        own, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(own) // 2
        edited = own[:len(own) - h] + other[:h]
        f, e, o = merkle.fingerprint(own), merkle.fingerprint(edited), merkle.fingerprint(other)
        out[doc] = (doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), f, e, merkle.likeness(f, e), merkle.likeness(f, o))
    return out


def test_neighbours_equal_a_plain_loop(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = catalog.op6_merkle(spark, "/root/testdata/sf0.01").collect()
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == len(want) and {r.doc_id: tuple(r) for r in got} == want


def test_uneven_ids_nulls_and_small_tables(spark):
    rng = random.Random(5)
    rows = [(int(1.5 ** (i % 90)) * 7 + i, None if i % 9 == 0 else f"text {i}. " * (i % 13)) for i in range(400)]
    rows = list({a: (a, b) for a, b in rows}.values())
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, bucket int")
    assert {r.doc_id: tuple(r) for r in merkle.against_neighbours(df).collect()} == plain(rows)
    one = df.limit(1)
    assert merkle.against_neighbours(one).count() == 1
    assert merkle.against_neighbours(df.limit(0)).count() == 0
    again = df.limit(3).union(df.limit(3)).union(spark.createDataFrame([(None, "x", 1), (None, None, 2)], df.schema))
    assert merkle.against_neighbours(again).count() == 8
    assert merkle.fingerprints(again).count() == 8
