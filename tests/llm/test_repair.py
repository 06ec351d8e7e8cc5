"""Structure repair: the agenda against exhaustive search and a plain table, whole tables, edge rows, long conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from curata.llm import catalog, repair as R

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def dealt(letter):
    fault, kind = divmod(ord(letter) - 65, 4)
    return "sua."[kind], fault in (R.BLANK, R.DUPLICATE), int(fault == R.TRUNCATED)


def table(letters):
    """Cheapest (cost, audit) by a plain table over (row, state)."""
    best = {(0, 0): (0, "")}

    def better(k, v):
        if k not in best or v < best[k]:
            best[k] = v

    for i in range(len(letters) + 1):
        for _ in range(4):
            for q, r in R.AFTER:
                if (i, q) in best and r in "ua":
                    better((i, R.AFTER[q, r]), (best[i, q][0] + 2, best[i, q][1] + "I"))
        for q in range(4) if i < len(letters) else ():
            if (i, q) in best:
                role, gone, more = dealt(letters[i])
                cost, audit = best[i, q]
                better((i + 1, q), (cost + 3, audit + "D"))
                if not gone:
                    if (q, role) in R.AFTER:
                        better((i + 1, R.AFTER[q, role]), (cost + more, audit + "K"))
                    for r in "ua":
                        if (q, r) in R.AFTER:
                            better((i + 1, R.AFTER[q, r]), (cost + 2 + more, audit + "R"))
    return min(best[len(letters), q] for q in R.ACCEPT if (len(letters), q) in best)


def every(letters):
    """All repairs with at most two insertions at a place, filtered by the pattern itself."""
    places = ["", "u", "a", "ua", "au", "uu", "aa"]
    found = []
    options = []
    for letter in letters:
        role, gone, more = dealt(letter)
        options.append([("D", "", 3)] + ([] if gone else [("K", role, more), ("R", "u", 2 + more), ("R", "a", 2 + more)]))
    for edits in itertools.product(*options):
        for put in itertools.product(places, repeat=len(letters) + 1):
            roles = put[0] + "".join(e[1] + p for e, p in zip(edits, put[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:]))
                found.append((sum(e[2] for e in edits) + 2 * sum(map(len, put)), audit))
    return min(found)


def test_agenda_equals_exhaustive_search():
    rng = random.Random(1)
    letters = [chr(65 + i) for i in range(16)]
    for n in (0, 1, 2, 3):
        for own in ["".join(x) for x in itertools.product(letters, repeat=n)] if n < 2 else ["".join(rng.choices(letters, k=n)) for _ in range(12)]:
            assert min(R.through(own, {0: (0, "")}, True).values()) == every(own) == table(own)


def test_blocks_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        own = "".join(rng.choices([chr(65 + i) for i in range(16)], k=rng.randrange(1, 200)))
        want = table(own)
        size = rng.randrange(1, 40)
        assert R.cheapest([own[i:i + size] for i in range(0, len(own), size)]) == want == R.cheapest([own])
        roles = "".join(role[0] if role else dealt(own[at])[0] for at, role in R.lines(want[1], own))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_agenda_pops_in_order():
    edges = [(("a", "b"), "c", 1, "x"), (("a",), "d", 5, "y"), (("c",), "d", 1, "z"), (("d",), "e", 0, "w")]
    final = R.lightest({"a": (0, ""), "b": (2, "q")}, edges, ("e",))
    assert final["c"] == (3, "qx") and final["d"] == (4, "qxz") and final["e"] == (4, "qxzw")
    assert list(final.values()) == sorted(final.values())


def damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = out[c]
        if case:
            x = "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x
            own += [(t, "user" if case == 4 else r, x)] * (2 if case == 3 else 1)
    return out


def plain(convs):
    out = []
    for c, own in convs.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in own if t is not None]
        seen, letters = set(), ""
        for _, r, x in own:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            fault = R.BLANK if not bare else R.DUPLICATE if (r, x) in seen else R.TRUNCATED if bare[-1] not in ".!?" else R.FINE
            letters += chr(65 + 4 * fault + {"s": 0, "u": 1, "a": 2}.get(r[:1], 3))
            seen.add((r, x))
        cost, audit = table(letters)
        said, at, state = [], 0, 0
        for e in audit:
            if e == "D":
                at += 1
                continue
            role = own[at][1] if e == "K" else "assistant" if state == 2 else "user"
            state = R.AFTER[state, role[0]]
            said.append(role + ":" + ("" if e == "I" else own[at][2]))
            at += e != "I"
        count = [sum((ord(x) - 65) // 4 == f for x in letters) for f in (R.BLANK, R.DUPLICATE, R.TRUNCATED)]
        illegal = sum(a[1][:1] + b[1][:1] not in R.LEGAL for a, b in zip(own, own[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_equals_plain(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(catalog.op13_structure_repair(spark, SF)) == plain(damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_edge_rows(spark):
    data = [(1, None, "system", "S."), (1, 0, "user", "a."), (1, 4, None, "b."), (1, 5, "assistant", None), (2, 0, "tool", "x."), (None, 0, "user", "n."),
            (None, None, "assistant", "m."), (0, 0, "user", "zero."), (3, 0, "", ""), (4, 0, "user", "t é"), (4, 1, "assistant", "end?\n \t"),
            (5, 0, "uncle", "U."), (5, 1, "aunt", "A."), (6, 0, "user", "long " * 50_000 + ".")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in data], SCHEMA + ", c string, pos int")
    asis = defaultdict(list)
    for c, t, r, x in data:
        asis[c].append((t, " " if r is None else r, " " if x is None else x))
    assert got(R.repair_conversations(df)) == plain(asis)
    assert got(R.repair_conversations(R.damaged(df))) == plain(damage(data))
    twice = defaultdict(list)
    for c, rows in asis.items():
        twice[c] = [r for r in rows for _ in range(2)]
    assert [r[:8] for r in got(R.repair_conversations(df.union(df)))] == [r[:8] for r in plain(twice)]
    assert got(R.repair_conversations(spark.createDataFrame([], SCHEMA))) == []
    dropped = df.selectExpr("conv_id", "turn", "role", "text", "0 AS copies")
    assert {r[1:] for r in got(R.repair_conversations(dropped))} == {(0, 0, 0, 0, 0, 0, "", R.NOTHING)}


def test_long_conversation(spark):
    rng = random.Random(5)
    data = [(9, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"t {t}.", f"t {t}"])) for t in range(3000)]
    data += [(c, 0, "user", "x.") for c in range(100, 150)]
    convs = defaultdict(list)
    for c, t, r, x in data:
        convs[c].append((t, r, x))
    assert got(R.repair_conversations(spark.createDataFrame(data, SCHEMA).repartition(4))) == plain(convs)
