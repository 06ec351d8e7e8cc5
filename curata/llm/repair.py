"""Operator 13, repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation is legal where its role initials match ``(s?(ua)+)?``.  Edits keep (K, 0), rerole to user or assistant (R, 2), delete (D, 3) a
row or insert (I, 2) an empty turn; a truncated row that stays adds 1; blank and repeated rows must go.  The repair is a
weighted hypergraph: items are *row i* (axioms) and *rows before i edited, pattern in state q*; a hyperedge
leads from ``(i, q)`` and row ``i`` to ``(i + 1, q')``, an insertion from ``(i, q)`` to ``(i, q')``.  A derivation is worth (cost, audit), the audit being
the edits' initials; a hyperedge adds its weight and appends its letter.  That is superior, since both only grow, and monotone: two audits of one
item and cost never extend one another (the longer would only add insertions, at 2 each).  So items leave the agenda in final form, cheapest first, and the first
goal item is the cheapest repair, of ASCII-least audit.

What moves by conversation is one letter for each row (role class and fault), in blocks of ``ROWS``: a
conversation of any length is blocks that the agenda goes through in order, from the items at one block's end to the next one's,
and what the audits of the four states have in common is final and leaves them.  Places of rows come from a scan over ranges, repeated rows
from an aggregate over hashes.  Texts are shuffled only to be put in line, in chunks of ``LINES``; their digest is streamed (``scan.digests``).

Nulls: conv_id is an id of its own, turns stand first, role and text are one space (so such a text is blank and such a role illegal).  An empty text is
blank.  Rows of equal turn stand in order of their hashes.  Repeated rows are duplicates.  An empty table has no conversation.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import staged
from .scan import digests, running

ROWS, LINES = 512, 256
#: Initials of the roles, what follows each of them by the pattern's states (0 start, 1 after s, 2 after u, 3 after a), accepting states.
ROLES = "sua"
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
LEGAL = ("su", "ua", "au")
#: Faults in the order in which they count; a row's letter is chr(65 + 4 * fault + class), classes s, u, a, other.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
SPACES = " \t\n\x0b\x0c\r"
NOTHING = hashlib.sha256(b"").hexdigest()


# --- the agenda ----------------------------------------------------------------


def lightest(axioms: dict, edges: list[tuple], goals: tuple = ()) -> dict:
    """Final (cost, audit) of items, in the order in which the agenda pops them, up to the first of ``goals``.
    ``edges``: (tail items, head item, weight, letter)."""
    waits: dict = {}
    for e, (tails, *_) in enumerate(edges):
        for t in tails:
            waits.setdefault(t, []).append(e)
    missing = [len(tails) for tails, *_ in edges]
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item in goals:
            break
        for e in waits.get(item, ()):
            missing[e] -= 1
            if not missing[e]:
                tails, head, weight, letter = edges[e]
                if head not in final:
                    cost, audit = zip(*(final[t] for t in tails))
                    heapq.heappush(agenda, ((sum(cost) + weight, "".join(audit) + letter), head))
    return final


def _item(i: int, q: int) -> int:
    """Rows before ``i`` edited, in state ``q``; state 4 is row ``i`` itself."""
    return 5 * i + q


@lru_cache(maxsize=64)
def _row_edges(letter: str, q: int) -> tuple:
    """(state after, weight, edit) of the ways to deal with a row."""
    fault, kind = divmod(ord(letter) - 65, 4)
    out = [(q, DELETE[1], DELETE[0])]
    if fault in (FINE, TRUNCATED):
        more = int(fault == TRUNCATED)
        if kind < 3 and (q, ROLES[kind]) in AFTER:
            out.append((AFTER[q, ROLES[kind]], KEEP[1] + more, KEEP[0]))
        out += [(AFTER[q, r], REROLE[1] + more, REROLE[0]) for r in "ua" if (q, r) in AFTER and (kind == 3 or ROLES[kind] != r)]
    return tuple(out)


def block_edges(letters: str) -> list[tuple]:
    edges = [((_item(i, q),), _item(i, AFTER[q, r]), INSERT[1], INSERT[0])
             for i in range(len(letters) + 1) for q in range(4) for r in "ua" if (q, r) in AFTER]
    edges += [((_item(i, q), _item(i, 4)), _item(i + 1, to), weight, edit)
              for i, letter in enumerate(letters) for q in range(4) for to, weight, edit in _row_edges(letter, q)]
    return edges


def through(letters: str, entry: dict[int, tuple], last: bool) -> dict[int, tuple]:
    """(cost, audit) by state after a block, from those before it; after the last one, the goal's alone."""
    n = len(letters)
    axioms = {_item(0, q): value for q, value in entry.items()} | {_item(i, 4): (0, "") for i in range(n)}
    final = lightest(axioms, block_edges(letters), tuple(_item(n, q) for q in ACCEPT) if last else ())
    out = {q: final[_item(n, q)] for q in range(4) if _item(n, q) in final}
    return {q: v for q, v in out.items() if q in ACCEPT} if last else out


@lru_cache(maxsize=20_000)
def _short(letters: str) -> tuple[int, str]:
    return min(through(letters, {0: (0, "")}, True).values())


def cheapest(blocks: list[str]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation, given in blocks."""
    if len(blocks) == 1 and len(blocks[0]) <= 64:
        return _short(blocks[0])
    done, entry = [], {0: (0, "")}
    for k, letters in enumerate(blocks):
        entry = through(letters, entry, k == len(blocks) - 1)
        same = commonprefix([audit for _, audit in entry.values()])
        done.append(same)
        entry = {q: (cost, audit[len(same):]) for q, (cost, audit) in entry.items()}
    cost, rest = min(entry.values())
    return cost, "".join(done) + rest


def lines(audit: str, letters: str) -> Iterator[tuple[int | None, str | None]]:
    """For each turn of the repaired conversation the row that it comes from (None: inserted) and its new role (None: its own)."""
    q, at = 0, 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = ROLES[(ord(letters[at]) - 65) % 4] if edit == "K" else "a" if q == 2 else "u"
        q = AFTER[q, role]
        yield (None if edit == "I" else at), (None if edit == "K" else {"u": "user", "a": "assistant"}[role])
        at += edit != "I"


# --- rows -------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that the query repairs: conv_id, turn, role, text, copies (0: dropped)."""
    blank = F.lit(" ")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    case = F.crc32(name.cast("binary")) % 20
    return own.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))


def with_keys(turns: DataFrame) -> DataFrame:
    """The rows with c, none (the conversation, null or not), u, v (hashes of role and text), copies; nulls replaced."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    said = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text")]
    c = F.col("conv_id").cast("long")
    return turns.select(F.coalesce(c, F.lit(0).cast("long")).alias("c"), c.isNull().cast("long").alias("none"), F.col("turn").cast("long").alias("turn"),
                        said[0].alias("role"), said[1].alias("text"), F.xxhash64(F.lit(1), *said).alias("u"), F.xxhash64(F.lit(2), *said).alias("v"),
                        copies.cast("int").alias("copies"))


def _letter(fault: Column) -> Column:
    return F.chr((65 + 4 * fault + F.col("kind")).cast("long"))


def classed_rows(rows: DataFrame) -> DataFrame:
    """none, c, pos, turn, u, v, letter of every row that exists, from ``with_keys``'s narrow columns and flags."""
    split = (rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
             .withColumns({"one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()}).drop("copies"))
    placed = running(staged(split, "rows"), ["none", "c"], ["turn", "r", "u", "v", "row"], add=["one"], name="places")
    placed = placed.withColumn("pos", F.col("run_one") - 1)
    again = (placed.groupBy("none", "c", "u", "v").agg(F.min("pos").alias("seen"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    both = placed.join(again, ["none", "c", "u", "v"], "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("seen"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE))
    return staged(both.select("none", "c", "pos", "turn", "u", "v", _letter(fault).alias("letter")), "letters")


def _repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each conversation, whose blocks follow each other, a row of results (kind 0) and one for each turn of the repaired one (kind 1)."""
    def result(own: tuple, blocks: list[str]) -> Iterator[tuple]:
        whole = "".join(blocks)
        codes = [divmod(ord(x) - 65, 4) for x in whole]
        roles = ["sua."[k] for _, k in codes]
        count = [sum(f == fault for f, _ in codes) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
        cost, audit = cheapest(blocks)
        n = len(audit) - audit.count("D")
        yield (*own, 0, None, n, None, None, *count, illegal, cost, audit)
        for i, (pos, role) in enumerate(lines(audit, whole)):
            yield (*own, 1, i, n, pos, role, None, None, None, None, None, None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    own, blocks, rows = None, [], []
    for b in batches:
        for none, c, letters in zip(*(b.column(x).to_pylist() for x in ("none", "c", "letters"))):
            if own != (none, c):
                for row in result(own, blocks) if own else ():
                    rows.append(row)
                    if len(rows) == 1 << 15:
                        yield batch(rows)
                        rows = []
                own, blocks = (none, c), []
            blocks.append(letters)
    for row in result(own, blocks) if own else ():
        rows.append(row)
        if len(rows) == 1 << 15:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


RESULT = ("none long, c long, kind int, line long, n long, pos long, new_role string, "
          "blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of
    ``turns`` (conv_id, turn, role, text and, where rows stand several times or not at all, copies)."""
    keyed = with_keys(turns)
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    narrow = staged(keyed.withColumn("end", F.substring(stripped, -1, 1)).select(
        "none", "c", "turn", "u", "v", F.xxhash64("role").alias("r"), "copies", (F.col("end") == "").alias("blank"), (~F.col("end").isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind")), "narrow")
    times = (narrow.filter("copies > 0").groupBy("none", "c", "turn").agg(F.lit(1).alias("x")).groupBy("none", "c")
             .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    every = narrow.select("none", "c").distinct().join(times, ["none", "c"], "left")
    rows = classed_rows(narrow)
    blocks = (rows.groupBy("none", "c", F.floor(F.col("pos") / ROWS).alias("block"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("letters")))
    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    ordered = staged(blocks, "blocks").repartition("none", "c").sortWithinPartitions("none", "c", "block").select("none", "c", "letters")
    found = staged(ordered.mapInArrow(lambda b: _repairs(b, schema), RESULT), "repairs")

    kept = (found.filter("kind = 1 AND pos IS NOT NULL").select("none", "c", "pos", "line", "n", "new_role")
            .join(rows.select("none", "c", "pos", "turn", "u", "v"), ["none", "c", "pos"]))
    texts = keyed.filter("copies > 0").select(*[F.col(x).alias(f"t_{x}") for x in ("none", "c", "turn", "u", "v")], "role", "text")
    same = [F.col(x) == F.col(f"t_{x}") for x in ("none", "c", "u", "v")] + [F.col("turn").eqNullSafe(F.col("t_turn"))]
    own = kept.join(texts, same).select("none", "c", "line", "n", F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")).alias("said"))
    put = found.filter("kind = 1 AND pos IS NULL").select("none", "c", "line", "n", F.concat("new_role", F.lit(":")).alias("said"))
    said = (own.unionByName(put).withColumns({"chunk": F.floor(F.col("line") / LINES), "alone": F.col("n") <= LINES}).repartition("none", "c", "chunk")
            .sortWithinPartitions("none", "c", "chunk", "line"))
    sha = digests(said, ["none", "c"], "line", "said", b"\n", run=["chunk"], alone="alone", name="said")
    zero = F.lit(0).cast("long")
    return (every.join(found.filter("kind = 0").drop("pos", "line", "n", "new_role", "kind"), ["none", "c"], "left").join(sha, ["none", "c"], "left")
            .select(F.when(F.col("none") == 0, F.col("c")).alias("conv_id"), *[F.coalesce(x, zero).alias(x) for x in
                    ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256")))
