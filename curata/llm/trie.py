"""Operator 11, the prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of leading turns (role, text).  Its key is the exclusive or of two 64-bit hashes of each
(place, role, text), so a running exclusive or gives the keys of all prefixes of a conversation and a node's
parent key follows from its own row.  A node is named by its smallest member and its depth, and numbered densely in that order.

Every node has an enter and an exit arc.  An enter arc leads to the first child's enter arc (or the node's own exit), an
exit arc to the next sibling's enter arc (or the parent's exit): one list of 2 n arcs, ranked in three steps:

1. blocks of ``BLOCK`` nodes with consecutive numbers replace the chains of arcs inside them by their heads (pointer doubling in numpy);
2. while more than ``BASE`` heads are left, each round takes a quarter of them out of the list: those with coin 1 whose
   successor has coin 0, no two of which are neighbours; a join hands their weights to their predecessors;
3. the bounded rest is ranked by doubling, and the rounds are undone in reverse order.

Arcs carry (1, childless, savings), so a rank comes with the sums over the rest of the tour, and a subtree's leaves and savings are the
difference between its enter and exit arcs.

Hot conversations, first turns and parents are cut by place: numbering, prefix keys and siblings are scans over ranges (``scan``).
Texts are not shuffled, only their hashes and word counts.  Equal turns of a conversation stand in order of role and text hashes.

Null conv_id: no conversation, the row is left out.  Null turn: first.  Null role or text: empty.  Repeated rows are turns of their own.
``c - c % 20`` is SQL's (towards zero for negative ids).  An empty table has no node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_dense_id
from .common import staged
from .scan import digests, running, sorted_ranges

#: Conversations that share the head of one, and turns of a head at most.
SHARED, HEAD = 20, 4
#: Nodes of a block, and arcs that are ranked in one group.
BLOCK, BASE = 1 << 15, 1 << 14
NOTHING = hashlib.sha256(b"").hexdigest()
WEIGHTS = ("steps", "leaves", "saved")


def base_of(c: Column) -> Column:
    return c - c % SHARED


def head_of(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % HEAD).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), u, v (hashes of role and text), words: every turn."""
    said = (F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("u"), F.xxhash64(F.lit(2), *said).alias("v"), F.xxhash64(said[0]).alias("r"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row"))  # only splits equal rows over ranges
    placed = running(staged(turns, "turns"), ["conv_id"], ["turn", "r", "u", "v", "row"], add=["one"], name="places")
    return placed.select("conv_id", (F.col("run_one") - 1).alias("pos"), "u", "v", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1; 0: a row of its own for each conversation), a, b (hashes of the turn at its depth), words."""
    turns = numbered_turns(conversations)
    given = (turns.filter((F.col("pos") < HEAD - 1) & (F.col("conv_id") % SHARED == 0)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "u", "v", "words"))).alias("given")))  # three at most
    convs = turns.filter("pos = 0").select("conv_id", base_of(F.col("conv_id")).alias("base"), head_of(F.col("conv_id")).alias("h"))
    convs = staged(convs.join(given, "base", "left").withColumn("given", F.when(F.col("given").isNotNull(), F.slice("given", F.lit(1), F.col("h")))),
                   "heads").select("conv_id", "given", F.coalesce(F.size("given"), F.lit(0)).alias("k"))
    own = (turns.filter(F.col("pos") >= head_of(F.col("conv_id"))).join(convs.select("conv_id", "k"), "conv_id")
           .select("conv_id", (F.col("pos") - head_of(F.col("conv_id")) + F.col("k") + 1).alias("depth"), "u", "v", "words"))
    head = (convs.select("conv_id", F.posexplode("given").alias("i", "t"))
            .select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.u", "t.v", "t.words"))
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    turned = own.unionByName(head).select("conv_id", "depth", F.xxhash64(F.lit(3), "depth", "u").alias("a"),
                                          F.xxhash64(F.lit(4), "depth", "v").alias("b"), "words")
    return staged(turned.unionByName(top), "rebuilt")


def siblings(nodes: DataFrame) -> DataFrame:
    """id, parent, parent_rep, next (the next child of the same parent, or null) of every node but the root.

    Parents and their children are sorted together by the parent's key, each parent before its children, in
    ranges that may cut a parent's children anywhere."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parent, held, first = TaskContext.get().partitionId(), (None, None), None, None
        names = ["id", "parent", "parent_rep", "next", "part", "kind", "last"]

        def rows(child, ids, parents, reps, nxt, last):
            n = int(child.sum())
            known = parents[child] >= 0
            columns = [pa.array(ids[child]), pa.array(parents[child], mask=~known), pa.array(reps[child], mask=~known),
                       pa.array(nxt[child], mask=nxt[child] < 0), pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(last[child])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def linked(flag, ids, reps):
            """Parents and next siblings of the rows; the last row's sibling is not known yet."""
            nonlocal parent
            at = np.maximum.accumulate(np.where(flag == 0, np.arange(len(flag)), -1))
            before = (-1, 0) if parent[0] is None else parent
            parents, their = np.where(at < 0, before[0], ids[at]), np.where(at < 0, before[1], reps[at])
            if at[-1] >= 0:
                parent = int(ids[at[-1]]), int(reps[at[-1]])
            nxt = np.r_[np.where(flag[1:] == 1, ids[1:], -1), -1]
            return parents, their, nxt

        for b in batches:
            if not b.num_rows:
                continue
            flag, ids, reps = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("flag", "id", "rep"))
            if held is not None:
                flag, ids, reps = (np.r_[x, y] for x, y in zip(held, (flag, ids, reps)))
            first = (int(flag[0]), int(ids[0])) if first is None else first
            held = tuple(x[-1:].copy() for x in (flag, ids, reps))
            if len(flag) > 1:
                parents, their, nxt = (x[:-1] for x in linked(flag, ids, reps))
                yield rows(flag[:-1] == 1, ids[:-1], parents, their, nxt, np.zeros(len(flag) - 1, bool))
        if held is not None:
            flag, ids, reps = held
            parents, their, nxt = linked(flag, ids, reps)
            yield rows(flag == 1, ids, parents, their, nxt, np.ones(1, bool))
            end = {"id": first[1] if first[0] else None, "parent": parent[0], "parent_rep": parent[1], "next": None, "part": part, "kind": 0, "last": None}
            yield pa.RecordBatch.from_pylist([end], schema=pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]))))

    own = nodes.select(F.col("depth").alias("d"), "x", "y", F.lit(0).alias("flag"), "id", "rep")
    child = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y"),
                                             F.lit(1).alias("flag"), "id", "rep")
    schema = "id long, parent long, parent_rep long, next long, part int, kind int, last boolean"
    found = staged(sorted_ranges(own.unionByName(child), ["d", "x", "y", "flag", "id"]).select("flag", "id", "rep").mapInArrow(scan, schema), "siblings")
    ends = sorted(found.filter("kind = 0").select("part", "id", "parent", "parent_rep").collect())  # a row for each partition
    handed, before = [], (None, None)
    for i, (part, _, parent, rep) in enumerate(ends):
        handed.append((part, *before, ends[i + 1][1] if i + 1 < len(ends) else None))
        before = (parent, rep) if parent is not None else before
    rows = found.filter("kind = 1")
    if not handed:
        return rows.select("id", "parent", "parent_rep", "next")
    more = nodes.sparkSession.createDataFrame(handed, "p int, q long, q_rep long, q_next long")
    return rows.join(F.broadcast(more), F.col("part") == F.col("p")).select(
        "id", F.coalesce("parent", "q").alias("parent"), F.coalesce("parent_rep", "q_rep").alias("parent_rep"),
        F.when(F.col("last"), F.col("q_next")).otherwise(F.col("next")).alias("next"))


def to_ends(follow: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of lists (``follow``: the next one's place, or -1) its list's last place, and the
    sums of ``weights`` (elements by kinds) from it to there, both included; by pointer doubling."""
    n = len(follow)
    to = np.where(follow < 0, np.arange(n), follow)
    sums = np.where((follow < 0)[:, None], 0, weights)
    while True:
        further = to[to]
        if (further == to).all():
            return to, sums + weights[to]
        sums, to = sums + sums[to], further


def _contract(table: pa.Table) -> pa.Table:
    """Chains of arcs inside a block: for each node's arcs the arc outside that its chain leads to, and the sums up to it."""
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    arcs = np.column_stack([2 * ids, 2 * ids + 1]).ravel()
    nxt = np.column_stack([table.column("enter_next").to_numpy(), table.column("exit_next").to_numpy()]).ravel()
    weights = np.zeros((len(arcs), 3), np.int64)
    weights[:, 0] = 1
    weights[::2, 1], weights[::2, 2] = table.column("leaf").to_numpy(), table.column("saving").to_numpy()
    at = np.searchsorted(arcs, nxt)
    inside = (at < len(arcs)) & (arcs[np.minimum(at, len(arcs) - 1)] == nxt)
    follow = np.where(inside, at, -1)
    end, sums = to_ends(follow, weights)
    head = np.ones(len(arcs), bool)
    head[follow[inside]] = False
    columns = {"id": ids}
    for k, name in enumerate(("enter", "exit")):
        columns |= {f"{name}_out": nxt[end][k::2], f"{name}_head": head[k::2]} | {f"{name}_{w}": sums[k::2, i] for i, w in enumerate(WEIGHTS)}
    return pa.table(columns)


def _rank_all(table: pa.Table) -> pa.Table:
    arcs, nxt = table.column("arc").to_numpy(), table.column("next").to_numpy()
    order = np.argsort(arcs)
    at = np.minimum(np.searchsorted(arcs, nxt, sorter=order), len(arcs) - 1)
    follow = np.where((nxt >= 0) & (arcs[order[at]] == nxt), order[at], -1)
    _, sums = to_ends(follow, np.column_stack([table.column(w).to_numpy() for w in WEIGHTS]))
    return pa.table({"arc": arcs} | {w: sums[:, i] for i, w in enumerate(WEIGHTS)})


def rank_list(arcs: DataFrame, base: int = BASE) -> DataFrame:
    """arc and its sums of the weights to the end of the list, from (arc, next or -1, weights)."""
    names, rounds, left = [F.col(w) for w in WEIGHTS], [], arcs

    def coin(c: Column) -> Column:
        return (c >= 0) & (F.xxhash64(F.lit(len(rounds)), c) % 2 == 0)

    while left.count() > base:
        gone = coin(F.col("arc")) & ~coin(F.col("next"))
        out = left.filter(gone)
        rounds.append(out)
        over = out.select(F.col("arc").alias("next"), F.col("next").alias("__n"), *[F.col(w).alias(f"__{w}") for w in WEIGHTS])
        left = staged(left.filter(~gone).join(over, "next", "left").select(
            "arc", F.coalesce("__n", "next").alias("next"), *[(F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in WEIGHTS]), "list")
    ranked = staged(left.groupBy(F.lit(0).alias("g")).applyInArrow(lambda t: _rank_all(t), "arc long, steps long, leaves long, saved long"), "ranked")
    for out in reversed(rounds):
        after = ranked.select(F.col("arc").alias("next"), *[F.col(w).alias(f"__{w}") for w in WEIGHTS])
        again = staged(out.join(after, "next", "left").select("arc", *[(F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in WEIGHTS]), "ranked")
        ranked = ranked.unionByName(again)
    return ranked.select("arc", *names)


def tour_sums(nodes: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """id, n_leaves and saved_tokens (sums over the subtree), enter and exit (places in the tour, from 0)
    from id (dense, from 0), enter_next, exit_next (arcs: 2 id enters, 2 id + 1 exits; -1 ends), leaf and saving."""
    fields = ", ".join(f"{k}_out long, {k}_head boolean, " + ", ".join(f"{k}_{w} long" for w in WEIGHTS) for k in ("enter", "exit"))
    own = staged(nodes.select("id", "enter_next", "exit_next", F.col("leaf").cast("long").alias("leaf"), "saving",
                              F.floor(F.col("id") / block).alias("block")).groupBy("block").applyInArrow(lambda t: _contract(t), f"id long, {fields}"), "chains")
    heads = [own.filter(f"{k}_head").select((2 * F.col("id") + i).alias("arc"), F.col(f"{k}_out").alias("next"), *[F.col(f"{k}_{w}").alias(w) for w in WEIGHTS])
             for i, k in enumerate(("enter", "exit"))]
    ranks = staged(rank_list(staged(heads[0].unionByName(heads[1]), "list"), base), "ranks")
    total = 2 * own.count()
    for k in ("enter", "exit"):
        after = ranks.select(F.col("arc").alias(f"{k}_out"), *[F.col(w).alias(f"__{w}") for w in WEIGHTS])
        own = own.join(after, f"{k}_out", "left")
        for w in WEIGHTS:
            own = own.withColumn(f"{k}_{w}", F.col(f"{k}_{w}") + F.coalesce(f"__{w}", F.lit(0))).drop(f"__{w}")
    return own.select("id", (F.col("enter_leaves") - F.col("exit_leaves")).alias("n_leaves"), (F.col("enter_saved") - F.col("exit_saved")).alias("saved_tokens"),
                      (total - F.col("enter_steps")).alias("enter"), (total - F.col("exit_steps")).alias("exit"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, exit."""
    turns = rebuilt(conversations)
    keyed = running(turns, ["conv_id"], ["depth"], xor=["a", "b"], name="prefixes")
    nodes = (keyed.groupBy("depth", F.col("run_a").alias("x"), F.col("run_b").alias("y"))
             .agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                  F.min(F.col("run_a").bitwiseXOR(F.col("a"))).alias("px"), F.min(F.col("run_b").bitwiseXOR(F.col("b"))).alias("py")))
    nodes = staged(with_dense_id(staged(nodes, "nodes"), ["rep", "depth"]).withColumn("id", F.col("id") - 1), "numbered-nodes")
    links = staged(siblings(nodes), "links")
    kids = links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"), F.min("id").alias("first"))
    every = (nodes.join(links, "id", "left").join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
             .withColumns({"enter_next": F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1),
                           "exit_next": F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1, F.lit(-1).cast("long")),
                           "leaf": F.col("n_children") == 0, "saving": (F.col("n_convs") - 1) * F.col("words")}))
    every = staged(every, "tour")
    last = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    last = staged(last.withColumn("digits", F.col("conv_id").cast("string")), "ends")
    ends = digests(sorted_ranges(last, ["x", "y", "depth", "conv_id"]), ["x", "y", "depth"], "conv_id", "digits", b",", name="end-lists")
    return (every.join(tour_sums(every, block, base), "id").join(ends, ["x", "y", "depth"], "left")
            .select(F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"), "enter", "exit"))
