"""Operator 6, document fingerprints by a Merkle tree.

A text is cut into leaves (sentences, at most ``LEAF`` code points), leaves make
paragraphs (up to a line end) and paragraphs make sections (up to an empty line,
or where a paragraph's own digest says so, so that an insertion moves no later border).  Every node's digest is a hash of its
children's digests; the root's is 128 bits, so equal roots mean equal texts.
The fingerprint writes the root and the first 8 hex digits of every node::

    root|section=paragraph:leaf leaf..,paragraph:leaf..|section=..

``likeness`` descends only into branches that differ and returns the share of
leaves in branches that both trees hold (twice the shared ones over all);
``differing`` gives the leaf ranges that do not match.

Null texts count as empty ones (root of no children; likeness 1 among
themselves).  Repeated rows have equal fingerprints; an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

LEAF = 240
PIECE = re.compile(r"[^.!?\n]{1,%d}[.!?\n]?|[.!?\n]" % LEAF)
#: A paragraph whose digest starts with a byte below this ends its section (1 of 8).
CUT = 32


def _hash(*children: bytes) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


def fingerprint(text: str | None, known: dict[str, bytes] | None = None) -> str:
    """The fingerprint of one text; ``known`` keeps leaf digests between calls."""
    known = {} if known is None else known
    sections: list[tuple[bytes, str]] = []
    paragraphs: list[tuple[bytes, str]] = []
    leaves: list[bytes] = []

    def end_section() -> None:
        d = _hash(b"s", *[p for p, _ in paragraphs])
        sections.append((d, d.hex()[:8] + "=" + ",".join(w for _, w in paragraphs)))
        paragraphs.clear()

    def end_paragraph(blank: bool) -> None:
        d = _hash(b"p", *leaves)
        paragraphs.append((d, d.hex()[:8] + ":" + "".join([x.hex()[:8] for x in leaves])))
        leaves.clear()
        if blank or d[0] < CUT:
            end_section()

    for piece in PIECE.findall(text or ""):
        d = known.get(piece)
        if d is None:
            d = known[piece] = _hash(b"l", piece.encode())
        leaves.append(d)
        if piece[-1] == "\n":
            end_paragraph(piece == "\n" and len(leaves) == 1)
    if leaves:
        end_paragraph(False)
    if paragraphs:
        end_section()
    return "|".join([_hash(b"r", *[d for d, _ in sections]).hex(), *[w for _, w in sections]])


def _shared(a: list[str], b: list[str], split) -> int:
    """Leaves (8 digits each) of branches held by both lists, descending by ``split`` into the others."""
    ca, cb = Counter(a), Counter(b)
    both = ca & cb
    n = sum(k * weight(x) for x, k in both.items())
    left, right = list((ca - both).elements()), list((cb - both).elements())
    if not left or not right or split is None:
        return n
    below = {"section": None, "paragraph": _leaves}[split]
    if split == "section":
        return n + _shared([p for x in left for p in x[9:].split(",")], [p for x in right for p in x[9:].split(",")], "paragraph")
    x, y = Counter(l for p in left for l in below(p)), Counter(l for p in right for l in below(p))
    return n + sum((x & y).values())


def _leaves(paragraph: str) -> list[str]:
    own = paragraph[9:]
    return [own[i:i + 8] for i in range(0, len(own), 8)]


def weight(branch: str) -> int:
    """Leaves below a written section or paragraph."""
    if branch[8] == ":":
        return (len(branch) - 9) // 8
    return sum((len(p) - 9) // 8 for p in branch[9:].split(","))


def likeness(a: str, b: str) -> float:
    """Share of leaves that both trees hold, from 0 to 1; 1 for equal roots."""
    x, y = a.split("|"), b.split("|")
    if x[0] == y[0]:
        return 1.0
    total = sum(map(weight, x[1:])) + sum(map(weight, y[1:]))
    return min(1.0, 2 * _shared(x[1:], y[1:], "section") / total) if total else 0.0


def differing(a: str, b: str) -> list[int]:
    """Leaf numbers of ``a`` outside every branch that ``b`` holds too: where ``a`` was edited."""
    x, y = a.split("|"), b.split("|")
    if x[0] == y[0]:
        return []
    sections, out, at = Counter(y[1:]), [], 0
    rest = Counter(p for s, k in (sections - Counter(x[1:])).items() for p in s[9:].split(",") for _ in range(k))
    leaves = Counter(l for p, k in rest.items() for l in _leaves(p) for _ in range(k))
    for s in x[1:]:
        if sections[s] > 0:
            sections[s] -= 1
            at += weight(s)
            continue
        for p in s[9:].split(","):
            for leaf in _leaves(p):
                if leaves[leaf] > 0:
                    leaves[leaf] -= 1
                else:
                    out.append(at)
                at += 1
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""
    return map_rows(id_text(docs), "doc_id long, n_chars long, fingerprint string",
                    lambda c: {"doc_id": c["doc_id"], "n_chars": [len(x or "") for x in c["text"]],
                               "fingerprint": [fingerprint(x) for x in c["text"]]})


# --- each document against its edited text and the next document ------------

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, ghost, descending id: each own row is finished
    when the row after it is seen; ghosts only end their bucket."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RESULT.split(", "))])
    held = None
    for b in batches:
        out = []
        for bucket, ghost, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
            text, known = text or "", {}
            if held is None or held[0] != bucket:
                if ghost:
                    continue
                held = (bucket, doc_id, text, fingerprint(text, known), known)
                continue
            own, own_known = held[2], held[4]
            print_ = fingerprint(text, known)
            half = len(own) // 2
            edited = own[:len(own) - half] + text[:half]
            changed = fingerprint(edited, own_known | known)
            out.append((held[1], len(own), hashlib.sha256(edited.encode()).hexdigest(), held[3], changed,
                        likeness(held[3], changed), likeness(held[3], print_)))
            held = None if ghost else (bucket, doc_id, text, print_, known)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def against_neighbours(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Each document's fingerprint, that of its edited text -- the last half of
    its code points replaced by the first of the next document, by descending
    id -- and the likeness to it and to the next document.  Equal ids are ordered
    by a hash of the text; null ids come last, in that order too, cut at equal parts of the hash's range.

    Ids are cut at quantiles into ranges (the cuts and each range's largest id
    are all that the driver sees, a few numbers per partition).  The document that a
    range's last one needs is the first of the next range: it is sent to both.
    So the texts are shuffled once, and no window runs over the whole table."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = max(2, n * buckets_per_partition)
    rows = id_text(docs).withColumn("key", F.col("doc_id").cast("double"))
    cuts = rows.agg(F.percentile_approx("key", [i / k for i in range(1, k)], 100 * k).alias("c")).first().c or []
    bucketed = Bucketizer(splits=[-float("inf"), *sorted({0.0, *cuts}), float("inf")], inputCol="key", outputCol="at", handleInvalid="keep")
    part = -1 - (F.shiftright("hash", 58) + 32)  # of rows without an id: 64 ranges, the greatest hashes lowest
    rows = bucketed.transform(rows.withColumn("hash", F.xxhash64("text"))).withColumn("bucket", F.when(F.col("doc_id").isNull(), part).otherwise(F.col("at")).cast("int"))
    first = F.max(F.struct("doc_id", F.bitwise_not("hash").alias("not")))  # greatest id, of its rows the smallest hash
    heads = sorted(((r.bucket, r.first.doc_id, ~r.first["not"]) for r in rows.groupBy("bucket").agg(first.alias("first")).collect()), key=lambda x: x[0])
    ghosts = spark.createDataFrame([(head, code, heads[(i + 1) % len(heads)][0]) for i, (_, head, code) in enumerate(heads)], "head long, code long, target int")
    there = (rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("code")), "left")
             .select(F.inline(F.filter(F.array(F.struct(F.col("bucket").alias("place"), F.lit(False).alias("ghost")),
                                               F.struct(F.col("target").alias("place"), F.lit(True).alias("ghost"))), lambda s: s["place"].isNotNull())),
                     "doc_id", "text", "hash"))
    return (there.repartition(n, "place")
            .sortWithinPartitions("place", "ghost", F.col("doc_id").desc_nulls_last(), "hash").drop("hash")
            .mapInArrow(_compare, RESULT))
