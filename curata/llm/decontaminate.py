"""Operator 8, benchmark decontamination by spaced-seed hashing.

A document overlaps a benchmark item where ``WINDOW`` tokens in a row of one
stand against as many of the other with at most ``SUBSTITUTED`` of them
different.  Each mask reads seven token positions and ignores those between; the three
masks together are lossless: whichever ``SUBSTITUTED`` places of a window differ, some mask, somewhere
in the window, reads only equal ones (``tests/llm`` goes through all cases).  So a join of
masked hashes of the items with those of every document position finds every overlap, and each hit
is then verified along its diagonal.

Plan: token hashes of a document are cut into rows of ``ROW`` positions and the tokens next to them; positions and masks are
exploded, hashed and probed against the benchmark's seeds within one generated stage, and
only verified hits, a pair of ids each, are written to an exchange.  Of the hits
that follow each other on a diagonal only the first leaves that stage, which holds all that one input row
yields: so a hit carries the few tokens that its check reads, never a document's whole array.

The seeds are broadcast in passes of about ``SEEDS_PER_PASS`` (counted before), one after the other with the pairs of each
written to the shared folder, so a larger
benchmark means more passes over the documents and not a larger broadcast.  Items equal in id and text count once, and a long item is dealt
over the passes in pieces of ``PIECE`` tokens, which overlap by more than a window, so each window lies whole in one of them.

An item of fewer than ``WINDOW`` tokens is its own window, with substitutions in proportion (one from 7
tokens, none below), and may be no longer than the document.  It is cut into one part more than it may have
substitutions, so some part stands unchanged: a join of the parts' hashes with those of as many
tokens in a row of the documents finds every such overlap, and each hit is verified over the whole item.
``contamination`` reports every overlap; ``clean`` removes a document only for an item of ``SHORTEST`` tokens or more (5 unless the
caller says otherwise), since a quoted word or name is no leak.

Tokens are the lower-cased runs of letters and digits; in scripts written without spaces (``UNSPACED``) each letter is a
token.  Null texts and texts without a token overlap with nothing, and so do such items.  Repeated rows
each get the result; rows with equal ids and different texts are told apart by a hash of the text.
Null ids are kept.  An empty table on either side gives no overlaps.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged

WINDOW, SUBSTITUTED = 13, 2
#: Places that each mask reads; between them it ignores.
MASKS = ((0, 1, 3, 4, 5, 6, 7), (0, 1, 2, 4, 6, 9, 10), (0, 1, 2, 3, 7, 9, 10))
#: Unicode blocks of the scripts whose words are not set apart by spaces (Thai, Lao; Myanmar; Khmer; CJK radicals, Han, kana,
#: Bopomofo, Yi; Myanmar and Han extensions).  A range of code points costs the regular expression far less than a script class.
UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303C\u3041-\u312F\u31A0-\u31BF\u31F0-\u31FF"
            r"\u3400-\u4DBF\u4E00-\uA4CF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9D\x{16FE0}-\x{16FFF}\x{1AFF0}-\x{1B16F}\x{20000}-\x{3347F}")
#: Benchmark seeds that are broadcast at a time: 4 numbers each, under 100 MB; the token
#: arrays of their items, broadcast beside them, hold a third as many numbers as there are seeds.
SEEDS_PER_PASS = 2_000_000
#: Positions of a document that are probed as one row; with them go the ``WINDOW`` - 1 tokens before and 2 * ``WINDOW`` after.
ROW = 512
#: Tokens from one piece of a long item to the next.
PIECE = 4096
#: The shortest item, in tokens, for whose sake ``clean`` removes a document.
SHORTEST = 5


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits, and of the single letters of unspaced scripts."""
    apart = F.regexp_replace(F.lower(text), f"([{UNSPACED}])", " $1 ")
    words = F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def position_rows(own: DataFrame, least: int) -> DataFrame:
    """Documents of ``least`` tokens or more in rows of ``ROW`` positions: ``near`` holds their tokens and those next to them, of
    which ``first`` come before.  The lambda keeps this out of the generated stage that follows, whose output then waits for one such row at a time."""
    def one(p: Column) -> Column:
        first = F.least(p, F.lit(WINDOW - 1))
        return F.struct(first.alias("first"), F.slice("tokens", p - first + 1, first + (ROW + 2 * WINDOW)).alias("near"))

    starts = F.when(F.size("tokens") >= least, F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(ROW)))
    return own.select("doc_id", "text_hash", F.explode(F.transform(starts, one)).alias("p")).select("doc_id", "text_hash", "p.first", "p.near")


def masked(tokens: str, at: Column, m: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(m), *[F.get(F.col(tokens), at + o) for o in mask])


def seeds(rows: DataFrame, tokens: str, places: Column, masks: dict[int, tuple[int, ...]] = dict(enumerate(MASKS))) -> DataFrame:
    """One row for each mask at each of ``places`` where it fits: its number and hash."""
    at = rows.withColumn("at", F.explode(places))

    def one(m: int, mask: tuple[int, ...]) -> Column:
        fits = F.col("at") + mask[-1] < F.size(tokens)
        return F.struct(F.lit(m).alias("mask"), F.when(fits, masked(tokens, F.col("at"), m, mask)).alias("seed"))

    return (at.withColumn("s", F.explode(F.array(*[one(m, mask) for m, mask in masks.items()])))
            .withColumns({"mask": F.col("s.mask"), "seed": F.col("s.seed")}).drop("s").filter(F.col("seed").isNotNull()))


def item_seeds(items: DataFrame, masks: dict[int, tuple[int, ...]] = dict(enumerate(MASKS))) -> DataFrame:
    return seeds(items, "theirs", F.sequence(F.lit(0), F.size("theirs") - 1), masks).withColumnRenamed("at", "item_at")


def document_seeds(own: DataFrame, least: int, masks: dict[int, tuple[int, ...]] = dict(enumerate(MASKS))) -> DataFrame:
    places = F.sequence(F.col("first"), F.least(F.col("first") + ROW, F.size("near")) - 1)
    return seeds(position_rows(own, least), "near", places, masks)


def seed_before(tokens: str, at: Column) -> Column:
    """The same mask's hash one place earlier; null at the first place."""
    return F.coalesce(*[F.when((F.col("mask") == m) & (at > 0), masked(tokens, at - 1, m, mask)) for m, mask in enumerate(MASKS)])


def item_arrays(items: DataFrame, *more: str) -> DataFrame:
    """An item's token array is joined to its hits by a second small table: seeds stay a few numbers each."""
    return items.select("theirs", "item_id", F.col("item").alias("i"), *more).dropDuplicates(["i"])


def best_window(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Most equal tokens in any ``WINDOW`` places around a hit: the windows that
    overlap the mask's reach on the diagonal of (i, j)."""
    back = F.least(i, j, F.lit(WINDOW - 1))
    length = F.least(F.size(a) - i, F.size(b) - j, F.lit(2 * WINDOW)) + back
    equal = F.transform(F.sequence(F.lit(0), length - 1),
                        lambda k: (F.get(a, i - back + k) == F.get(b, j - back + k)).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), length - WINDOW),
                       lambda s: F.aggregate(F.slice(equal, s + 1, WINDOW), F.lit(0), lambda x, y: x + y))
    return F.when(length >= WINDOW, F.array_max(sums)).otherwise(0)


def least_equal(n: int) -> int:
    """Equal tokens that a window of ``n`` must have."""
    return n - SUBSTITUTED * n // WINDOW


def parts(n: int) -> list[tuple[int, int]]:
    """Start and end of the parts of an item of ``n`` tokens, one more than its substitutions."""
    k = n - least_equal(n) + 1
    return [(n * p // k, n * (p + 1) // k) for p in range(k)]


def short_hits(own: DataFrame, short: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents and items of the given ``sizes``, under ``WINDOW``, that overlap: doc_id, text_hash, item_id, matched, item_tokens."""
    cuts = sorted({(n, a, b) for n in sizes for a, b in parts(n)})
    runs = {m: tuple(range(m)) for m in sorted({b - a for _, a, b in cuts})}  # masks without a gap, by length
    is_part = reduce(lambda x, y: x | y, [(F.size("theirs") == n) & (F.col("item_at") == a) & (F.col("mask") == b - a) for n, a, b in cuts])
    there = item_seeds(short, runs).filter(is_part).select("seed", "item_at", "item", F.size("theirs").alias("n"))
    start = F.col("at") - F.col("item_at")
    hits = (document_seeds(own, min(sizes), runs).join(F.broadcast(there), "seed")
            .filter((start >= 0) & (start + F.col("n") <= F.size("near")))
            .select("doc_id", "text_hash", "item", "n", F.slice("near", start + 1, F.col("n")).alias("near"))
            .join(F.broadcast(item_arrays(short)), F.col("item") == F.col("i")))
    equal = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0), lambda x, k: x + (F.get("near", k) == F.get("theirs", k)).cast("int"))
    return (hits.select("doc_id", "text_hash", "item_id", equal.alias("matched"), F.col("n").alias("item_tokens"))
            .filter(F.col("matched") >= F.col("item_tokens") - F.floor(F.lit(SUBSTITUTED) * F.col("item_tokens") / WINDOW)))


def first_hits(own: DataFrame, long: DataFrame) -> DataFrame:
    """Hits of ``WINDOW`` tokens and more that do not follow another on their diagonal: doc_id, text_hash, item, item_at and the tokens
    ``near`` the hit, which is at ``at`` of them."""
    there = item_seeds(long).select("seed", "item_at", "item", seed_before("theirs", F.col("item_at")).alias("item_before"))
    follows = F.coalesce(seed_before("near", F.col("at")) == F.col("item_before"), F.lit(False))
    back = F.least(F.col("at"), F.lit(WINDOW - 1))
    return (document_seeds(own, WINDOW).join(F.broadcast(there), "seed").filter(~follows)
            .select("doc_id", "text_hash", "item", "item_at", back.alias("at"), F.slice("near", F.col("at") - back + 1, back + 2 * WINDOW).alias("near")))


def long_hits(own: DataFrame, long: DataFrame) -> DataFrame:
    """As ``short_hits``, for items of ``WINDOW`` tokens and more."""
    hits = first_hits(own, long).join(F.broadcast(item_arrays(long, "item_tokens")), F.col("item") == F.col("i"))
    best = best_window(F.col("near"), F.col("at"), F.col("theirs"), F.col("item_at"))
    return (hits.select("doc_id", "text_hash", "item_id", best.alias("matched"), "item_tokens")
            .filter(F.col("matched") >= WINDOW - SUBSTITUTED))


def overlaps(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", per_pass: int = SEEDS_PER_PASS) -> DataFrame:
    """doc_id, text_hash, item_id, matched (most equal tokens of a window), item_tokens: one
    row for each document and item that overlap."""
    whole = (benchmark.select(F.col(item_id).cast("long").alias("item_id"), token_hashes(F.col("text")).alias("theirs")).filter(F.size("theirs") > 0)
             .withColumn("own", F.xxhash64("theirs")).dropDuplicates(["item_id", "own"]))
    starts = F.sequence(F.lit(0), F.greatest(F.size("theirs") - WINDOW, F.lit(0)), F.lit(PIECE))
    items = (whole.withColumn("piece", F.explode(starts))
             .select("item_id", F.size("theirs").alias("item_tokens"), F.slice("theirs", F.col("piece") + 1, F.lit(PIECE + 2 * WINDOW)).alias("theirs"))
             .withColumn("item", F.xxhash64(F.isnull("item_id"), "item_id", "theirs")))
    read = items.agg(F.sum(F.size("theirs").cast("long") * len(MASKS)).alias("n"),
                     F.collect_set(F.when(F.size("theirs") < WINDOW, F.size("theirs"))).alias("sizes")).first()  # under WINDOW sizes
    passes = max(1, -(-(read.n or 0) // per_pass))
    sizes = sorted(read.sizes)
    own = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("tokens"))

    def best(found: list[DataFrame]) -> DataFrame:
        return (reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash", "item_id")
                .agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens")))

    found = []
    if passes > 1:
        items = staged(items, "benchmark-items")
    for k in range(passes):
        some = items.filter(F.pmod("item", F.lit(passes)) == k)
        hits = [long_hits(own, some.filter(F.col("item_tokens") >= WINDOW))]
        if sizes:
            hits.append(short_hits(own, some.filter(F.col("item_tokens") < WINDOW), sizes))
        found += hits if passes == 1 else [staged(best(hits), "overlaps")]
    return best(found)


def contamination(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, contaminated, n_items (items that overlap), n_short (those of them with fewer than ``shortest`` tokens),
    matched (most equal tokens of a window, 0 without overlap) of every document."""
    hits = (overlaps(docs, benchmark).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("item_tokens") < shortest).alias("s"), F.max("matched").alias("m")))
    own = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"))
    return (own.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
            .select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("s", F.lit(0)).cast("long").alias("n_short"),
                    F.coalesce("m", F.lit(0)).cast("int").alias("matched")))


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no benchmark item of ``shortest`` tokens or more."""
    hits = (overlaps(docs, benchmark).filter(F.col("item_tokens") >= shortest).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct())
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__h")), "left_anti")
