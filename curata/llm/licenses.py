"""Operator 12, license scans by diagonal voting.

Templates are short phrases (the base rules) and the wording of license notices.  Every run of ``k`` words of a document is
hashed and joined to the places of equal runs in the templates; a hit at word ``i`` of the document and ``j`` of the template votes for the diagonal
``i - j``.  Of hits that follow each other on a diagonal the first carries the votes of all, and is verified word by
word, before anything is shuffled.  Votes are summed by diagonal; diagonals of a template at most ``BAND`` apart
(words were put in or left out) are merged, and the merged span counts where its verified words cover ``LEAST`` of the template.
A phrase counts only whole, on one diagonal.

Everything is DataFrame functions.  A document's words stay one array of hashes in its row; explosion, probe and verification run within
one stage, written out as a narrow table: a row for each document and one for each run of hits.  The templates are fixed
values of this module (some 1000 words), which bounds the broadcast whatever the documents hold.

Words: A-Z lower-cased, runs of digits, letters a-z and all code points from U+0080.  Null texts are empty, without words and places.  Repeated rows
each get the result; rows of one id with different texts are told apart by a hash of the text; null ids are kept.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, staged

#: The base rules' phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: The customary wording of license notices, and their labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
               "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
               "for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
            "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
            "PARTICULAR PURPOSE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                  "by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Words of a hashed run, for phrases and for notices.
K_PHRASE, K_NOTICE = 2, 4
#: Diagonals this far apart are merged; share of a notice that its verified words must cover.
BAND, LEAST = 6, 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_remove(F.split(lower, SEPARATORS), ""), lambda w: F.xxhash64(w))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, k, theirs (word hashes): one row for each phrase and notice."""
    rows = [(p, label, K_PHRASE) for p, label in phrases] + [(n, label, K_NOTICE) for label, n in notices]
    each = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(k).alias("k"), F.lit(text).alias("text"))
                     for i, (text, label, k) in enumerate(rows)])
    return (spark.range(1).select(F.explode(each).alias("t")).select("t.template", "t.label", "t.k", word_hashes(F.col("t.text")).alias("theirs")))


def run_hash(words: str, at: Column, k: int) -> Column:
    """Hash of ``k`` words from ``at``, null where they do not fit."""
    return F.when(at + k <= F.size(words), F.xxhash64(F.lit(k), *[F.get(F.col(words), at + o) for o in range(k)]))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The narrow table: for each document a row without template (doc_id, text_hash, n_words), and for each run of hits on a
    diagonal a row with template, diagonal, from (its first word in the template) and length (verified words)."""
    at = F.col("at")
    places = known.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("theirs") - F.col("k"))))
    seeds = places.select("template", "j", "theirs", "k", F.when(F.col("k") == K_PHRASE, run_hash("theirs", F.col("j"), K_PHRASE))
                          .otherwise(run_hash("theirs", F.col("j"), K_NOTICE)).alias("seed"))
    own = (id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("words"))
           .withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))))))
    probes = F.array(*[F.struct(F.lit(k).alias("p"), run_hash("words", at, k).alias("seed")) for k in (K_PHRASE, K_NOTICE)],
                     F.struct(F.lit(0).alias("p"), F.lit(None).cast("long").alias("seed")))
    probed = (own.withColumn("s", F.explode(probes)).withColumns({"p": F.col("s.p"), "seed": F.col("s.seed")}).drop("s")
              .filter(F.col("seed").isNotNull() | ((F.col("p") == 0) & (at == 0)))
              .join(F.broadcast(seeds), "seed", "left").filter(F.col("template").isNotNull() | (F.col("p") == 0)))
    j, n = F.col("j"), F.size("words")
    # a hit one place earlier on the diagonal has these words and the one before them
    first = F.col("template").isNull() | (at == 0) | (j == 0) | (F.get("words", at - 1) != F.get("theirs", j - 1))
    reach = F.least(n - at, F.size("theirs") - j)
    unequal = F.array_position(F.transform(F.sequence(F.lit(0), reach - 1), lambda o: F.get("words", at + o) == F.get("theirs", j + o)), False)
    length = F.when(F.col("template").isNotNull(), F.when(unequal > 0, unequal - 1).otherwise(reach))
    return probed.filter(first).select("doc_id", "text_hash", n.cast("long").alias("n_words"), "template", (at - j).alias("diagonal"),
                                       j.alias("from"), length.cast("int").alias("length"))


def license_spans(found: DataFrame, known: DataFrame, band: int = BAND, least: float = LEAST) -> DataFrame:
    """doc_id, text_hash, label, phrase (or notice), start and end (words of the document), votes, share: the spans that count, from ``hits``."""
    by = ["doc_id", "text_hash", "template"]
    runs = found.filter("template IS NOT NULL").groupBy(*by, "diagonal", "from").agg(F.max("length").alias("length"))  # repeated rows once
    about = known.select("template", "label", "k", F.size("theirs").alias("size"))
    voted = (runs.join(F.broadcast(about), "template").withColumn("phrase", F.col("k") == K_PHRASE)
             .groupBy(*by, "diagonal", "label", "phrase", "size")
             .agg(F.sum(F.col("length") - F.col("k") + 1).alias("votes"), F.min("from").alias("low"), F.max(F.col("from") + F.col("length")).alias("high"),
                  F.flatten(F.collect_list(F.sequence("from", F.col("from") + F.col("length") - 1))).alias("covered")))
    start, end = (F.col("diagonal") + F.col(x) for x in ("low", "high"))
    whole = voted.filter("phrase AND size(covered) = size").select(
        "doc_id", "text_hash", "label", "phrase", start.alias("start"), end.alias("end"), "votes", F.lit(1.0).alias("share"))
    line = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > band, F.lit(True))
    merged = (voted.filter("NOT phrase").withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(line))
              .groupBy(*by, "label", "phrase", "size", "cluster")
              .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum("votes").alias("votes"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("words")))
    share = F.col("words") / F.col("size")
    return whole.unionByName(merged.select("doc_id", "text_hash", "label", "phrase", "start", "end", "votes", share.alias("share")).filter(F.col("share") >= least))


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, band: int = BAND, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    known = templates(docs.sparkSession, phrases, notices)
    found = staged(hits(docs, known), "license-hits")
    base = F.col("phrase")

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    spans = (license_spans(found, known, band, least).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
             .agg(F.count_if(base).alias("n"), F.min(F.when(base, F.col("start"))).alias("first"), F.max(F.when(base, F.col("start"))).alias("last"),
                  listed(F.when(base, F.col("label"))).alias("base"), listed(F.col("label")).alias("all"), F.max("share").alias("score")))
    own = found.filter("template IS NULL").select("doc_id", "text_hash", "n_words")
    return (own.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
            .select("doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"), F.col("first").cast("long").alias("first_word"),
                    F.col("last").cast("long").alias("last_word"), F.coalesce("base", F.lit("")).alias("base_labels"),
                    F.coalesce("all", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))
