"""Language identification learnt from labelled rows (survey C5, Q13).

The model is a table of log-likelihoods of byte pairs by language.  A text is reduced to its lower-cased letters with one space between
runs of them (and at both ends); its neighbouring UTF-8 bytes are the pairs.  Learning is one Spark aggregate: each task counts the
65 536 possible pairs of its rows' languages in arrays and hands on one row for each pair that it saw, so what comes to the
driver has a proven bound, 65 536 numbers for each language.  Add-one smoothing; languages are equally likely a priori.

A text's language is the one of greatest mean log-likelihood; the margin is its lead over the next one in nats for each pair, and texts under a
margin are ``unknown``, as are those without a letter.

Counting and scoring are numpy over Arrow batches: a look-up for each byte.  The same sums as a higher-order function in the JVM are interpreted for
each byte and language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import release

PAIRS = 1 << 16
UNKNOWN = "unknown"
#: Bytes of texts that are looked up at a time, and rows that are Python values at a time.
BLOCK, ROWS = 1 << 18, 512


def letters_only(text) -> Column:
    """The text as the model reads it: all ASCII but letters is one space."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(col), F.lit(" ")), r"[\x00-\x60\x7B-\x7F]+", " ")


def letters_only_sql(text: str) -> str:
    return rf"regexp_replace(' ' || lower({text}) || ' ', '[\x00-\x60\x7B-\x7F]+', ' ', 'g')"


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte pairs of ``texts``, one after the other, and the number of each text's."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
    size = np.array([len(x) for x in texts])
    codes = (data[:-1] << 8) | data[1:]
    return np.delete(codes, np.cumsum(size)[:-1] - 1), size - 1  # not the pairs that cross from one text to the next


def _blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of about BLOCK bytes in all, and the text of each.  A longer text is cut; a piece begins with the last byte of the one before, so
    each pair is in one piece."""
    owner, own, held = [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, 0 if x is None else len(x) - 1, BLOCK):
            owner.append(i)
            own.append(x[at:at + BLOCK + 1])
            held += len(own[-1])
            if held >= BLOCK:
                yield owner, own
                owner, own, held = [], [], 0
    if own:
        yield owner, own


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # pairs by languages, log-likelihoods

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-likelihood of each text in each language."""
        out, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for owner, own in _blocks(texts):
            codes, n = _pairs(own)
            np.add.at(out, owner, np.add.reduceat(self.table[codes], np.cumsum(n) - n, axis=0))
            np.add.at(total, owner, n)
        return out / total[:, None]


def count_pairs(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, pair, n: byte pairs of the rows that have a text and a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                langs = b.column(0).to_pylist()
                for code in set(langs):
                    total = seen.setdefault(code, np.zeros(PAIRS, np.int64))
                    texts = b.column(1).filter(pa.array([x == code for x in langs])).cast(pa.binary())
                    for _, own in _blocks(texts.to_pylist()):
                        total += np.bincount(_pairs(own)[0], minlength=PAIRS)
        release()
        for code, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "pair", "n"])

    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters_only(text).alias("text"))
    return rows.filter("length(text) > 1").mapInArrow(count, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model; with no row to learn from it has no language and every text is ``unknown``."""
    counted = count_pairs(labelled, text, lang).toPandas()  # at most 65 536 rows for each language
    languages = tuple(sorted(set(counted["lang"])))
    n = np.zeros((PAIRS, len(languages)))
    n[counted["pair"], [languages.index(x) for x in counted["lang"]]] = counted["n"]
    return LanguageModel(languages, np.log((n + 1) / (n.sum(0) + PAIRS)))


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language", margin: str | None = None,
                  min_margin: float = 0.0) -> DataFrame:
    """``df`` with the language of ``text`` and, where named, the margin (null where unknown for want of letters)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, margin double")
    def detect(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        language, margins = np.full(len(texts), UNKNOWN, object), np.full(len(texts), np.nan)
        for first in range(0, len(texts) if m.languages else 0, ROWS):
            own = texts.iloc[first:first + ROWS].tolist()
            rows = [i for i, x in enumerate(own) if x is not None and len(x) > 1]
            if not rows:
                continue
            score = m.scores([own[i].encode() for i in rows])
            top = np.sort(score, axis=1)
            lead = top[:, -1] - top[:, -2] if len(m.languages) > 1 else np.full(len(rows), np.inf)
            at = first + np.array(rows)
            margins[at] = lead
            language[at] = np.where(lead >= min_margin, np.array(m.languages, object)[score.argmax(1)], UNKNOWN)
        del texts
        release()
        return pd.DataFrame({"language": language, "margin": margins})

    d = "__detected"
    got = df.withColumn(d, detect(letters_only(text))).withColumn(out, F.col(f"{d}.language"))
    if margin:
        got = got.withColumn(margin, F.nanvl(F.col(f"{d}.margin"), F.lit(None).cast("double")))
    return got.drop(d)


def filter_learned_language(df: DataFrame, model: LanguageModel, text: str = "abstract", keep: str = "en", min_margin: float = 0.0) -> DataFrame:
    """C5 with a learnt model: the rows of ``df`` whose text is in ``keep`` with a lead of ``min_margin``."""
    return with_language(df, model, text, "__language", min_margin=min_margin).filter(F.col("__language") == keep).drop("__language")


def model_sql(rows: str, text: str = "text", lang: str = "lang") -> str:
    """DuckDB twin: CTEs ``lm_pairs`` (lang, pair, ll) and ``lm_default`` (lang, ll of an unseen pair), learnt from the rows of ``rows``."""
    return rf"""lm_text AS (SELECT {lang} AS lang, hex(encode({letters_only_sql(text)})) AS h FROM {rows} WHERE {text} IS NOT NULL AND {lang} IS NOT NULL),
lm_count AS (SELECT lang, substr(h, CAST(2 * i + 1 AS BIGINT), 4) AS pair, count(*) AS n FROM (SELECT lang, h, unnest(range(0, len(h) // 2 - 1)) AS i FROM lm_text) GROUP BY ALL),
lm_total AS (SELECT lang, sum(n) AS total FROM lm_count GROUP BY lang),
lm_default AS (SELECT lang, ln(1.0 / (total + {PAIRS})) AS ll FROM lm_total),
lm_pairs AS (SELECT lang, pair, ln((n + 1.0) / (total + {PAIRS})) AS ll FROM lm_count JOIN lm_total USING (lang))"""


def scored_sql(rows: str, key: str, text: str = "text", min_margin: float = 0.0) -> str:
    """DuckDB twin: CTE ``lm_found`` (key, language, margin) for the rows of ``rows``, after ``model_sql``."""
    return rf"""lm_hex AS (SELECT {key}, hex(encode({letters_only_sql(text)})) AS h FROM {rows} WHERE {text} IS NOT NULL),
lm_doc AS (SELECT {key}, substr(h, CAST(2 * i + 1 AS BIGINT), 4) AS pair, count(*) AS n FROM (SELECT {key}, h, unnest(range(0, len(h) // 2 - 1)) AS i FROM lm_hex) GROUP BY ALL),
lm_score AS (SELECT {key}, d.lang, sum(n * coalesce(p.ll, d.ll)) / sum(n) AS s FROM lm_doc CROSS JOIN lm_default d LEFT JOIN lm_pairs p ON p.lang = d.lang AND p.pair = lm_doc.pair GROUP BY ALL),
lm_found AS (SELECT {key}, CASE WHEN m >= {min_margin} THEN language ELSE '{UNKNOWN}' END AS language, m AS margin FROM (
  SELECT {key}, arg_max(lang, s) AS language, max(s) - list_sort(list(s))[-2] AS m FROM lm_score GROUP BY {key}))"""
