"""Composed steps of a survey (survey M1-M6), each a lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import with_language
from ..operators import filters
from ..operators.language_model import LanguageModel, filter_learned_language
from ..sources.stages import StageStore


def clean_papers(df: DataFrame, title_terms: Sequence[str] = filters.TITLE_BLOCK_TERMS,
                 abstract_words: Sequence[str] = filters.ABSTRACT_BLOCK_WORDS, lang: str = "en",
                 model: LanguageModel | None = None, min_margin: float = 0.0) -> DataFrame:
    """M2: require title and abstract, title block-list (substring), abstract
    block-list (whole word), detected language.  The four predicates are
    order-free, so Catalyst fuses them into one ``Filter`` after the scan.  The language is detected by word profiles
    or, where one is given, by a learnt ``model`` that must lead by ``min_margin``."""
    out = filters.require_text(df, ["abstract", "title"])
    out = filters.exclude_title_terms(out, title_terms)
    out = filters.exclude_abstract_words(out, abstract_words)
    if model is not None:
        return filter_learned_language(out, model, "abstract", lang, min_margin)
    return with_language(out, "abstract", "__lang").filter(F.col("__lang") == F.lit(lang)).drop("__lang")


def snowball(selected: DataFrame, edges: DataFrame, records: DataFrame, removed: DataFrame,
             vectors: DataFrame, threshold: float, undecided_records: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """M3: citations of the selected set (D1) and retrieved records nobody has
    decided on, minus what is already decided (D4), scored against the selected set as seeds (S2),
    stamped and re-id'd.

    ``vectors`` is ``(id, embedding)``: one for every record, see ``record_vectors``."""
    from ..operators.joins import expand_citations, undecided
    from ..operators.ordering import with_dense_id
    from ..operators.relevance import relevance_to_seeds

    cites = expand_citations(selected, edges, records)
    open_ = cites.limit(0) if undecided_records is None else undecided_records
    cols = [c for c in cites.columns if c in open_.columns]
    cand = undecided(open_.select(cols), selected, cites.select(cols), removed, mode="clean")
    seeds = selected.select("id").join(vectors, "id")
    scored = relevance_to_seeds(cand.join(vectors, "id"), seeds, threshold).drop("embedding")
    out = scored.withColumnRenamed("id", "record_id").withColumns({"type": F.lit("snowball"), "status": F.lit("unknown")})
    return with_dense_id(out) if ids else out


def record_vectors(records: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(id, embedding) of every record: the stored vector, else the encoding of
    title and abstract (S3 on B12).  Vectors of different length do not mix: with stored vectors of ``d`` numbers the
    encoder is given the same ``d``."""
    from ..operators.relevance import hashing_encoder
    from ..sources.payloads import model_text

    text = records.select("id", F.coalesce(model_text(), F.col("title"), F.col("abstract"), F.lit("")).alias("__text"))
    if vectors is None:
        return hashing_encoder(text, "__text").select("id", "embedding")
    first = vectors.select(F.size("embedding").alias("d")).first()
    missing = text.join(vectors.select("id"), "id", "left_anti")
    coded = hashing_encoder(missing, "__text", dim=first.d if first else 256).select("id", "embedding")
    return vectors.select("id", "embedding").unionByName(coded)


def merge_final(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """M4: union of the reviewed sets (either may be missing, quirk Q16), the
    final de-dup (F8, which ends with the F5 cascade), dense ids."""
    from ..operators.aggregates import union_aligned
    from ..operators.dedup import final_dedup
    from ..operators.ordering import with_dense_id

    both = union_aligned(first, second) if second is not None else first
    return with_dense_id(final_dedup(both.drop("id")))


def reviewed(df: DataFrame, decisions: DataFrame, name: str, key: str = "id", store: StageStore | None = None):
    """The abstract round and, on what it includes, the full-text round; every
    round's table is written once and split by filters.  ``key`` holds the record id that decisions
    name.  Returns (included, removed), with ``record_id``."""
    from ..operators.review import review_round

    def round_(rows, which):
        rows = rows.withColumn("id", F.col("record_id"))
        inc, out, _ = review_round(rows, decisions, which, stage=lambda d: _stage(store, f"{name}-{which}", d, decisions), ids=False)
        return inc, out

    rows = df.withColumn("record_id", F.col(key))
    passed, out1 = round_(rows, "abstract")
    included, out2 = round_(passed, "full_text")
    return included, out1.unionByName(out2, allowMissingColumns=True)


def _stage(store: StageStore | None, name: str, df: DataFrame, *inputs: DataFrame, params: object = None) -> DataFrame:
    """A stage table of the survey: of this run alone, or one that a later run finds again."""
    from ..sources.stages import cut
    return cut(df, name) if store is None else store.stage(name, df, *inputs, params=params)


def survey_stages(papers: DataFrame, decisions: DataFrame, edges: DataFrame, vectors: DataFrame,
                  start=None, end=None, title_terms=filters.TITLE_BLOCK_TERMS,
                  abstract_words=filters.ABSTRACT_BLOCK_WORDS, snowball_threshold: float = 0.0,
                  query_vec=None, semantic_threshold: float = 0.0, store: StageStore | None = None) -> dict[str, DataFrame]:
    """M6 step by step; every stage is written once to the shared checkpoint
    folder (lineage cut), as the reference keeps one file per step.  With a ``store`` the stages outlive the run: a later
    one reuses those whose inputs and parameters are unchanged and goes on where an interrupted one stopped.

    date range -> de-dup cascade (F5) -> cleaning (M2) -> semantic filter (S1, only with a
    ``query_vec``) -> abstract and full-text round (R2) -> snowball from the included set, over its
    citations and the undecided records (M3) -> both rounds on the snowballed records -> merge of the
    two reviewed sets (M4)."""
    from ..operators.dedup import remove_repeated
    from ..operators.relevance import semantic_filter

    p = filters.between_dates(papers, start, end)
    p = _stage(store, "cleaned", clean_papers(remove_repeated(p), title_terms, abstract_words), papers,
               params=[str(start), str(end), list(title_terms), list(abstract_words)])
    stages = {"cleaned": p}
    if query_vec is not None:
        scored = semantic_filter(p.drop("semantic_score").join(vectors, "id"), query_vec, semantic_threshold, unit=True)
        p = stages["semantic"] = _stage(store, "semantic", scored.drop("embedding"), p, vectors, params=[str(query_vec), semantic_threshold])
    included, removed = reviewed(p, decisions, "retrieved", store=store)
    selected = included.withColumn("id", F.col("record_id"))
    open_ = (p.join(included.select("ord"), "ord", "left_anti").join(removed.select("ord"), "ord", "left_anti"))
    snow = _stage(store, "snowball", snowball(selected, edges, papers.drop("lang"), removed, vectors, snowball_threshold, open_, ids=False),
                  selected, edges, papers, removed, vectors, params=snowball_threshold)
    found, dropped = reviewed(snow, decisions, "snowballed", "record_id", store)
    return stages | {"included": included, "removed": removed, "snowball": snow, "snowball_included": found,
                     "snowball_removed": dropped, "final": merge_final(included, found)}


def run_survey(*args, **kwargs) -> DataFrame:
    """M6: the survey end to end (``survey_stages``), decisions from a table instead of prompts."""
    return survey_stages(*args, **kwargs)["final"]


def ingest(payloads: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Landed responses of every source -> unified rows (A3/A4 parse, B1
    normalise, A10 provenance, H1 union).  ``ord`` numbers them by source (in the order of ``names``), query,
    page and place in the page: dense and unique, whatever the page numbers are."""
    from ..functions.dates import parse_dates
    from ..operators.ordering import with_dense_id
    from ..sources import payloads as P

    out = None
    for rank, n in enumerate(names or P.sources()):
        part = P.normalise(P.raw_rows(payloads, n), n, parse=False).withColumn("__rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    out = parse_dates(out, "publication_date")   # once, after the union: the plan is six times smaller
    out = with_dense_id(out, ["__rank", *P.ORDER], "ord").drop("__rank", "page", "pos")
    return P.with_provenance(out, F.col("database"), F.col("query_name"), F.col("query_value"))


def preprocess(payloads: DataFrame, start=None, end=None, title_terms=filters.TITLE_BLOCK_TERMS,
               abstract_words=filters.ABSTRACT_BLOCK_WORDS) -> DataFrame:
    """M1: ingest -> stamp -> date range -> de-dup cascade -> cleaning -> dense
    ids.  The ingested records are a stage table already (their numbering writes it), so the date filter reads
    parsed dates and the cascade runs once."""
    from ..operators.dedup import remove_repeated
    from ..operators.ordering import with_dense_id
    from ..sources.payloads import stamp

    p = filters.between_dates(stamp(ingest(payloads), "preprocessed", "unknown"), start, end)
    return with_dense_id(clean_papers(remove_repeated(p), title_terms, abstract_words))


def source_postprocess(payloads: DataFrame, name: str, start=None, end=None, lang: str = "en",
                       lookups=None) -> DataFrame:
    """M5: what a source client does with a fetched page, in its order: parse,
    optional abstract enrichment (D2, Scopus: by DOI, then by SCOPUS_ID), drop blank titles, keep-first on
    the lower-cased title, drop blank abstracts, keep-first on the DOI (records without one all
    stay), declared language (C4, when the source has one), date
    range (C6); unified columns (the lower-cased title is only the key, the
    text is kept -- quirk Q17).  The order is (query_name, page, pos)."""
    from ..functions.text import blank_to_null, long_key
    from ..operators.dedup import keep_first
    from ..operators.joins import enrich_abstract
    from ..sources import payloads as P

    rows = P.raw_rows(payloads, name)
    out = P.normalise(rows, name, dedup=False, keep=["language", "scopus_id"])
    if lookups:
        out = enrich_abstract(out, lookups)
    out = out.withColumns({"title": blank_to_null("title"), "abstract": blank_to_null("abstract")})
    out = keep_first(out.filter(F.col("title").isNotNull()), long_key(F.lower(F.col("title"))), P.ORDER, "one")
    out = keep_first(out.filter(F.col("abstract").isNotNull()), F.col("doi"), P.ORDER, "all")
    out = filters.filter_language(out, lang, col="language")
    return filters.between_dates(out, start, end)
