"""Test responses: what the six sources would have answered for the records of
the driver's ``documents`` table, so that ingestion can be run end to end.  The
library itself does not use this module; the field names are those of
``sources.payloads``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import sources

c = F.col

#: Record slots of a page.
PAGE_SLOTS = 150
#: Requests of pages p with p % 3 = 1 announce two records more than they deliver.
SHORT = 2


def _xml_text(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _xml_elem(tag: str, col: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), _xml_text(col), F.lit(f"</{tag}>"))


def _record(name: str) -> Column:
    iso = F.date_format("publication_date", "yyyy-MM-dd")
    if name == "ieeexplore":
        return F.struct(c("doi"), c("title"), c("publisher"), F.lit("Journals").alias("content_type"), c("abstract"),
                        c("url").alias("html_url"), c("publication").alias("publication_title"),
                        iso.alias("publication_date"))
    if name == "springer":
        return F.struct(c("doi"), c("title"), c("abstract"), F.lit("Article").alias("contentType"),
                        c("publication").alias("publicationName"), c("publisher"), iso.alias("publicationDate"),
                        c("lang").alias("language"), F.array(F.struct(c("url").alias("value"))).alias("url"))
    if name == "scopus":
        return F.struct(F.concat(F.lit("2-s2.0-"), c("ord").cast("string")).alias("eid"),
                        F.concat(F.lit("SCOPUS_ID:"), c("ord").cast("string")).alias("dc:identifier"),
                        c("doi").alias("prism:doi"), F.lit("Article").alias("subtypeDescription"),
                        c("publication").alias("prism:publicationName"), c("publisher").alias("dc:publisher"),
                        iso.alias("prism:coverDate"), c("title").alias("dc:title"), c("abstract").alias("dc:description"),
                        F.array(F.struct(F.lit("self").alias("@ref"), F.lit("https://api.example.org").alias("@href")),
                                F.struct(F.lit("scopus").alias("@ref"), c("url").alias("@href"))).alias("link"))
    if name == "core":
        return F.struct(F.concat(F.lit("core:"), c("ord").cast("string")).alias("id"), c("doi"), c("title"), c("abstract"),
                        c("url"), c("publication"), c("publisher"), iso.alias("publication_date"))
    if name == "semantic_scholar":
        return F.struct(F.concat(F.lit("p"), c("ord").cast("string")).alias("paperId"), c("title"), c("abstract"),
                        c("url"), c("publisher").alias("venue"), F.year("publication_date").cast("double").alias("year"),
                        F.struct(c("doi").alias("DOI")).alias("externalIds"))
    # arxiv: one Atom <entry> per record
    return F.concat_ws("", F.lit("<entry>"), _xml_elem("id", c("doi")), _xml_elem("title", c("title")),
                       _xml_elem("summary", c("abstract")),
                       _xml_elem("published", F.concat(iso, F.lit("T00:00:00Z"))), F.lit("</entry>"))


def _body(name: str, recs: Column, total: Column) -> Column:
    t = total.cast("string")
    if name == "arxiv":
        return F.concat(F.lit('<feed xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><opensearch:totalResults xmlns:o="x">'), t,
                        F.lit("</opensearch:totalResults>"), F.array_join(recs, ""), F.lit("</feed>"))
    if name == "ieeexplore":
        return F.to_json(F.struct(total.alias("total_records"), recs.alias("articles")))
    if name == "springer":
        return F.to_json(F.struct(F.array(F.struct(t.alias("total"))).alias("result"), recs.alias("records")))
    if name == "scopus":
        return F.to_json(F.struct(F.struct(t.alias("opensearch:totalResults"), recs.alias("entry")).alias("search-results")))
    if name == "core":
        return F.to_json(F.struct(total.alias("totalHits"), recs.alias("results")))
    return F.to_json(F.struct(total.alias("total"), recs.alias("data")))


def landed_payloads(papers: DataFrame) -> DataFrame:
    """One response per (source, query, page of PAGE_SLOTS record slots).

    A page gathers at most PAGE_SLOTS records (``collect_list`` of a bounded
    group), in record order; some announce more than they deliver (``SHORT``)."""
    out = None
    for name in sources():
        recs = papers.filter(F.col("database") == name).withColumn("page", F.floor(F.col("ord") / PAGE_SLOTS))
        recs = recs.withColumn("__rec", _record(name))
        pages = (recs.groupBy("query_name", "query_value", "page")
                 .agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("__rec")))).alias("__r"),
                      F.count(F.lit(1)).alias("__n")))
        total = F.col("__n") + F.when(F.col("page") % 3 == 1, SHORT).otherwise(0)
        body = _body(name, F.transform("__r", lambda x: x["__rec"]), total)
        one = pages.select(F.concat_ws(":", F.lit(name), F.col("query_name"), F.col("page").cast("string")).alias("request_id"),
                           F.lit(name).alias("source"), "query_name", "query_value", "page", body.alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


def abstract_lookups(papers: DataFrame, key: Column | None = None) -> DataFrame:
    """Retrieval responses derived from the records: ``(key, ord, body)`` by DOI
    (or another ``key``), in the response shapes of ABSTRACT_PATHS, rotating with the record order."""
    a = F.col("abstract")

    def nest(path: list[str], leaf: Column) -> Column:
        # struct(path[0] -> struct(path[1] -> ... leaf))
        out = leaf.alias(path[-1])
        for name in reversed(path[:-1]):
            out = F.struct(out).alias(name)
        return F.struct(out)

    shape = F.col("ord") % 4
    body = (F.when(shape == 0, F.to_json(nest(["full-text-retrieval-response", "coredata", "dc:description"], a)))
            .when(shape == 1, F.to_json(nest(["abstracts-retrieval-response", "coredata", "dc:description"], a)))
            .when(shape == 2, F.to_json(nest(["abstracts-retrieval-response", "item", "bibrecord", "head",
                                              "abstracts", "abstract", "abstractText"], a)))
            .otherwise(F.to_json(nest(["abstract"], a))))
    key = F.col("doi") if key is None else key
    return papers.select(key.alias("key"), "ord", body.alias("body")).filter(F.col("key").isNotNull())


def citation_payloads(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Citation responses (``{"data": [{"citingPaper": {...}}]}``) derived from
    edges and records: one response per cited record and page of PAGE_SLOTS
    citing slots (``citing_ord div PAGE_SLOTS``), so however often one record
    is cited, no response -- no ``collect_list`` group -- exceeds PAGE_SLOTS rows."""
    citing = records.select(F.col("ord").alias("citing_ord"), F.struct(
        F.coalesce(F.col("doi"), F.concat(F.lit("p"), F.col("ord").cast("string"))).alias("paperId"),
        "url", "title", "abstract", F.col("publisher").alias("venue"),
        F.year("publication_date").alias("year")).alias("citingPaper"))
    per_cited = (edges.join(citing, "citing_ord")
                 .groupBy("cited_ord", F.floor(F.col("citing_ord") / PAGE_SLOTS).alias("page"))
                 .agg(F.array_sort(F.collect_list(F.struct("citing_ord", "citingPaper"))).alias("__c")))
    return per_cited.select("cited_ord", "page", F.to_json(F.struct(
        F.transform("__c", lambda x: F.struct(x["citingPaper"].alias("citingPaper"))).alias("data"))).alias("body"))
