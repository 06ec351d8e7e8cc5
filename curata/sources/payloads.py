"""Landed source payloads -> rows -> unified records (survey A3-A5, A10, A11,
B1-B12, I11).

The reference calls six HTTP APIs and flattens each JSON / Atom-XML response
with pandas.  Here responses are *landed* first (one row per response:
``request_id, source, query_name, query_value, page, body``) and parsed by
Spark: ``from_json`` / ``from_xml`` with an explicit schema, ``inline`` of the
record array, then one ``select`` per source maps its fields onto the unified
columns (``SourceSpec``).  Parsing is per row, so it spreads over all tasks.

A record's place is (query_name, page, pos); ``curation.ingest`` numbers the rows
of all sources by it.  Test responses are made in ``sources.landed_fixture``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_dates
from ..functions.text import blank_to_null, query_operators_to_words
from ..schema import CORE_COLUMNS

#: Order of a source's raw records; unique where a page lands once.
ORDER = ["query_name", "page", "pos"]

# ---- response schemas (fixed values: field names of each source's responses) --------

S2_RECORD = T.StructType([
    T.StructField("paperId", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("venue", T.StringType()), T.StructField("year", T.DoubleType()),
    T.StructField("externalIds", T.StructType([T.StructField("DOI", T.StringType()),
                                               T.StructField("MAG", T.StringType())])),
])
SPRINGER_RECORD = T.StructType([
    T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("contentType", T.StringType()),
    T.StructField("publicationName", T.StringType()), T.StructField("publisher", T.StringType()),
    T.StructField("publicationDate", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("url", T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))),
])
IEEE_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in
                            ["doi", "title", "publisher", "content_type", "abstract", "html_url",
                             "publication_title", "publication_date"]])
CORE_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in
                            ["id", "doi", "title", "abstract", "url", "publication", "publisher", "publication_date"]])
SCOPUS_RECORD = T.StructType([
    T.StructField("eid", T.StringType()), T.StructField("dc:identifier", T.StringType()),
    T.StructField("prism:doi", T.StringType()), T.StructField("pii", T.StringType()),
    T.StructField("subtypeDescription", T.StringType()),
    T.StructField("prism:publicationName", T.StringType()), T.StructField("dc:publisher", T.StringType()),
    T.StructField("prism:coverDate", T.StringType()), T.StructField("dc:title", T.StringType()),
    T.StructField("dc:description", T.StringType()),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("@ref", T.StringType()),
                                                    T.StructField("@href", T.StringType())]))),
])
ARXIV_FEED = T.StructType([
    T.StructField("entry", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ["id", "title", "summary", "published"]]))),
])


def envelope(record: T.StructType, array_path: list[str], total_path: list[str]) -> T.StructType:
    """Schema of a JSON response holding ``array<record>`` at ``array_path``."""
    def nest(path, leaf):
        if len(path) == 1:
            return [T.StructField(path[0], leaf)]
        return [T.StructField(path[0], T.StructType(nest(path[1:], leaf)))]
    fields = nest(array_path, T.ArrayType(record))
    if total_path[0] == array_path[0] and len(total_path) > 1:   # e.g. search-results.{total, entry}
        fields[0].dataType.fields.append(T.StructField(total_path[1], T.StringType()))
    elif total_path[0] == "result":
        fields.append(T.StructField("result", T.ArrayType(T.StructType([T.StructField("total", T.StringType())]))))
    else:
        fields.append(T.StructField(total_path[0], T.StringType()))
    return T.StructType(fields)


def explode_json(df: DataFrame, body: str, schema: T.StructType, array_path: list[str],
                 keep: list[str] = ()) -> DataFrame:
    """A4: parse JSON responses and emit one row per element of the record
    array at ``array_path`` (``posexplode`` keeps the position in the page)."""
    parsed = df.withColumn("__doc", F.from_json(F.col(body), schema))
    arr = F.col("__doc")
    for p in array_path:
        arr = arr.getField(p)
    rows = parsed.select(*keep, F.posexplode(arr).alias("pos", "rec"))
    return rows.select(*keep, "pos", "rec.*")


def explode_atom(df: DataFrame, body: str, keep: list[str] = ()) -> DataFrame:
    """A3: parse Atom feeds; each ``entry`` becomes a row.  Surrounding
    whitespace of the text nodes is kept (abstracts are compared verbatim)."""
    parsed = df.withColumn("__doc", F.from_xml(F.col(body), ARXIV_FEED,
                                               {"ignoreSurroundingSpaces": "false", "rowTag": "feed"}))
    return parsed.select(*keep, F.posexplode("__doc.entry").alias("pos", "rec")).select(*keep, "pos", "rec.*")


# Where each source announces its total.
TOTAL_PATHS = {
    "semantic_scholar": "$.total",
    "springer": "$.result[0].total",
    "core": "$.totalHits",
    "ieeexplore": "$.total_records",
    "scopus": "$['search-results']['opensearch:totalResults']",
}
ATOM_TOTAL = r"<(?:[A-Za-z]+:)?totalResults[^>]*>\s*(\d+)\s*<"   # with or without a namespace prefix


def payload_totals(df: DataFrame, body: str = "body", source: str = "source") -> DataFrame:
    """A5: the announced result total of each response (unreadable -> 0); the
    source decides which one path is read, without a source all are tried."""
    b = F.col(body)
    paths = {name: F.get_json_object(b, path) for name, path in TOTAL_PATHS.items()}
    paths["arxiv"] = F.nullif(F.regexp_extract(b, ATOM_TOTAL, 1), F.lit(""))
    if source in df.columns:
        total = F.lit(None).cast("string")
        for name, value in paths.items():
            total = F.when(F.col(source) == name, value).otherwise(total)
    else:
        total = F.coalesce(*paths.values())
    return df.withColumn("total", F.coalesce(total.try_cast("long"), F.lit(0).cast("long")))


def with_provenance(df: DataFrame, database: str | Column, query_name: str | Column, query_value: str | Column) -> DataFrame:
    """A10: stamp every row with its source, query name and query text
    (internal ``<AND>``/``<OR>`` tokens spelled as words)."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.withColumns({"database": lit(database), "query_name": lit(query_name),
                           "query_value": query_operators_to_words(lit(query_value))})


def pick_link(links: str | Column, ref: str | None = None, ref_field: str = "@ref", value_field: str = "@href") -> Column:
    """The first link's value, or the first link whose ``ref`` matches."""
    col = F.col(links) if isinstance(links, str) else links
    if ref is None:
        return F.get(col, F.lit(0)).getField(value_field)   # NULL for empty / NULL arrays
    hit = F.filter(col, lambda x: x.getField(ref_field) == F.lit(ref))
    return F.get(hit, F.lit(0)).getField(value_field)


def scopus_id(eid: str = "eid", ident: str = "dc:identifier") -> Column:
    """``eid``, else the text after ``SCOPUS_ID:``, else ''."""
    return F.coalesce(blank_to_null(F.col(f"`{eid}`")),
                      blank_to_null(F.regexp_extract(F.col(f"`{ident}`"), r"SCOPUS_ID:(.*)$", 1)),
                      F.lit(""))


def coalesce_id(*cols: str) -> Column:
    """The first non-blank identifier."""
    return F.coalesce(*[blank_to_null(F.trim(F.col(c))) for c in cols])


def model_text(title: str = "title", abstract: str = "abstract") -> Column:
    """Encoder input ``title[SEP]abstract`` (NULL if either is NULL)."""
    return F.concat(F.col(title), F.lit("[SEP]"), F.col(abstract))


def stamp(df: DataFrame, type: str | None = None, status: str | None = None) -> DataFrame:
    """B6."""
    cols = {}
    if type is not None:
        cols["type"] = F.lit(type)
    if status is not None:
        cols["status"] = F.lit(status)
    return df.withColumns(cols)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL (or '') in every row.  The schema depends
    on the data, so this runs one aggregate (a count per column) first."""
    counts = df.agg(*[F.count(blank_to_null(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(c)
                      for c, t in df.dtypes]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


# ---- source registry (A11) ---------------------------------------------------------

@dataclass(frozen=True)
class SourceSpec:
    """How one source's rows map onto the unified columns."""
    name: str
    parse: Callable[[DataFrame], DataFrame]          # landed payloads -> raw rows
    key: str                                         # keep-first key within the source (B1)
    columns: dict[str, Callable[[], Column]]         # unified name -> expression on raw rows
    date_col: str | None = None                      # raw date text parsed by the ladder (I5)
    drop: list[str] = field(default_factory=list)    # B2


KEEP = ["request_id", "query_name", "query_value", "page"]


def _json(schema, path):
    return lambda df: explode_json(df, "body", schema, path, KEEP)


_REGISTRY: dict[str, SourceSpec] = {}


def register_source(spec: SourceSpec) -> None:
    _REGISTRY[spec.name] = spec


def source(name: str) -> SourceSpec:
    if name not in _REGISTRY:
        raise KeyError(f"unknown source {name!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def sources() -> list[str]:
    return sorted(_REGISTRY)


c = F.col
register_source(SourceSpec(
    "ieeexplore", _json(envelope(IEEE_RECORD, ["articles"], ["total_records"]), ["articles"]), "doi",
    {"doi": lambda: c("doi"), "publication": lambda: c("publication_title"), "publisher": lambda: c("publisher"),
     "title": lambda: c("title"), "url": lambda: c("html_url"), "abstract": lambda: c("abstract"),
     "type": lambda: c("content_type")}, "publication_date"))
register_source(SourceSpec(
    "springer", _json(envelope(SPRINGER_RECORD, ["records"], ["result"]), ["records"]), "doi",
    {"doi": lambda: c("doi"), "publication": lambda: c("publicationName"), "publisher": lambda: c("publisher"),
     "title": lambda: c("title"), "url": lambda: pick_link("url", value_field="value"),
     "abstract": lambda: c("abstract"), "type": lambda: c("contentType")}, "publicationDate"))
register_source(SourceSpec(
    "arxiv", lambda df: explode_atom(df, "body", KEEP), "id",
    {"doi": lambda: c("id"), "publication": lambda: F.lit("arxiv"), "publisher": lambda: F.lit("arxiv"),
     "title": lambda: c("title"), "url": lambda: c("id"), "abstract": lambda: c("summary")}, "published"))
register_source(SourceSpec(
    "scopus", _json(envelope(SCOPUS_RECORD, ["search-results", "entry"], ["search-results", "opensearch:totalResults"]),
                    ["search-results", "entry"]), "id",
    {"doi": lambda: c("id"), "publication": lambda: c("`prism:publicationName`"),
     "publisher": lambda: c("`dc:publisher`"), "title": lambda: c("`dc:title`"),
     "url": lambda: pick_link("link", "scopus"), "abstract": lambda: c("`dc:description`"),
     "type": lambda: c("subtypeDescription")}, "prism:coverDate"))
register_source(SourceSpec(
    "core", _json(envelope(CORE_RECORD, ["results"], ["totalHits"]), ["results"]), "id",
    {"doi": lambda: coalesce_id("doi", "id"), "publication": lambda: F.lit("core"),
     "publisher": lambda: F.lit("core"), "title": lambda: c("title"), "url": lambda: c("url"),
     "abstract": lambda: c("abstract")}, "publication_date"))
register_source(SourceSpec(
    "semantic_scholar", _json(envelope(S2_RECORD, ["data"], ["total"]), ["data"]), "paperId",
    {"doi": lambda: coalesce_id("externalIds.DOI", "paperId"), "publication": lambda: F.lit("semantic_scholar"),
     "publisher": lambda: c("venue"), "title": lambda: c("title"), "url": lambda: c("url"),
     "abstract": lambda: c("abstract")}, "year"))


def raw_rows(payloads: DataFrame, name: str) -> DataFrame:
    """Rows of one source's landed responses; their order is ``ORDER``."""
    spec = source(name)
    rows = spec.parse(payloads.filter(F.col("source") == name))
    if name == "scopus":
        rows = rows.withColumn("id", coalesce_id("prism:doi")).withColumn("scopus_id", scopus_id())
    return rows


def normalise(rows: DataFrame, name: str, dedup: bool = True, keep: list[str] = (),
              parse: bool = True, nulls: str = "all") -> DataFrame:
    """B1: keep-first on the source key (unless ``dedup=False``; records
    without a key all stay, ``nulls='one'`` merges them as the reference does), then the
    unified columns, ``page`` and ``pos`` (plus raw columns ``keep``); dates are parsed (I5), a
    float year too.  With ``parse=False`` the date text is left in ``publication_date`` for
    one parse after a union of several sources."""
    from ..operators.dedup import keep_first

    spec = source(name)
    rows = rows.drop(*spec.drop)          # B2: unknown names are ignored
    if dedup:
        rows = keep_first(rows, F.col(f"`{spec.key}`") if "." not in spec.key else F.col(spec.key), ORDER, nulls)
    text = F.col(f"`{spec.date_col}`").cast("string")
    rows = rows.withColumn("publication_date", F.split_part(text, F.lit("."), F.lit(1)) if spec.date_col == "year" else text)
    if parse:
        rows = parse_dates(rows, "publication_date")
    out = rows.select(
        *[spec.columns[k]().alias(k) if k in spec.columns else F.lit(None).cast("string").alias(k)
          for k in CORE_COLUMNS if k not in ("query_name", "query_value", "database", "publication_date")],
        "publication_date", "query_value", *ORDER, *[F.col(f"`{k}`") for k in keep if k in rows.columns])
    return out.withColumn("database", F.lit(name))


# ---- abstract lookups (I11, D2) ------------------------------------------------------

# Where an abstract can sit in a retrieval response, in priority order.
ABSTRACT_PATHS = [
    "$['full-text-retrieval-response']['coredata']['dc:description']",
    "$['abstracts-retrieval-response']['coredata']['dc:description']",
    "$['abstracts-retrieval-response']['item']['bibrecord']['head']['abstracts']['abstract']['abstractText']",
    "$['abstracts-retrieval-response']['item']['bibrecord']['head']['abstracts']['abstract'][0]['abstractText']",
    "$['abstract']",
]


def json_abstract(body: str | Column) -> Column:
    """The first non-blank abstract found along ABSTRACT_PATHS."""
    b = F.col(body) if isinstance(body, str) else body
    return F.coalesce(*[blank_to_null(F.get_json_object(b, p)) for p in ABSTRACT_PATHS])


# ---- files: CSV stage tables, partitioned raw landing (A1, A7, A8) --------------------

def read_papers_csv(spark, path: str, schema: T.StructType, on_bad: str = "fail",
                    corrupt_col: str = "_corrupt_record", multiline: bool = False) -> DataFrame:
    """CSV with a header and quoted fields.  An empty field reads as NULL
    (as ``pd.read_csv`` does).  ``multiline`` allows line ends inside fields, at a price: such a file
    is read by one task (Parquet stage tables have no such limit).

    on_bad='fail' raises on a malformed row; 'quarantine' keeps it with NULL fields
    and the raw line in ``corrupt_col``; ``quarantined`` splits such rows off and counts them.
    There is no mode that drops rows unseen."""
    mode = {"fail": "FAILFAST", "quarantine": "PERMISSIVE"}[on_bad]
    s = schema
    if on_bad == "quarantine":
        s = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
    r = (spark.read.schema(s).option("header", True).option("multiLine", multiline).option("escape", '"')
         .option("mode", mode))
    if on_bad == "quarantine":
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    return r.csv(path)


def quarantined(df: DataFrame, stage_path: str, corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a 'quarantine' read.

    The file is parsed once and written to a stage table; both halves read that
    table.  (Spark refuses queries on raw CSV that need only the corrupt-record
    column, and parsing twice would double the cost.)"""
    df.write.mode("overwrite").parquet(stage_path)
    t = df.sparkSession.read.parquet(stage_path)
    return t.filter(F.col(corrupt_col).isNull()).drop(corrupt_col), t.filter(F.col(corrupt_col).isNotNull())


def land_payloads(payloads: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write landed responses partitioned by ``source``/``query_name`` (one
    folder per query x source, as the reference keeps one file each)."""
    payloads.write.mode(mode).partitionBy("source", "query_name").parquet(root)


def load_raw(spark, root: str, queries: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The landed responses of the wanted queries x sources.  The filter is
    on partition columns, so Spark lists and reads only those folders; a
    missing query or source just contributes no rows."""
    df = spark.read.parquet(root)
    if queries is not None:
        df = df.filter(F.col("query_name").isin([q.lower().replace(" ", "_") for q in queries]))
    if names is not None:
        df = df.filter(F.col("source").isin(list(names)))
    return df


# ---- citation responses (B11) -----------------------------------------------------------

CITING_RECORD = T.StructType([T.StructField("citingPaper", T.StructType([
    T.StructField("paperId", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()),
    T.StructField("venue", T.StringType()), T.StructField("year", T.IntegerType())]))])


def flatten_citations(payloads: DataFrame) -> DataFrame:
    """Citation responses -> record rows: ``citingPaper.*`` renamed to the
    unified names, ``query_name='citation'``, year -> 1 January (I6)."""
    rows = explode_json(payloads, "body", T.StructType([T.StructField("data", T.ArrayType(CITING_RECORD))]),
                        ["data"], ["cited_ord"])
    return rows.select(
        "cited_ord", "pos",
        F.col("citingPaper.paperId").alias("doi"), F.col("citingPaper.title").alias("title"),
        F.col("citingPaper.abstract").alias("abstract"), F.col("citingPaper.url").alias("url"),
        F.col("citingPaper.venue").alias("publisher"),
        F.make_date(F.col("citingPaper.year"), F.lit(1), F.lit(1)).alias("publication_date"),
        F.lit("citation").alias("query_name"), F.lit("semantic_scholar").alias("database"))
