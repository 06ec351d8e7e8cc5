"""Language detection without a model (survey C5).

Each text is split into letter runs over its whole length; for every language
we count the tokens that belong to its profile of function words, and the
language with most hits wins (ties: the order below).  No hit at all gives
``unknown``, which counts as "not English", as a failed detection does in the
reference.  Pure Column expressions: no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function-word profiles (frequent words; one that several languages share is in each of them).
PROFILES: dict[str, list[str]] = {
    "en": "the of and to is that it for was with this are we by be as on in from at an or which have not our can these than".split(),
    "fr": "le les et du une pour est qui dans sur avec pas la de des un en que par au ce il sont nous plus cette ou".split(),
    "de": "der die und den von zu das mit sich auf für nicht ein eine ist des dem im wir werden oder als auch wird aus bei".split(),
    "es": "el y los se del las por con su una para al la de que en un es lo como más este entre son".split(),
    "pt": "o os e do da em um uma para com não dos das no na ao pela por mais como se são este que de a".split(),
    "it": "il di e che la per un una con del della non sono gli nel alla dei si da più come questo le in è".split(),
    "nl": "de het een van en in is dat op te zijn voor met niet aan er door ook bij wij deze worden of uit naar".split(),
}
LANG_ORDER = list(PROFILES)
TOKEN_SPLIT = r"[^\p{L}]+"


def _known(toks: Column) -> Column:
    """Only the tokens that some profile has: one look-up in a hash set for each token of the text."""
    return F.filter(toks, lambda t: t.isin(sorted(set().union(*PROFILES.values()))))


def _counts(toks: Column) -> list[Column]:
    """Tokens of each profile; the optimiser turns the lists into hash sets."""
    def member_of(ws):
        return lambda t: t.isin(ws)
    return [F.size(F.filter(toks, member_of(ws))).cast("long") for ws in PROFILES.values()]


def _label(counts: list[Column], min_margin: int) -> Column:
    # sorted (hits, priority, code), most hits first, then the earlier language;
    # the first one wins if it has hits enough over the second one
    n = len(LANG_ORDER)
    cands = F.sort_array(F.array(*[F.struct(cnt.alias("hits"), F.lit(n - i).alias("prio"), F.lit(lang).alias("code"))
                                   for i, (cnt, lang) in enumerate(zip(counts, LANG_ORDER))]), asc=False)
    sure = (cands[0]["hits"] > 0) & (cands[0]["hits"] - cands[1]["hits"] >= min_margin)
    return F.when(sure, cands[0]["code"]).otherwise(F.lit("unknown"))


def detect_language(c, min_margin: int = 0) -> Column:
    """Language code with most profile hits; ``unknown`` when there is none, or
    when it has fewer than ``min_margin`` hits more than the next one.

    The token array is bound to a lambda variable, so the text is split once
    per row even when the optimizer pushes a filter on the result through the
    projections (it would otherwise inline the split into each profile count)."""
    col = F.col(c) if isinstance(c, str) else c
    label = F.element_at(F.transform(F.array(_known(F.split(F.lower(col), TOKEN_SPLIT))),
                                     lambda toks: F.element_at(F.transform(F.array(F.array(*_counts(toks))),
                                                                           lambda n: _label([n[i] for i in range(len(PROFILES))], min_margin)), 1)), 1)
    return F.coalesce(label, F.lit("unknown"))


def with_language(df: DataFrame, c: str, out: str = "language") -> DataFrame:
    """``detect_language`` as a column of ``df``."""
    return df.withColumn(out, detect_language(c))


def detect_language_sql(c: str) -> str:
    """DuckDB twin of ``detect_language`` (test oracle)."""
    toks = f"string_split_regex(lower({c}), '[^\\p{{L}}]+')"
    cnt = {lang: f"len(list_filter({toks}, lambda t: list_contains([{', '.join(repr(w) for w in ws)}], t)))"
           for lang, ws in PROFILES.items()}
    best = "greatest(" + ", ".join(cnt.values()) + ")"
    whens = " ".join(f"WHEN {cnt[lang]} = {best} THEN '{lang}'" for lang in LANG_ORDER)
    return f"(CASE WHEN {c} IS NULL OR {best} = 0 THEN 'unknown' {whens} END)"
