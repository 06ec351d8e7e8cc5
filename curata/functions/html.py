"""Text of one section of a web page (survey I12), with Spark's own functions.

Pages are no well-formed XML, so a section is found by its opening tag, and its end by depth: the page is cut at the tags of the section's
name, a running sum counts openings and closings, and the pieces up to the place where it returns to zero are joined once.  Quoted attribute values may hold
``>`` or whole tags; every tag is reduced to its name before it is counted.  Scripts, styles and comments go first; entities are resolved, numeric ones too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that are resolved (``&amp;`` last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
UNSEEN = r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->"
#: What a tag may hold: text without quotes or ``>``, and quoted values with anything.
BODY = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')"""


def _code_point(part: Column) -> Column:
    """A piece of text that may begin with a numeric entity, with the character in its place."""
    entity = r"^&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"
    digits = F.regexp_extract(part, entity, 1)
    number = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(F.regexp_extract(part, entity, 2)).try_cast("int")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(part.rlike(entity), F.concat(F.when(valid, char).otherwise(F.lit("�")), F.regexp_replace(part, entity, ""))).otherwise(part)


def plain_text(html: Column) -> Column:
    """Text without tags: a tag separates words, white space is collapsed."""
    text = F.regexp_replace(html, rf"<{BODY}*+>|<[^>]*>", " ")
    text = F.array_join(F.transform(F.split(text, "(?=&#)"), _code_point), "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def section_text(html: str | Column, tag: str, attributes: dict[str, str] | None = None) -> Column:
    """Text of the first ``tag`` element whose opening tag has every one of
    ``attributes`` (a class may be one of several); NULL if there is none.  An element that
    is never closed reaches to the end of the page."""
    html = F.col(html) if isinstance(html, str) else html
    seen = F.regexp_replace(html, UNSEEN, " ")
    before = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""
    wanted = "".join(rf"""(?={before}\s{name}\s*=\s*["']?(?:[^"'>]*\s)?{value}(?=["'\s>]))""" for name, value in (attributes or {}).items())
    own = F.regexp_extract(seen, rf"(?is)<{tag}\b{wanted}.*", 0)
    bare = F.regexp_replace(own, rf"(?s)<(/?[A-Za-z][A-Za-z0-9:-]*+){BODY}*+>", "<$1>")
    parts = F.split(bare, rf"(?i)(?=</?{tag}>)")
    return F.when(own != "", plain_text(_first_element(parts, tag)))


def _first_element(parts: Column, tag: str) -> Column:
    """Of a page cut at the tags of one name, the pieces of the first element: up to the one that closes it."""
    def step(acc: Column, part: Column) -> Column:
        more = F.when(part.rlike(f"(?i)^</{tag}>"), -1).when(part.rlike(f"(?i)^<{tag}>"), 1).otherwise(0)
        depth = acc["depth"] + more
        # pieces before the first opening do not count; the element ends where the sum is zero again
        open_ = acc["end"] < 0
        end = F.when(open_ & (more == -1) & (depth == 0), acc["at"]).otherwise(acc["end"])
        return F.struct(depth.cast("int").alias("depth"), (acc["at"] + 1).cast("int").alias("at"), end.cast("int").alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    # the array is bound to a lambda variable: cut once, however often it is used
    return F.element_at(F.transform(F.array(parts), lambda p: F.element_at(F.transform(
        F.array(F.aggregate(p, start, step)["end"]), lambda end: F.array_join(F.when(end < 0, p).otherwise(F.slice(p, F.lit(1), end)), "")), 1)), 1)
