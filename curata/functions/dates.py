"""Dates out of free text (survey I5, I6).

Publication dates arrive as ``2019``, ``2019.0``, ``June 2015``, ``Mar-Apr 2017``,
``15 Nov. 2019``, ``30 Sep-2 Oct. 2012``, ``Thirdquarter 2011`` or ISO.  One list of *shapes* says
how such texts look and which of their parts are the day, the month and the year; the first
shape that fits decides.  A range of days or months gives its last day, or the first day
of the month named in ``SHAPES``; a text that no shape fits, or a date that the
calendar lacks, gives NULL (the row is kept).

In Spark a shape is one anchored pattern test and, where it holds, one extraction for each part,
on a text that was normalised once: plain expressions, no Python."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names; a text may use any spelling that starts with the first three letters.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FULL_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
# Texts that stand for an unknown date, and the date they are given.
PLACEHOLDERS = ["0", "10000-01-01"]
PLACEHOLDER_DATE = "2000-01-01"
# Quarters end with these months.
QUARTERS = {"first": 3, "second": 6, "third": 9, "fourth": 12}

_MONTH = r"((?:" + "|".join(m.lower() for m in MONTHS) + r")[a-z]*)\.?"
_ANY_MONTH = _MONTH.replace("((", "(?:(", 1)
_YEAR = r"(\d{4})"
_DAY = r"(\d{1,2})"


@dataclass(frozen=True)
class Shape:
    """``pattern`` fits the whole normalised text; the numbers name its groups (0: the first of the month / of January)."""
    name: str
    pattern: str
    year: int
    month: int = 0
    day: int = 0


# Normalised texts are lower case, without brackets and labels, with single spaces.
SHAPES = [
    Shape("year", rf"{_YEAR}(?:\.0)?", 1),
    Shape("iso day", rf"{_YEAR}[-/](\d{{1,2}})[-/]{_DAY}(?:[t ].*)?", 1, 2, 3),
    Shape("iso month", rf"{_YEAR}[-/](\d{{1,2}})", 1, 2),
    Shape("month year", rf"{_MONTH}[ -/]+{_YEAR}", 2, 1),
    Shape("months year: the first", rf"{_MONTH} ?[-/] ?{_ANY_MONTH} {_YEAR}", 2, 1),
    Shape("month day, year", rf"{_MONTH} {_DAY}(?:st|nd|rd|th)?, ?{_YEAR}", 3, 1, 2),
    Shape("month days, year: the last", rf"{_MONTH} \d{{1,2}} ?- ?{_DAY}, ?{_YEAR}", 3, 1, 2),
    Shape("day month year", rf"{_DAY}(?:st|nd|rd|th)?[ /-]{_MONTH}[ ,/-]+{_YEAR}", 3, 2, 1),
    Shape("day month, with digits behind the month", rf"{_DAY} {_MONTH}\d+,? {_YEAR}", 3, 2, 1),
    Shape("days month year: the last", rf"\d{{1,2}} ?- ?{_DAY} {_MONTH},? {_YEAR}", 3, 2, 1),
    Shape("day month - day month year: the last", rf"\d{{1,2}} {_ANY_MONTH} ?- ?{_DAY} {_MONTH},? {_YEAR}", 3, 2, 1),
    Shape("day month - month year: the second month", rf"\d{{1,2}} {_ANY_MONTH} ?- ?{_MONTH},? {_YEAR}", 2, 1),
    Shape("quarter year: its last month", rf"(?:\d+/)?({'|'.join(QUARTERS)}) ?quarter[ /]{_YEAR}", 2, 1),
]


def normalised(text: Column) -> Column:
    """Lower case, without brackets and issue labels, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[\[\]]|issued(?: on)?:?", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def month_number(name: Column) -> Column:
    """1..12 of a month's name or number, or of a quarter's last month."""
    by_name = F.floor((F.instr(F.lit("".join(MONTHS).lower()), F.substring(name, 1, 3)) + 2) / 3)
    out = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    for quarter, month in QUARTERS.items():
        out = out.when(name == quarter, month)
    return out.otherwise(by_name).cast("int")


def shape_date(text: Column, years: tuple[int, int] | None = None) -> Column:
    """The DATE of a normalised text."""
    def part(shape: Shape, group: int) -> Column:
        return F.regexp_extract(text, f"^{shape.pattern}$", group) if group else F.lit("1")

    out = F.when(text.isin(PLACEHOLDERS), F.lit(PLACEHOLDER_DATE).cast("date"))
    for shape in SHAPES:
        year = part(shape, shape.year)
        date = F.try_to_date(F.concat_ws("-", year, month_number(part(shape, shape.month)).cast("string"), part(shape, shape.day)), "y-M-d")
        if years is not None and shape.name == "year":
            date = F.when(year.cast("int").between(*years), date).otherwise(F.lit(PLACEHOLDER_DATE).cast("date"))
        out = out.when(text.rlike(f"^{shape.pattern}$"), date)
    return out


def parse_dates(df: DataFrame, col: str, out: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Parse the date text in ``col`` into DATE column ``out``.  With
    ``years`` a bare year outside of it becomes the placeholder date; by default every year stays."""
    tmp = "__date_norm"
    return (df.withColumn(tmp, normalised(F.col(col).cast("string")))
            .withColumn(out or col, shape_date(F.col(tmp), years)).drop(tmp))
