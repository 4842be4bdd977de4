"""Scalar expressions over text, cells, spans and boxes; all stay inside the JVM.

Java's classes are ASCII unless (?U) asks for Unicode, and its dot stops at more
line ends than \n unless (?d) says so; every pattern here carries both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import patterns as P

UNICODE = "(?U)(?d)"


def java(pattern: str, ignore_case: bool = False) -> str:
    return UNICODE + ("(?i)(?u)" if ignore_case else "") + pattern


def strip(x: Column) -> Column:
    """x without Unicode white space at its ends."""
    return F.regexp_replace(x, java(r"^\s+|\s+\z"), "")


def is_blank(x: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(strip(x), F.lit("")) == ""


def normalize_cell(x: Column) -> Column:
    """One space for each run of white space, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(x, java(r"\s+"), " "))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 in lower-cased text; an accented letter separates. Null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(P.TOKEN), F.lit(1))


def is_bold(font: Column, flags: Column) -> Column:
    return font.contains("Bold") | (flags.bitwiseAND(16) != 0)


def is_parenthetical(x: Column) -> Column:
    return x.rlike(java(P.PARENTHETICAL))


def is_footer(text: Column, y1: Column, height: Column) -> Column:
    """A page number line within the footer band."""
    return (height - y1).between(0, P.FOOTER_BAND) & text.rlike(java(P.FOOTER, ignore_case=True))


def heading_shape(x: Column) -> Column:
    """(clause_no, clause_title) if the row looks numbered, else null.

    `4.1 Title` always does; `4.1. Title` only with a short title.
    """

    def matched(pattern: str) -> tuple[Column, Column]:
        return F.regexp_extract(x, java(pattern), 1), F.regexp_extract(x, java(pattern), 2)

    no, title = matched(P.NUMBERED)
    period_no, period_title = matched(P.NUMBERED_PERIOD)
    words = F.size(F.split(strip(period_title), java(r"\s+")))
    made = lambda n, t: F.struct(n.alias("clause_no"), strip(t).alias("clause_title"))
    return F.when(no != "", made(no, title)).when((period_no != "") & (words <= P.PERIOD_TITLE_WORDS), made(period_no, period_title))


def top_level(clause_no: Column) -> Column:
    """The first number of a dotted clause number."""
    return F.element_at(F.split(clause_no, r"\."), 1).cast("bigint")


def clause_tuple(clause_no: Column) -> Column:
    """The numbers of a dotted clause number."""
    return F.transform(F.split(clause_no, r"\."), lambda x: x.cast("bigint"))


def clause_depth(clause_no: Column) -> Column:
    """How many numbers a dotted clause number has."""
    return F.size(clause_tuple(clause_no))


def nests_under(item: Column, heading: Column) -> Column:
    return (item == heading) | item.startswith(F.concat(heading, F.lit(".")))


def bounded_field(text: Column, label: str, labels: tuple[str, ...]) -> Column:
    """What follows label, up to the next other label; null without the label. Case doesn't matter."""
    at = F.instr(F.upper(text), label.upper())
    rest = F.regexp_replace(text.substr(at + len(label), F.length(text)), java(r"^\s*:?\s*"), "")
    ends = [F.instr(F.upper(rest), other.upper()) for other in labels if other != label]
    end = F.least(*(F.when(e > 0, e - 1) for e in ends), F.length(rest))
    return F.when(at > 0, strip(rest.substr(F.lit(1), end)))


def centre_in(box: Column, region: Column) -> Column:
    """The centre of box lies in region, edges included."""
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return x.between(region[0], region[2]) & y.between(region[1], region[3])


def union_box(boxes: Column) -> Column:
    """The smallest box around all boxes of an array."""
    pick = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    return F.array(pick(0, F.array_min), pick(1, F.array_min), pick(2, F.array_max), pick(3, F.array_max))
