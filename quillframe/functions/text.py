"""Text, path and unit functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java's regular expressions: trim() alone strips only spaces.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return trim_all(c) == ""


def escape_xml(c: Column) -> Column:
    """& first, then the angle brackets; quotes stay."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_xml(c: Column) -> Column:
    """The five named entities, & last, so that &amp;lt; becomes &lt;."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def needs_preserve(c: Column) -> Column:
    """Whether a text element must say xml:space="preserve": ASCII white space at either end."""
    return c.rlike(r"^[ \t\n\r\f]|[ \t\n\r\f]\z")


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def base_of_rels(rels: Column) -> Column:
    """word/_rels/document.xml.rels describes word/document.xml: its targets start from word/."""
    return F.regexp_replace(rels, r"_rels/[^/]*$", "")


def resolve_path(base: Column, target: Column) -> Column:
    """A relationship target as a part name; a leading slash makes it absolute, verbatim but for the slash."""
    joined = F.split(F.concat(base, F.lit("/"), target), "/")
    kept = F.aggregate(
        joined,
        F.expr("cast(array() as array<string>)"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((s == "") | (s == "."), done).otherwise(F.concat(done, F.array(s))),
    )
    return F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.array_join(kept, "/"))


def twips_to_points(c: Column) -> Column:
    """Twentieths of a point, two decimals, halves away from zero; null for what isn't a number."""
    return F.round(F.expr("1") * F.try_divide(c.try_cast("double"), F.lit(20.0)), 2)


def half_points(c: Column) -> Column:
    return c.try_cast("double") / 2


def count_of(c: Column, needle: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def markers(c: Column) -> Column:
    """All [digits] of a text, the digits only, from left to right."""
    return F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), F.lit(1))


def shortened(c: Column, n: int = 400) -> Column:
    """At most n characters, with an ellipsis where something is cut off."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
