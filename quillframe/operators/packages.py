"""A package is rows (doc_id, part_ord, part_name, data); order is a column, never the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTENT_TYPES, DOCUMENT, RELS = "[Content_Types].xml", "word/document.xml", "word/_rels/document.xml.rels"
FOOTNOTES, ENDNOTES, SETTINGS, STYLES = (f"word/{x}.xml" for x in "footnotes endnotes settings styles".split())


def valid_packages(parts: DataFrame) -> DataFrame:
    """Parts of packages that hold the content types; one shuffle, partial sums first."""
    ok = F.bool_or(F.col("part_name") == CONTENT_TYPES)
    return parts.join(parts.groupBy("doc_id").agg(ok.alias("_ok")).where("_ok").select("doc_id"), "doc_id", "left_semi")


def lookup(parts: DataFrame, name: str) -> DataFrame:
    """The first part of this name in each package; the filter reaches the scan."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_ord"))
    return parts.where(F.col("part_name") == name).withColumn("_n", first).where("_n = 1").drop("_n")


def upsert(parts: DataFrame, new: DataFrame) -> DataFrame:
    """Replace data where (doc_id, part_name) exists, else append after the last part, new ones by name.

    new: doc_id, part_name, data, without repeats.
    """
    ends = parts.groupBy("doc_id").agg(F.max("part_ord").alias("_last"))
    joined = parts.alias("p").join(new.withColumn("_new", F.lit(True)).alias("n"), ["doc_id", "part_name"], "full_outer")
    joined = joined.select("doc_id", "part_name", F.col("p.part_ord").alias("part_ord"), F.when(F.col("_new"), F.col("n.data")).otherwise(F.col("p.data")).alias("data"))
    added = F.row_number().over(Window.partitionBy("doc_id", F.col("part_ord").isNull()).orderBy("part_name"))
    ord_ = F.coalesce("part_ord", F.coalesce("_last", F.lit(-1)) + added)
    return joined.join(ends, "doc_id", "left").withColumn("part_ord", ord_.cast("int")).select("doc_id", "part_ord", "part_name", "data")


def rename(parts: DataFrame, old: str, new: str) -> DataFrame:
    """The part keeps its place."""
    return parts.withColumn("part_name", F.when(F.col("part_name") == old, F.lit(new)).otherwise(F.col("part_name")))


def remove(parts: DataFrame, name: str) -> DataFrame:
    return parts.where(F.col("part_name") != name)


def by_name(parts: DataFrame) -> DataFrame:
    """One row for each name of a package: of several parts of a name the last counts, as in a map by name."""
    return parts.groupBy("doc_id", "part_name").agg(F.max_by("data", "part_ord").alias("data"))


def inspect(parts: DataFrame) -> DataFrame:
    """Name and size of every part, and how many the package has."""
    return parts.select("doc_id", "part_ord", "part_name", F.octet_length("data").alias("n_bytes"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n_parts"))


def xml_parts(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part_name").endswith(".xml") | F.col("part_name").endswith(".rels"))


def carry_part(target: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """Copy a part from each source package to the target of the same doc_id, where the source has it."""
    return upsert(target, lookup(source, name).select("doc_id", "part_name", "data").join(target.select("doc_id").distinct(), "doc_id", "left_semi"))


def json_notes(rows: DataFrame, column: str) -> DataFrame:
    """A JSON object {"1": "text"} to rows (doc_id, note_id, body); note_id is null where the key is no number."""
    notes = F.from_json(F.col(column), "map<string,string>")
    return rows.select("doc_id", F.explode(notes).alias("key", "body")).select("doc_id", "key", F.col("key").try_cast("bigint").alias("note_id"), "body")


def convert_notes_kind(parts: DataFrame, to_endnotes: bool = True) -> DataFrame:
    """Footnotes to endnotes or back: nothing happens without the one or with the other already there.

    data as text or bytes. The notes part and the document get the substitutions in this order, the part its
    new name in its old place, relationships and content types theirs. Other parts, images among them, stay
    where they are, byte for byte, and don't move; bytes that aren't UTF-8 stay too.
    """
    a, b = ("footnote", "endnote") if to_endnotes else ("endnote", "footnote")
    up = {"footnote": "Footnote", "endnote": "Endnote"}
    pairs = [(f"w:{a}s", f"w:{b}s"), (f"w:{a} ", f"w:{b} "), (f"w:{a}>", f"w:{b}>"), (f"w:{a}Ref", f"w:{b}Ref"), (f"w:{a}Reference", f"w:{b}Reference"), (f"{up[a]}Text", f"{up[b]}Text"), (f"{up[a]}Reference", f"{up[b]}Reference")]
    src, dst = f"word/{a}s.xml", f"word/{b}s.xml"
    kind, name = parts.schema["data"].dataType, F.col("part_name")
    concerned = F.coalesce(name.isin(src, dst, DOCUMENT, RELS, CONTENT_TYPES), F.lit(False))
    w = Window.partitionBy("doc_id")
    convert = F.bool_or(name == src).over(w) & ~F.bool_or(name == dst).over(w)

    def fold(pairs: list[tuple[str, str]]):
        c = F.col("data").cast("string")  # the bytes as they are
        for old, new in pairs:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c.cast(kind)

    rels = fold([(f"relationships/{a}s", f"relationships/{b}s"), (f'Target="{a}s.xml', f'Target="{b}s.xml')])
    types = fold([(f"wordprocessingml.{a}s+xml", f"wordprocessingml.{b}s+xml"), (f'/{src}"', f'/{dst}"')])
    data = F.when(~F.col("_c"), F.col("data")).when(name.isin(src, DOCUMENT), fold(pairs)).when(name == RELS, rels).when(name == CONTENT_TYPES, types).otherwise(F.col("data"))
    changed = parts.where(concerned).withColumn("_c", convert).select("doc_id", "part_ord", F.when(F.col("_c") & (name == src), F.lit(dst)).otherwise(name).alias("part_name"), data.alias("data"))
    return changed.unionByName(parts.where(~concerned).select("doc_id", "part_ord", "part_name", "data"))


TAG_FIXES = (("w:sz-cs", "w:szCs"), ("w:b-cs", "w:bCs"), ("w:i-cs", "w:iCs"))


def normalize_tags(parts: DataFrame, fixes=TAG_FIXES) -> DataFrame:
    """Replace misspelt tags; n_changed counts them, opening and closing tags each."""
    from quillframe.functions.text import count_of

    data, n = F.col("data"), F.lit(0)
    for old, new in fixes:
        n = n + count_of(F.col("data"), old)
        data = F.replace(data, F.lit(old), F.lit(new))
    return parts.withColumn("n_changed", n.cast("int")).withColumn("data", data)


TRACKING = (*(f"w14:{x}Id" for x in ("para", "text")), *(f"w:rsid{x}" for x in "R RPr Del RDefault P Tr Sect".split()))


def strip_attributes(parts: DataFrame, names=TRACKING) -> DataFrame:
    """Drop attributes of these names from every tag; n_removed counts them. Idempotent.

    An attribute is removed only inside a tag: text that looks like one stays. data as text.
    """
    one = r'\s+(?:' + "|".join(names) + r')\s*=\s*(?:"[^"]*"|\'[^\']*\')'
    tag = r"<[A-Za-z][^<>]*>"
    split = F.regexp_extract_all(F.col("data"), F.lit(f"({tag}|[^<]+|<)"), F.lit(1))
    is_tag = lambda t: t.rlike(f"^{tag}$")
    clean = F.array_join(F.transform(split, lambda t: F.when(is_tag(t), F.regexp_replace(t, one, "")).otherwise(t)), "")
    n = F.aggregate(split, F.lit(0), lambda s, t: s + F.when(is_tag(t), F.regexp_count(t, F.lit(one))).otherwise(0))
    return parts.withColumn("n_removed", n).withColumn("data", F.when(F.col("n_removed") > 0, clean).otherwise(F.col("data")))
