"""Style tables and the mapper from source styles to those of a blueprint.

styles: doc_id, ord, name, style_id, type_val (1 paragraph, 2 character, 3 table, 4 numbering),
outline_level (null if none). body_styles: doc_id, style_id used by paragraphs of the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.styles import classify_style

#: Where to look for a heading of a level that the blueprint lacks.
DELTAS = (0, 1, -1, 2, -2, 3, -3)


def style_index(styles: DataFrame) -> DataFrame:
    """One row for each (doc_id, name): of several the last; without a name the id is the name."""
    last = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(F.desc("ord")))
    return styles.withColumn("name", F.coalesce("name", "style_id")).withColumn("_n", last).where("_n = 1").drop("_n")


def body_styles(paras: DataFrame) -> DataFrame:
    return paras.where("style_id is not null").select("doc_id", "style_id").distinct()


def classified(index: DataFrame) -> DataFrame:
    """index with the class of each name as the struct ``c``, if it hasn't that yet."""
    return index if "c" in index.columns else index.withColumn("c", classify_style("name"))


def heading_slots(index: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, level, name): the blueprint's style for each heading level.

    First the outline levels, then the classified names. In each pass names come in byte order; an empty
    slot is taken, and a name that is used in the body takes the slot from any before it.
    """
    para = classified(index.where("type_val = 1"))
    by_outline = para.where("outline_level between 0 and 8").select("doc_id", "name", (F.col("outline_level") + 1).alias("level"), F.lit(0).alias("pass"))
    by_name = para.where("c.class like 'heading%'").select("doc_id", "name", F.col("c.heading_level").alias("level"), F.lit(1).alias("pass"))
    marks = used.select("doc_id", F.col("style_id").alias("name"), F.lit(True).alias("_used")).distinct()
    rows = by_outline.unionByName(by_name).join(marks, ["doc_id", "name"], "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    last_used = F.max(F.when(F.col("_used"), F.struct("pass", "name")))["name"]
    return rows.groupBy("doc_id", "level").agg(F.coalesce(last_used, F.min(F.struct("pass", "name"))["name"]).alias("name"))


def nearest_level(wanted: DataFrame, slots: DataFrame) -> DataFrame:
    """wanted: doc_id, level. The slot of the level, else those of DELTAS in turn, else the lowest; null without slots.

    slots has at most nine rows for a document, so that they fit in one array.
    """
    held = slots.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("int"), "name"))).alias("_slots"))
    j = wanted.join(held, "doc_id", "left")
    near = [F.try_element_at("_slots", (F.col("level") + d).cast("int")) for d in DELTAS]
    return j.withColumn("name", F.coalesce(*near, F.try_element_at("_slots", F.array_min(F.map_keys("_slots"))))).drop("_slots")


def ci_match(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted: doc_id, name. The first blueprint name in byte order that is equal but for case, or null."""
    low = index.groupBy("doc_id", F.lower("name").alias("_low")).agg(F.min("name").alias("match"))
    return wanted.withColumn("_low", F.lower("name")).join(low, ["doc_id", "_low"], "left").drop("_low")


def _first(label: str) -> Column:
    return F.min(F.when(F.col("c.class") == label, F.col("name"))).alias(label)


def resolve(wanted: DataFrame, index: DataFrame, used: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """wanted: doc_id, name, class, heading_level, to those columns and ``mapped``.

    In turn: a user override that the blueprint has; for headings the slot (``nearest_level``); the same
    name; the same but for case; the first name of the class (titles: else heading 1); the body style: the
    first by class, else Normal, else the first paragraph style, else the word Normal. Each distinct name
    is resolved once.
    """
    keys = wanted.select("doc_id", "name", "class", "heading_level").distinct()
    para = classified(index.where("type_val = 1"))
    labels = ("title", "body", "footnote", "caption", "blockquote", "abstract")
    per_doc = para.groupBy("doc_id").agg(*(_first(k) for k in labels), F.min("name").alias("_any"))
    normal = index.where("name = 'Normal'").select("doc_id", F.lit("Normal").alias("_normal")).distinct()
    slots = heading_slots(index, used)
    one = slots.where("level = 1").select("doc_id", F.col("name").alias("_h1"))
    j = nearest_level(keys.withColumnRenamed("name", "src").withColumn("level", F.col("heading_level")), slots).withColumnRenamed("name", "_slot").withColumnRenamed("src", "name")
    j = ci_match(j, index).withColumnRenamed("match", "_ci")
    names = index.select("doc_id", "name", F.lit(True).alias("_same")).distinct()
    j = j.join(names, ["doc_id", "name"], "left").join(per_doc, "doc_id", "left").join(normal, "doc_id", "left").join(one, "doc_id", "left")
    steps = []
    if overrides is not None:
        o = overrides.select("doc_id", F.col("source").alias("name"), F.col("target").alias("_target")).join(names.select("doc_id", F.col("name").alias("_target")), ["doc_id", "_target"], "left_semi")
        j = j.join(o, ["doc_id", "name"], "left")
        steps = [F.col("_target")]
    by_class = F.when(F.col("class") == "title", F.coalesce("title", "_h1"))
    for k in ("footnote", "caption", "blockquote", "abstract"):
        by_class = by_class.when(F.col("class") == k, F.col(k))
    steps += [F.when(F.col("class").startswith("heading") & (F.col("heading_level") > 0), F.col("_slot")), F.when(F.col("_same"), F.col("name")), F.col("_ci"), by_class, F.coalesce("body", "_normal", "_any", F.lit("Normal"))]
    return wanted.join(j.select("doc_id", "name", "class", "heading_level", F.coalesce(*steps).alias("mapped")), ["doc_id", "name", "class", "heading_level"], "left")


def remap(paras: DataFrame, source: DataFrame, mapping: DataFrame, blueprint: DataFrame) -> DataFrame:
    """Style ids of paragraphs by way of names: id, source name, mapped name, blueprint id; each hop keeps what it can't look up.

    paras: doc_id, p_idx, style_id. source, blueprint: doc_id, name, style_id. mapping: doc_id, name, mapped.
    """
    src = source.groupBy("doc_id", "style_id").agg(F.min("name").alias("_name"))
    j = paras.join(src, ["doc_id", "style_id"], "left").withColumn("name", F.coalesce("_name", "style_id"))
    j = j.join(mapping.select("doc_id", "name", "mapped"), ["doc_id", "name"], "left").withColumn("_to", F.coalesce("mapped", "name"))
    bp = blueprint.groupBy("doc_id", F.col("name").alias("_to")).agg(F.min("style_id").alias("_id"))
    j = j.join(bp, ["doc_id", "_to"], "left").withColumn("new_id", F.coalesce("_id", "_to"))
    return j.select("doc_id", "p_idx", "style_id", "new_id", (F.col("style_id") != F.col("new_id")).alias("rewritten"))
