"""Heading inference from direct formatting.

runs: doc_id, p_idx, r_idx, text, bold, size (points, null if not given), ppr_bold, ppr_size, style_class
(null if the paragraph has no style).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import is_blank

MAX_CHARS, GAP, LEVELS, PREVIEW = 100, 0.4, 9, 60


def paragraphs(runs: DataFrame) -> DataFrame:
    """One row for each paragraph: text, effective bold and size; one shuffle on (doc_id, p_idx).

    Bold: every run with text is bold or in a bold paragraph, and there is one; or the paragraph is.
    Size: the mean of the sizes that runs with text give, else the paragraph's.
    """
    has_text = F.col("text") != ""
    g = runs.groupBy("doc_id", "p_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_idx", "text"))), lambda x: x.text), "").alias("text"),
        F.every(F.when(has_text, F.col("bold") | F.col("ppr_bold"))).alias("_bold"),
        F.bool_or("ppr_bold").alias("_ppr"),
        F.avg(F.when(has_text, F.col("size"))).alias("_size"),
        F.max("ppr_size").alias("_ppr_size"),
        F.max("style_class").alias("style_class"),
    )
    return g.select("doc_id", "p_idx", "text", (F.coalesce("_bold", F.lit(False)) | F.col("_ppr")).alias("bold"), F.coalesce("_size", "_ppr_size").alias("size"), "style_class")


def all_bold(runs: DataFrame) -> DataFrame:
    """Paragraphs with runs, all of them bold; runs without text count."""
    g = runs.groupBy("doc_id", "p_idx").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("bold").alias("n_bold"))
    return g.where("n_runs = n_bold").select("doc_id", "p_idx", "n_runs")


def body_class(paras: DataFrame) -> DataFrame:
    """Paragraphs that aren't headings or titles already; no style is body."""
    c = F.col("style_class")
    return paras.where(c.isNull() | ~(c.startswith("heading") | (c == "title")))


def candidates(paras: DataFrame) -> DataFrame:
    """Bold paragraphs under 100 characters with something in them."""
    return paras.where(F.col("bold") & ~is_blank(F.col("text")) & (F.char_length("text") < MAX_CHARS))


def body_size(paras: DataFrame) -> DataFrame:
    """The commonest size of the paragraphs that are no candidates, the largest of equally common ones; 0 without any."""
    body = paras.where(~is_blank(F.col("text")) & ~(F.col("bold") & (F.char_length("text") < MAX_CHARS)) & F.col("size").isNotNull())
    counts = body.groupBy("doc_id", "size").count()
    return counts.groupBy("doc_id").agg(F.max_by("size", F.struct("count", "size")).alias("body_size"))


def infer_headings(paras: DataFrame) -> DataFrame:
    """``doc_id, p_idx, level, size, preview``.

    The thresholds of a document are its candidates' distinct sizes over body size + 0.4, largest first; a
    candidate's level is the first threshold that it reaches within 0.4, the last one if it reaches none
    (9 at most), and 1 where there is no threshold.
    """
    paras = body_class(paras)
    found = candidates(paras).withColumn("size", F.coalesce("size", F.lit(0.0)))
    per_doc = body_size(paras)
    sized = found.join(per_doc, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(0.0)))
    over = F.when((F.col("size") > 0) & ((F.col("body_size") == 0) | (F.col("size") > F.col("body_size") + GAP)), F.col("size"))
    all_ = F.array_sort(F.collect_set(over).over(Window.partitionBy("doc_id")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    reached = F.filter(F.transform(F.col("_t"), lambda t, i: F.when(F.col("size") >= t - GAP, i + 1)), lambda i: i.isNotNull())
    level = F.when(F.size("_t") == 0, 1).otherwise(F.least(F.coalesce(F.get(reached, F.lit(0)), F.size("_t")), F.lit(LEVELS)))
    return sized.withColumn("_t", all_).select("doc_id", "p_idx", level.cast("int").alias("level"), "size", F.substring("text", 1, PREVIEW).alias("preview"))


def apply_headings(paras: DataFrame, headings: DataFrame, style_of: DataFrame) -> DataFrame:
    """New style ids: an inferred paragraph that has one gets that of its level; others stay.

    paras: doc_id, p_idx, style_id; headings: doc_id, p_idx, level; style_of: level, new_id (a few rows).
    """
    j = paras.join(headings.select("doc_id", "p_idx", "level"), ["doc_id", "p_idx"], "left").join(style_of, "level", "left")
    new = F.when(F.col("style_id").isNotNull(), F.coalesce("new_id", "style_id"))
    return j.select("doc_id", "p_idx", new.alias("style_id"), F.coalesce(F.col("style_id").isNotNull() & F.col("new_id").isNotNull(), F.lit(False)).alias("rewritten"))
