"""Footnote markers in text, and what a note starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import is_blank, markers

_PIECE = r"(\[[0-9]+\]|[^\[]+|\[)"


def find_markers(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, p_idx, r_idx, seq, note_id): the markers [N] of a run whose N is a note, from left to right.

    notes: doc_id, note_id. Numbers beyond 32 bits without sign are no notes.
    """
    found = runs.select("doc_id", "p_idx", "r_idx", F.posexplode(markers(F.col("text"))).alias("seq", "digits")).withColumn("note_id", F.col("digits").try_cast("bigint"))
    return found.where("note_id <= 4294967295").join(notes.select("doc_id", "note_id").distinct(), ["doc_id", "note_id"], "left_semi").select("doc_id", "p_idx", "r_idx", "seq", "note_id")


def reconcile(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, note_id, status): cited notes that there are, ``unknown`` ones cited without being there, ``unused`` ones not cited."""
    cited = runs.select("doc_id", F.explode(markers(F.col("text"))).alias("d")).select("doc_id", F.col("d").try_cast("bigint").alias("note_id")).distinct()
    both = cited.withColumn("_c", F.lit(True)).join(notes.select("doc_id", "note_id").distinct().withColumn("_n", F.lit(True)), ["doc_id", "note_id"], "full_outer")
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_c").isNull(), "unused").otherwise("cited")
    return both.select("doc_id", "note_id", status.alias("status"))


def dangling(references: DataFrame, notes: DataFrame) -> DataFrame:
    """The rows of references (doc_id, note_id and more) whose note isn't there; null ids are references to nothing."""
    return references.join(notes.select("doc_id", "note_id").distinct(), ["doc_id", "note_id"], "left_anti")


def split_at_markers(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each run as pieces (doc_id, p_idx, r_idx, seq, text, note_id): text between markers, and references; all that a run has else stays with it.

    A marker of an unknown note stays text, joined with its neighbours. A marker goes as a whole, leading zeros too.
    """
    pieces = runs.select("doc_id", "p_idx", "r_idx", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(1))).alias("k", "piece"))
    pieces = pieces.withColumn("note_id", F.regexp_extract("piece", r"^\[([0-9]+)\]$", 1).try_cast("bigint"))
    known = notes.select("doc_id", "note_id", F.lit(True).alias("_known")).distinct()
    j = pieces.join(known, ["doc_id", "note_id"], "left").withColumn("note_id", F.when(F.col("_known"), F.col("note_id")))
    w = Window.partitionBy("doc_id", "p_idx", "r_idx").orderBy("k")
    ref, before = F.col("note_id").isNotNull(), F.lag("note_id").over(w).isNotNull()
    starts = F.when(ref | before | (F.row_number().over(w) == 1), 1).otherwise(0)
    j = j.withColumn("_starts", starts).withColumn("seq", F.sum("_starts").over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x.piece), "")
    return j.groupBy("doc_id", "p_idx", "r_idx", "seq").agg(F.when(F.max("note_id").isNull(), text).alias("text"), F.max("note_id").alias("note_id"))


def injection_order(pieces: DataFrame) -> DataFrame:
    """(doc_id, note_id, n): the notes in the order of their first reference, with the number of references."""
    first = F.min(F.struct("p_idx", "r_idx", "seq"))
    g = pieces.where("note_id is not null").groupBy("doc_id", "note_id").agg(first.alias("_at"), F.count(F.lit(1)).alias("n_refs"))
    return g.select("doc_id", "note_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")).alias("n"), "n_refs")


def footnote_format(runs: DataFrame, sample: int = 3) -> DataFrame:
    """Marker format and separator of each document, from its first ``sample`` notes with an id over 0.

    runs of first paragraphs: doc_id, note_id, r_idx, is_marker, has_tab, text, format. The format is that
    of the first note whose marker has one. The separator comes from the run behind the first marker: a tab, or its text where
    that is blank; text that isn't blank is the note itself, so that the separator is empty.
    """
    ids = runs.where("note_id > 0").select("doc_id", "note_id").distinct()
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("note_id"))).where(F.col("_n") <= sample)
    w = Window.partitionBy("doc_id", "note_id").orderBy("r_idx")
    after = F.lead(F.struct("has_tab", "text")).over(w)
    rows = runs.join(ids, ["doc_id", "note_id"]).withColumn("_next", after).where("is_marker").withColumn("_m", F.row_number().over(w)).where("_m = 1")
    sep = F.when(F.col("_next").isNull(), F.lit(None)).when(F.col("_next.has_tab"), F.lit("\t")).when(is_blank(F.col("_next.text")), F.col("_next.text")).otherwise(F.lit(""))
    rows = rows.withColumn("_sep", sep)
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("note_id")))
    return rows.groupBy("doc_id").agg(at("format").alias("marker_format"), F.coalesce(at("_sep"), F.lit("")).alias("separator"))


def normalize_separators(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of the run behind each note's marker: keep, replace, strip, or insert one before it.

    runs: as for ``footnote_format``; wanted: doc_id, separator (null: leave all). Notes with id 0 and below stay.
    """
    w = Window.partitionBy("doc_id", "note_id").orderBy("r_idx")
    rows = runs.where("note_id > 0").withColumn("_next", F.lead(F.struct("has_tab", "text")).over(w)).where("is_marker").withColumn("_m", F.row_number().over(w)).where("_m = 1")
    j = rows.join(wanted, "doc_id")
    sep, tab, text = F.col("separator"), F.col("_next.has_tab"), F.col("_next.text")
    is_sep = F.col("_next").isNotNull() & (tab | is_blank(text))
    same = (tab & (sep == "\t")) | (~tab & (text == sep))
    act = F.when(sep.isNull(), "keep").when(~is_sep, F.when(sep != "", "insert").otherwise("keep")).when(sep == "", "strip").when(same, "keep").otherwise("replace")
    return j.select("doc_id", "note_id", "r_idx", act.alias("action"))
