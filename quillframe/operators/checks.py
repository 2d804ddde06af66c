"""The validator's checks as findings: doc_id, check_no, severity (ok, issue), seq, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import base_of_rels, resolve_path

BODY_TAGS = tuple("w:" + x for x in "p tbl sectPr bookmarkStart bookmarkEnd".split())
RSID_SAMPLE, DUPLICATES, TARGETS = 4, 3, 5


def _finding(check_no: int, severity: Column | str, seq: Column | int, message: Column) -> list[Column]:
    s = F.lit(severity) if isinstance(severity, str) else severity
    q = F.lit(seq) if isinstance(seq, int) else seq
    return ["doc_id", F.lit(check_no).alias("check_no"), s.alias("severity"), q.cast("int").alias("seq"), message.alias("message")]


def undeclared(used: DataFrame, declared: DataFrame, sample: int = RSID_SAMPLE) -> DataFrame:
    """(doc_id, value) used but not declared: per document n_used, n_missing and a sample in byte order."""
    used, declared = used.select("doc_id", "value").distinct(), declared.select("doc_id", "value", F.lit(True).alias("_there")).distinct()
    j = used.join(declared, ["doc_id", "value"], "left")
    first = F.row_number().over(Window.partitionBy("doc_id", F.col("_there").isNull()).orderBy("value"))
    j = j.withColumn("_n", first)
    missing = F.col("_there").isNull()
    shown = F.array_join(F.array_sort(F.collect_list(F.when(missing & (F.col("_n") <= sample), F.col("value")))), ", ")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_used"), F.count_if(missing).alias("n_missing"), shown.alias("sample"))


def check_rsids(used: DataFrame, declared: DataFrame) -> DataFrame:
    u = undeclared(used, declared)
    bad = F.col("n_missing") > 0
    text = F.when(bad, F.format_string("%d revision ids of paragraphs aren't in the settings: %s", "n_missing", "sample")).otherwise(F.format_string("%d revision ids, all in the settings", "n_used"))
    return u.select(*_finding(2, F.when(bad, "issue").otherwise("ok"), 0, text))


def duplicates(ids: DataFrame, top: int = DUPLICATES) -> DataFrame:
    """ids: doc_id, id, part. Ids that occur more than once: the first ``top`` in byte order, with their parts."""
    g = ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("part")), ", ").alias("parts")).where("n > 1")
    return g.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1).where(F.col("seq") < top)


def _unique(ids: DataFrame, check_no: int, what: str) -> DataFrame:
    found = duplicates(ids)
    bad = found.select(*_finding(check_no, "issue", F.col("seq"), F.format_string(f"{what} %s occurs %d times", "id", "n")))
    fine = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return bad.unionByName(fine.select(*_finding(check_no, "ok", 0, F.format_string(f"%d of {what}, no two alike", "n"))))


def check_para_ids(ids: DataFrame) -> DataFrame:
    return _unique(ids, 3, "paragraph id")


def check_bookmark_ids(ids: DataFrame) -> DataFrame:
    return _unique(ids, 6, "bookmark id")


def missing_targets(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """rels: doc_id, rels_part, target, target_mode. Internal targets that are no part, with the name they resolve to."""
    inner = rels.where(F.coalesce("target_mode", F.lit("")) != "External").withColumn("part_name", resolve_path(base_of_rels(F.col("rels_part")), F.col("target")))
    return inner.join(parts.select("doc_id", "part_name"), ["doc_id", "part_name"], "left_anti")


def check_rel_targets(rels: DataFrame, parts: DataFrame) -> DataFrame:
    gone = missing_targets(rels, parts).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("rels_part", "target")) - 1)
    bad = gone.where(F.col("seq") < TARGETS).select(*_finding(4, "issue", F.col("seq"), F.format_string("%s points to %s (%s), which isn't there", "rels_part", "target", "part_name")))
    fine = parts.select("doc_id").distinct().join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    return bad.unionByName(fine.select(*_finding(4, "ok", 0, F.lit("All relationship targets are there"))))


def check_body_structure(children: DataFrame) -> DataFrame:
    """children: doc_id, ord, tag of the body's direct children. Unknown tags first, else a section that isn't last; nothing for an empty body."""
    g = children.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("tag").isin(*BODY_TAGS), F.col("tag")))), ", ").alias("bad"),
        F.max_by("tag", "ord").alias("last"),
        F.bool_or(F.col("tag") == "w:sectPr").alias("section"),
        F.count(F.lit(1)).alias("n"),
    )
    bad, moved = F.col("bad") != "", F.col("section") & (F.col("last") != "w:sectPr")
    text = F.when(bad, F.concat(F.lit("Tags that don't belong in the body: "), F.col("bad"))).when(moved, F.lit("The section properties of the body aren't its last child")).otherwise(F.format_string("%d children of the body", "n"))
    return g.select(*_finding(5, F.when(bad | moved, "issue").otherwise("ok"), 0, text))


def check_inline_rids(used: DataFrame, declared: DataFrame) -> DataFrame:
    """used, declared: doc_id, value. Nothing for a document without references."""
    u = undeclared(used, declared, 1 << 30)
    bad = F.col("n_missing") > 0
    text = F.when(bad, F.concat(F.lit("References without a relationship: "), F.col("sample"))).otherwise(F.format_string("%d references, all with a relationship", "n_used"))
    return u.select(*_finding(7, F.when(bad, "issue").otherwise("ok"), 0, text))


def check_xml(verdicts: DataFrame) -> DataFrame:
    """verdicts: doc_id, part_name, error (null if it parses)."""
    n = verdicts.groupBy("doc_id").agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.count(F.lit(1)).alias("n"))
    fine = n.where("bad = 0").select(*_finding(1, "ok", 0, F.format_string("%d parts parse", "n")))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_name")) - 1
    return fine.unionByName(verdicts.where("error is not null").select(*_finding(1, "issue", seq, F.format_string("%s doesn't parse: %s", "part_name", "error"))))


def next_rid(rels: DataFrame) -> DataFrame:
    """rels: doc_id, id. One more than the largest number behind rId; other ids count as 0."""
    n = F.regexp_extract("id", r"^rId([0-9]+)", 1).try_cast("bigint")
    return rels.groupBy("doc_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_id"))
