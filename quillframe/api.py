"""Path-in, path-out functions over one package or a folder of them.

Each reads packages with the docx source, applies one job of ``plans.documents`` and writes the results
under the same names to ``output``. Nothing is collected but what a function says that it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.styles import classify_style  # noqa: F401  part of the API
from quillframe.plans import documents as D
from quillframe.sources import docx


def read(spark: SparkSession, path: str, parts: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """doc_id, source, part_ord, part_name, data, error; unreadable packages are rows with an error."""
    docx.register(spark)
    reader = spark.read.format("docx").option("mode", mode)
    return (reader.option("parts", parts) if parts else reader).load(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).where("error is null").select("doc_id", "part_ord", "part_name", "data")


def _save(changed: DataFrame, output: str) -> int:
    """Write and return the total of n_changed, if there is such a column."""
    changed = changed.persist()
    try:
        docx.write_packages(changed, output)
        return changed.agg(F.coalesce(F.sum("n_changed"), F.lit(0))).collect()[0][0] if "n_changed" in changed.columns else 0
    finally:
        changed.unpersist()


def strip_rsids(spark: SparkSession, path: str, output: str, also_normalize_tags: bool = False) -> int:
    return _save(D.clean(_parts(spark, path), also_normalize_tags), output)


def normalize_tags(spark: SparkSession, path: str, output: str) -> int:
    return _save(D.normalize_tags(_parts(spark, path)), output)


def clean_runs(spark: SparkSession, path: str, output: str) -> int:
    return _save(D.clean_runs(_parts(spark, path)), output)


def strip_paragraph_bold(spark: SparkSession, path: str, output: str) -> int:
    return _save(D.strip_paragraph_bold(_parts(spark, path)), output)


def convert_notes_kind(spark: SparkSession, path: str, output: str, kind: str = "endnotes") -> None:
    if kind not in ("endnotes", "footnotes"):
        raise ValueError("kind is endnotes or footnotes")
    _save(D.convert_notes_kind(_parts(spark, path), kind == "endnotes"), output)


def inject_footnotes(spark: SparkSession, path: str, output: str, notes: dict[str, str], overwrite: bool = False) -> DataFrame:
    """notes: number to text, the same for every package. Returns the report; a key that is no number is an error."""
    bad = [k for k in notes if not str(k).isdigit()]
    if bad:
        raise ValueError(f"these keys aren't numbers: {bad}")
    parts = _parts(spark, path)
    given = spark.createDataFrame([(int(k), v) for k, v in notes.items()], "note_id long, body string")
    out, report = D.inject_footnotes(parts, parts.select("doc_id").distinct().crossJoin(F.broadcast(given)), overwrite)
    _save(out, output)
    return report


def transplant_body(spark: SparkSession, blueprint: str, path: str, output: str) -> None:
    """The bodies of all packages under ``path`` in the frame of the one blueprint."""
    target, source = _parts(spark, blueprint), _parts(spark, path)
    pairs = target.select(F.col("doc_id").alias("blueprint_id")).distinct().crossJoin(source.select(F.col("doc_id").alias("source_id")).distinct())
    _save(D.transplant(target, source, pairs), output)


def analyze_blueprint(spark: SparkSession, path: str) -> DataFrame:
    return D.blueprint(_parts(spark, path))


def apply_style_mapping(spark: SparkSession, blueprint: str, path: str, output: str, overrides: dict[str, str] | None = None) -> None:
    """Paragraph styles of the packages by the ids of the blueprint's; texts and all else stay."""
    target, source = _parts(spark, blueprint), _parts(spark, path)
    ids = source.select("doc_id").distinct()
    pairs = target.select(F.col("doc_id").alias("blueprint_id")).distinct().crossJoin(ids.select(F.col("doc_id").alias("source_id")))
    given = None
    if overrides:
        given = ids.crossJoin(F.broadcast(spark.createDataFrame(list(overrides.items()), "source string, target string")))
    _save(D.apply_mapping(source, D.style_mapping(source, target, pairs, given)), output)


def infer_heading_levels(spark: SparkSession, path: str, blueprint: str | None = None, output: str | None = None, insert_missing: bool = False) -> DataFrame:
    """doc_id, p_idx, level, size, preview; with a blueprint and an output the levels are applied too."""
    parts = _parts(spark, path)
    found = D.infer_headings(parts)
    if blueprint and output:
        _save(D.apply_headings(parts, found, _parts(spark, blueprint), insert_missing), output)
    return found


def check_package(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all checks; packages that can't be read are issues of check 0."""
    broken = read(spark, path).where("error is not null").select("doc_id", F.lit(0).alias("check_no"), F.lit("issue").alias("severity"), F.lit(0).alias("seq"), F.col("error").alias("message"))
    return broken.unionByName(D.check_package(_parts(spark, path)))


def extract_paragraph_texts(spark: SparkSession, path: str) -> DataFrame:
    return D.paragraph_texts(_parts(spark, path))


def extract_paragraph_runs(spark: SparkSession, path: str) -> DataFrame:
    return D.paragraph_runs(_parts(spark, path))


def replace_paragraph_runs(spark: SparkSession, path: str, runs: DataFrame, output: str) -> None:
    _save(D.replace_runs(_parts(spark, path), runs), output)


def translate(spark: SparkSession, path: str, output: str, providers: list, source: str, target: str, concurrency: int | None = None, preserve_formatting: bool = False) -> DataFrame:
    """Returns how many paragraphs of each package were translated, and how many failed and keep their text.

    With ``preserve_formatting`` the formats of the runs go along to the translation. Each text is sent once.
    """
    job = D.translate_runs if preserve_formatting else D.translate_packages
    out, summary = job(_parts(spark, path), providers, source, target, concurrency=concurrency)
    _save(out, output)
    return summary
