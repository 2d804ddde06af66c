"""Carrying formats from the runs of a text to its translation along word edges.

runs: pair_id, r_idx, text, format (any hashable, null is one). Translations: pair_id, text. Edges:
pair_id, src_word, tgt_word over words as white space divides them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import SPACE

_WORD = r"[^\s\p{Z}\x1c-\x1f\x85]+"
#: The same words, for Python, whose white space is just that.
_PYTHON_WORD = re.compile(r"\S+")
#: Characters of texts that a task sends back at once.
BATCH_CHARS = 1 << 20


def word_spans(texts: DataFrame) -> DataFrame:
    """(pair_id, w_idx, start, stop, word): words and the spans of their characters, and nothing else of the row."""
    pieces = F.regexp_extract_all("text", F.lit(f"({_WORD}|{SPACE}+)"), F.lit(1))
    p = texts.select("pair_id", F.posexplode(pieces).alias("k", "word")).withColumn("n", F.char_length("word"))
    w = Window.partitionBy("pair_id").orderBy("k")
    p = p.withColumn("stop", F.sum("n").over(w)).where(F.col("word").rlike(f"^{_WORD}$"))
    return p.select("pair_id", (F.row_number().over(w) - 1).cast("int").alias("w_idx"), (F.col("stop") - F.col("n")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "word")


def whole_text(runs: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_idx", "text"))), lambda x: x.text), "")
    return runs.groupBy("pair_id").agg(text.alias("text"))


def word_runs(runs: Sequence[str | None], words: Sequence[tuple[int, int]]) -> list[int]:
    """The run, by its index, of each word of the runs' text: the one with most of its characters, the later of equal ones. One pass over both."""
    out, k, start = [], 0, 0
    sizes = [len(r or "") for r in runs]
    for a, b in words:
        while start + sizes[k] <= a:
            start += sizes[k]
            k += 1
        best, most, at, j = k, 0, start, k
        while at < b:
            n = min(b, at + sizes[j]) - max(a, at)
            if n and n >= most:
                best, most = j, n
            at += sizes[j]
            j += 1
        out.append(best)
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PYTHON_WORD.finditer(text)]


def carried(runs: Sequence[str | None], formats: Sequence, text: str, links: Iterable[tuple[int, int]] | None = None) -> list[tuple[str, int | None]]:
    """(piece, index of the run whose format it has): what ``transfer`` does, for one text, in time linear in it.

    links: (target word, source word); without them each target word is linked to the source word at the same
    share of its sentence, as ``links_by_place`` does.
    """
    whole = "".join(r or "" for r in runs)
    if links is None and text and formats and all(f == formats[0] for f in formats):  # every word is linked, to the only format
        return [(text, 0 if _PYTHON_WORD.search(whole) and _PYTHON_WORD.search(text) else None)]
    own, words = word_runs(runs, _spans(whole)), _spans(text)
    if links is None:
        first = {t: t * len(own) // len(words) for t in range(len(words))} if own else {}
    else:
        first = {}
        for t, s in links:
            if s is not None and 0 <= s < len(own):
                first[t] = min(s, first.get(t, s))
    run = next((own[first[t]] for t in range(len(words)) if t in first), None)
    cuts: list[tuple[int, int | None]] = []
    for t, (a, _) in enumerate(words):
        run = own[first[t]] if t in first else run
        new = run if run is None else formats[run]
        if not cuts or new != last:
            cuts.append((a if cuts else 0, run))
        last = new
    ends = [a for a, _ in cuts[1:]] + [len(text)]
    return [(text[a:z], r) for (a, r), z in zip(cuts or [(0, None)], ends)] if text else []


def _codes(formats: pa.Array) -> list[int | None]:
    """Equal numbers for equal values, None for null."""
    if pa.types.is_null(formats.type) or pa.types.is_nested(formats.type) or pa.types.is_floating(formats.type):
        seen: dict = {}
        return [None if v is None else seen.setdefault(repr(v + 0.0 if isinstance(v, float) else v), len(seen)) for v in formats.to_pylist()]
    return formats.dictionary_encode().indices.to_pylist()


def _by_pair(rows: DataFrame, like: DataFrame, schema: str, pieces_of: Callable[[dict, dict, list], Iterable[tuple]]) -> DataFrame:
    """A row for each of a pair's pieces: (pair_id, columns of ``schema``, format).

    rows: pair_id, _runs (structs with a format), and more columns. pieces_of(row, columns of its structs, numbers of their
    formats) gives tuples that end with the index of the struct whose format counts, or None. Formats stay in Arrow.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, runs = batch.column("pair_id"), batch.column("_runs")
            offsets, formats = runs.offsets.to_pylist(), runs.values.field("format")
            names = [f.name for f in runs.values.type if f.name != "format"]
            codes = _codes(formats)
            others = [n for n in batch.schema.names if n not in ("pair_id", "_runs")]
            held, chars = [], 0
            for k in range(len(batch)):
                a, z = offsets[k], offsets[k + 1]
                row = {n: batch.column(n)[k].as_py() for n in others}
                own = {n: runs.values.field(n).slice(a, z - a).to_pylist() for n in names}
                for *piece, r in pieces_of(row, own, codes[a:z]):
                    held.append((k, *piece, None if r is None else a + r))
                    chars += 16 + sum(len(x) for x in piece if isinstance(x, str))
                if held and (chars > BATCH_CHARS or k == len(batch) - 1):
                    at, *columns, where = zip(*held)
                    columns = [pa.array(c, f.type) for c, f in zip(columns, between)]
                    yield pa.RecordBatch.from_arrays([pairs.take(pa.array(at)), *columns, formats.take(pa.array(where, pa.int64()))], names=["pair_id", *between.names, "format"])
                    held, chars = [], 0

    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    between = to_arrow_schema(T.StructType.fromDDL(schema))
    full = T.StructType([rows.schema["pair_id"], *T.StructType.fromDDL(schema), like.schema["format"]])
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in full]))


def _runs_of_pairs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("r_idx", "text", "format"))).alias("_runs"))


def majority_format(runs: DataFrame) -> DataFrame:
    """(pair_id, w_idx, r_idx, format) of each source word: the run with most of its characters, the later of equal ones. One pass over a pair's runs and words."""

    def pieces(_: dict, own: dict, __: list) -> Iterator[tuple]:
        words = _spans("".join(t or "" for t in own["text"]))
        return ((w, own["r_idx"][r], r) for w, r in enumerate(word_runs(own["text"], words)))

    return _by_pair(_runs_of_pairs(runs), runs, f"w_idx int, r_idx {runs.schema['r_idx'].dataType.simpleString()}", pieces)


def fill_formats(target_words: DataFrame, edges: DataFrame, source_formats: DataFrame, default: Column | None = None) -> DataFrame:
    """The format of each target word: that of its first edge's source word, else of the nearest aligned word to the left, else to the right.

    Edges to words that there aren't don't count. has_format tells a null format from none.
    """
    first = edges.join(source_formats.select("pair_id", F.col("w_idx").alias("src_word"), "format"), ["pair_id", "src_word"])
    first = first.groupBy("pair_id", F.col("tgt_word").alias("w_idx")).agg(F.min_by(F.struct("format"), "src_word").alias("_f"))
    j = target_words.join(first, ["pair_id", "w_idx"], "left")
    w = Window.partitionBy("pair_id").orderBy("w_idx")
    left = F.last("_f", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("pair_id").orderBy(F.desc("w_idx"))  # a frame that ends at the last row is summed up anew for each row
    right = F.last("_f", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    f = F.coalesce("_f", left, right)
    out = f["format"] if default is None else F.coalesce(F.when(f.isNotNull(), f), F.struct(default.alias("format")))["format"]
    return j.withColumn("format", out).withColumn("has_format", f.isNotNull() if default is None else F.lit(True)).drop("_f")


def merge_runs(texts: DataFrame, formatted: DataFrame) -> DataFrame:
    """(pair_id, r_idx, text, format): the translation cut into as few runs as its formats allow; their texts add up to it.

    The space before a word goes with the word before it, before the first with that; the space at the end
    with the last word. Neighbours with equal formats are one run, nulls too. A text without words is one
    run with a null format; an empty text has none.
    """
    w = Window.partitionBy("pair_id").orderBy("w_idx")
    first = F.row_number().over(w) == 1
    changed = F.when(first | ~F.col("format").eqNullSafe(F.lag("format").over(w)), 1).otherwise(0)
    cuts = formatted.withColumn("_c", changed).withColumn("from", F.when(first, 0).otherwise(F.col("start"))).where("_c = 1")
    runs = cuts.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("w_idx", "from", "format"))).alias("_runs"))

    def pieces(row: dict, own: dict, _: list) -> Iterator[tuple]:
        cut = own["from"] or [0]
        return ((k, row["text"][a:z], k if own["from"] else None) for k, (a, z) in enumerate(zip(cut, [*cut[1:], None])))

    return _by_pair(texts.where("text <> ''").select("pair_id", "text").join(runs, "pair_id", "left"), formatted, "r_idx int, text string", pieces)


def transfer(runs: DataFrame, translations: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs, translation and word edges to target runs, a pair at a time: no rows for words."""
    ends = F.struct(F.col("tgt_word").cast("long").alias("t"), F.col("src_word").cast("long").alias("s"))
    links = edges.groupBy("pair_id").agg(F.collect_list(ends).alias("_links"))

    def pieces(row: dict, own: dict, codes: list) -> Iterator[tuple]:
        found = carried(own["text"], codes, row["text"], [(x["t"], x["s"]) for x in row["_links"] or ()])
        return ((k, text, r) for k, (text, r) in enumerate(found))

    rows = translations.where("text <> ''").select("pair_id", "text").join(_runs_of_pairs(runs), "pair_id", "left").join(links, "pair_id", "left")
    return _by_pair(rows, runs, "r_idx int, text string", pieces)


def links_by_place(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, src_word, tgt_word): each target word with the source word at the same share of its sentence; for want of an aligner."""
    n = lambda df, name: word_spans(df).groupBy("pair_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    words = word_spans(target).select("pair_id", F.col("w_idx").alias("tgt_word")).join(n(source, "_s"), "pair_id").join(n(target, "_t"), "pair_id")
    return words.select("pair_id", F.floor(F.col("tgt_word") * F.col("_s") / F.col("_t")).cast("int").alias("src_word"), "tgt_word")
