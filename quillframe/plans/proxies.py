"""The driver's tables in the shape of document tables, for the queries: as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as paragraphs."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p_idx", "text"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Four parts for a page, two of them not always there; one scan."""
    p = table(spark, d, "pages")
    rows = [(0, "[Content_Types].xml", "url"), (1, "word/document.xml", "html"), (2, "word/_rels/document.xml.rels", "url"), (3, "word/footnotes.xml", "notes")]
    made = F.array(*(F.struct(F.lit(k).alias("part_ord"), F.lit(n).alias("part_name"), F.col(c).alias("data")) for k, n, c in rows))
    out = p.withColumn("notes", F.col("html")).select(F.col("page_id").alias("doc_id"), F.inline(made))
    return out.where(~((F.col("part_ord") == 0) & (F.col("doc_id") % 7 == 0)) & ~((F.col("part_ord") == 3) & (F.col("doc_id") % 3 == 0)))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items with n, their number in the order from 1: line numbers repeat."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w))


def font_runs(spark: SparkSession, d: str) -> DataFrame:
    """Line items as runs of formatted paragraphs, an order a paragraph, 64 order keys a document."""
    li = items(spark, d)
    k, n = F.col("l_orderkey"), F.col("n")
    return li.select(
        F.floor(k / 64).cast("long").alias("doc_id"),
        k.cast("long").alias("p_idx"),
        n.cast("int").alias("r_idx"),
        F.when(n == 4, "").otherwise(F.concat(F.lit("run "), F.col("l_partkey").cast("string"))).alias("text"),
        F.col("l_returnflag").isin("R", "A").alias("bold"),
        F.when(n % 2 == 1, F.col("l_quantity") / 2).alias("size"),
        (k % 11 == 0).alias("ppr_bold"),
        F.when(k % 5 == 0, F.lit(12.0)).alias("ppr_size"),
        F.when(k % 13 == 0, "heading1").when(k % 7 == 0, "body").alias("style_class"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as runs of a text; two turns share a format."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("int").alias("r_idx"), F.col("text"), F.expr("cast(turn div 2 as int)").alias("format"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring labels; the first eight vectors of a label by id are its tokens."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn <= 8")
    word = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("##x"), F.col("vec_id").cast("string"))).when(F.col("vec_id") % 10 == 0, F.lit("[SEP]")).otherwise(F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    base = e.select("label", (F.col("rn") - 1).cast("int").alias("tok_idx"), word.alias("token"), F.col("embedding").alias("vec"))
    sides = F.explode(F.array(F.struct(F.col("label").alias("pair_id"), F.lit("src").alias("side")), F.struct((F.col("label") - 1).alias("pair_id"), F.lit("tgt").alias("side"))))
    return base.select(sides.alias("s"), "tok_idx", "token", "vec").select("s.pair_id", "s.side", "tok_idx", "token", "vec")


def style_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as styles, 40 part keys a document; names as style sheets have them."""
    names = ["heading 1", "Heading 2", "Title", "Normal", "Body Text", "caption", "Quote", "footnote text", "Überschrift 3", "My Style", "abstract", "HEADING 4"]
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 40).cast("long").alias("doc_id"),
        k.alias("ord"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 12 + 1).cast("int")).alias("name"),
        F.concat(F.lit("S"), (k % 40).cast("string")).alias("style_id"),
        F.when(k % 9 == 0, 2).otherwise(1).alias("type_val"),
        F.when(F.col("p_size") % 10 < 3, (F.col("p_size") % 10).cast("int")).alias("outline_level"),
    )


SQL = {
    "lines": "lines AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS p_idx, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))",
    "parts": """parts AS (
 SELECT page_id AS doc_id, 0 AS part_ord, '[Content_Types].xml' AS part_name, url AS data FROM pages WHERE page_id % 7 <> 0
 UNION ALL SELECT page_id, 1, 'word/document.xml', html FROM pages
 UNION ALL SELECT page_id, 2, 'word/_rels/document.xml.rels', url FROM pages
 UNION ALL SELECT page_id, 3, 'word/footnotes.xml', html FROM pages WHERE page_id % 3 <> 0)""",
    "items": "items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)",
    "font_runs": """font_runs AS (SELECT floor(l_orderkey / 64.0)::BIGINT AS doc_id, l_orderkey AS p_idx, n::INTEGER AS r_idx,
 CASE WHEN n = 4 THEN '' ELSE 'run ' || l_partkey END AS text, l_returnflag IN ('R', 'A') AS bold,
 CASE WHEN n % 2 = 1 THEN l_quantity / 2 END AS size, l_orderkey % 11 = 0 AS ppr_bold, CASE WHEN l_orderkey % 5 = 0 THEN 12.0::DOUBLE END AS ppr_size,
 CASE WHEN l_orderkey % 13 = 0 THEN 'heading1' WHEN l_orderkey % 7 = 0 THEN 'body' END AS style_class FROM items)""",
    "turns": "turns AS (SELECT conv_id AS pair_id, turn::INTEGER AS r_idx, text, (turn // 2)::INTEGER AS format FROM conversations)",
    "tokens": """ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
base AS (SELECT label, rn, CASE WHEN vec_id % 3 = 0 THEN '##x' || vec_id WHEN vec_id % 10 = 0 THEN '[SEP]' ELSE 'w' || vec_id END AS token, embedding AS vec FROM ranked WHERE rn <= 8),
tokens AS (SELECT label AS pair_id, 'src' AS side, (rn - 1)::INTEGER AS tok_idx, token, vec FROM base UNION ALL SELECT label - 1, 'tgt', (rn - 1)::INTEGER, token, vec FROM base)""",
    "style_rows": """style_rows AS (SELECT floor(p_partkey / 40.0)::BIGINT AS doc_id, p_partkey AS ord,
 ['heading 1', 'Heading 2', 'Title', 'Normal', 'Body Text', 'caption', 'Quote', 'footnote text', 'Überschrift 3', 'My Style', 'abstract', 'HEADING 4'][p_size % 12 + 1] AS name,
 'S' || (p_partkey % 40) AS style_id, CASE WHEN p_partkey % 9 = 0 THEN 2 ELSE 1 END AS type_val, CASE WHEN p_size % 10 < 3 THEN (p_size % 10)::INTEGER END AS outline_level FROM part)""",
    "paras": """paras AS (SELECT doc_id, p_idx, string_agg(text, '' ORDER BY r_idx) AS text,
 coalesce(bool_and(CASE WHEN text <> '' THEN bold OR ppr_bold END), false) OR bool_or(ppr_bold) AS bold,
 coalesce(avg(CASE WHEN text <> '' THEN size END), max(ppr_size)) AS size, max(style_class) AS style_class FROM font_runs GROUP BY doc_id, p_idx)""",
    "body": """body AS (SELECT doc_id, size AS body_size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size DESC) AS rn
 FROM open_ WHERE trim(text) <> '' AND NOT (bold AND length(text) < 100) AND size IS NOT NULL GROUP BY doc_id, size) WHERE rn = 1)""",
    "sim": """sim AS (SELECT s.pair_id, s.tok_idx AS src, t.tok_idx AS tgt, round(list_sum(list_transform(range(1, 65), lambda i: s.vec[i]::DOUBLE * t.vec[i]::DOUBLE)), 4) + 0.0::DOUBLE AS sim
 FROM tokens s JOIN tokens t ON s.pair_id = t.pair_id AND s.side = 'src' AND t.side = 'tgt')""",
    "word_tokens": """kept AS (SELECT * FROM tokens WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]', '[MASK]', '<s>', '</s>', '<pad>', '<unk>', '<mask>')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY tok_idx) AS k FROM kept),
word_tokens AS (SELECT pair_id, side, tok_idx, (sum(CASE WHEN NOT starts_with(token, '##') OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY tok_idx) - 1)::INTEGER AS w_idx,
 regexp_replace(token, '^##', '') AS piece FROM numbered)""",
    "greedy": """grid AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sim DESC, src, tgt) AS k FROM sim WHERE sim >= 0.0),
matching AS (SELECT * FROM (WITH RECURSIVE step AS (
 SELECT pair_id, 0::BIGINT AS k, []::INTEGER[] AS s, []::INTEGER[] AS t, -1 AS src, -1 AS tgt, 0.0::DOUBLE AS sim, false AS took FROM (SELECT DISTINCT pair_id FROM grid)
 UNION ALL SELECT g.pair_id, g.k, CASE WHEN list_contains(p.s, g.src) OR list_contains(p.t, g.tgt) THEN p.s ELSE list_append(p.s, g.src) END,
 CASE WHEN list_contains(p.s, g.src) OR list_contains(p.t, g.tgt) THEN p.t ELSE list_append(p.t, g.tgt) END, g.src, g.tgt, g.sim, NOT (list_contains(p.s, g.src) OR list_contains(p.t, g.tgt))
 FROM step p JOIN grid g ON g.pair_id = p.pair_id AND g.k = p.k + 1) SELECT pair_id, src, tgt, sim FROM step WHERE took))""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
