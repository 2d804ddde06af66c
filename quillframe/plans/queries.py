"""The queries: each operator over the driver's tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import languages, text
from quillframe.functions import styles as style_names
from quillframe.operators import alignment, checks, formatting, headings, notes, packages, styles, translation
from quillframe.plans import documents, proxies
from quillframe.plans.proxies import table, with_
from quillframe.sources import tables
from quillframe.sources import xmlparts as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _md5(c: str) -> Column:
    return F.md5(F.col(c).cast("binary")).alias(c)


# packages


@query(with_("parts") + "SELECT doc_id, part_ord, part_name FROM parts WHERE doc_id IN (SELECT doc_id FROM parts WHERE part_name = '[Content_Types].xml')")
def valid_package_filter(spark, d):
    return packages.valid_packages(proxies.parts(spark, d)).select("doc_id", "part_ord", "part_name")


@query(with_("parts") + "SELECT doc_id, part_ord, md5(data) AS data FROM parts WHERE part_name = 'word/footnotes.xml'")
def part_lookup(spark, d):
    return packages.lookup(proxies.parts(spark, d), packages.FOOTNOTES).select("doc_id", "part_ord", _md5("data"))


_NEW = "SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'word/footnotes.xml' ELSE 'word/styles.xml' END AS part_name, 'new ' || page_id AS data FROM pages WHERE page_id % 5 = 0"


@query(
    with_("parts")
    + f""", new AS ({_NEW}), ends AS (SELECT doc_id, max(part_ord) AS last FROM parts GROUP BY doc_id)
SELECT doc_id, coalesce(p.part_ord, ends.last + 1)::INTEGER AS part_ord, part_name, md5(coalesce(n.data, p.data)) AS data
FROM parts p FULL JOIN new n USING (doc_id, part_name) LEFT JOIN ends USING (doc_id)"""
)
def part_upsert(spark, d):
    k = F.col("page_id")
    new = table(spark, d, "pages").where(k % 5 == 0).select(k.alias("doc_id"), F.when(k % 2 == 0, packages.FOOTNOTES).otherwise(packages.STYLES).alias("part_name"), F.concat(F.lit("new "), k.cast("string")).alias("data"))
    return packages.upsert(proxies.parts(spark, d), new).select("doc_id", "part_ord", "part_name", _md5("data"))


@query(with_("parts") + "SELECT doc_id, part_ord, CASE WHEN part_name = 'word/footnotes.xml' THEN 'word/endnotes.xml' ELSE part_name END AS part_name FROM parts")
def part_rename(spark, d):
    return packages.rename(proxies.parts(spark, d), packages.FOOTNOTES, packages.ENDNOTES).select("doc_id", "part_ord", "part_name")


@query(with_("parts") + "SELECT doc_id, part_ord, part_name FROM parts WHERE part_name <> 'word/footnotes.xml'")
def part_remove(spark, d):
    return packages.remove(proxies.parts(spark, d), packages.FOOTNOTES).select("doc_id", "part_ord", "part_name")


@query(with_("parts") + "SELECT doc_id // 2 AS doc_id, part_name, md5(arg_max(data, doc_id * 10 + part_ord)) AS data FROM parts GROUP BY 1, 2")
def parts_by_name(spark, d):
    """Two pages as a package, so that most names are there twice."""
    p = proxies.parts(spark, d)
    twice = p.select(F.expr("doc_id div 2").alias("doc_id"), (F.col("doc_id") * 10 + F.col("part_ord")).alias("part_ord"), "part_name", "data")
    return packages.by_name(twice).select("doc_id", "part_name", _md5("data"))


@query(with_("parts") + "SELECT doc_id, part_ord, part_name, strlen(data)::INTEGER AS n_bytes, count(*) OVER (PARTITION BY doc_id) AS n_parts FROM parts")
def inspect_parts(spark, d):
    return packages.inspect(proxies.parts(spark, d))


@query(with_("parts") + "SELECT doc_id, part_name FROM parts WHERE ends_with(part_name, '.xml') OR ends_with(part_name, '.rels')")
def xml_parts_filter(spark, d):
    return packages.xml_parts(proxies.parts(spark, d)).select("doc_id", "part_name")


@query(
    with_("parts")
    + """, target AS (SELECT * FROM parts WHERE part_name <> 'word/footnotes.xml' AND doc_id % 2 = 0)
SELECT doc_id, part_ord, part_name FROM target UNION ALL
SELECT doc_id, (SELECT max(part_ord) FROM target t WHERE t.doc_id = p.doc_id)::INTEGER + 1, part_name FROM parts p WHERE part_name = 'word/footnotes.xml' AND doc_id IN (SELECT doc_id FROM target)"""
)
def carry_aux_part(spark, d):
    p = proxies.parts(spark, d)
    target = packages.remove(p, packages.FOOTNOTES).where(F.col("doc_id") % 2 == 0)
    return packages.carry_part(target, p, packages.FOOTNOTES).select("doc_id", "part_ord", "part_name")


@query("SELECT event_id AS doc_id, key, try_cast(key AS BIGINT) AS note_id, json_extract_string(props, '$.' || key) AS body FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_notes_source(spark, d):
    return packages.json_notes(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "props"), "props")


# paragraphs and runs


@query(with_("turns") + "SELECT pair_id, string_agg(text, '' ORDER BY r_idx) AS text FROM turns GROUP BY pair_id")
def full_text(spark, d):
    return formatting.whole_text(proxies.turns(spark, d))


@query(with_("lines") + "SELECT doc_id, p_idx, regexp_matches(text, '^[ \\t\\n\\r\\f]|[ \\t\\n\\r\\f]$') AS keep FROM (SELECT doc_id, p_idx, CASE WHEN p_idx % 3 = 0 THEN text || ' ' WHEN p_idx % 3 = 1 THEN ' ' || text ELSE text END AS text FROM lines)")
def needs_preserve(spark, d):
    t = F.when(F.col("p_idx") % 3 == 0, F.concat("text", F.lit(" "))).when(F.col("p_idx") % 3 == 1, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return proxies.lines(spark, d).withColumn("text", t).select("doc_id", "p_idx", text.needs_preserve(F.col("text")).alias("keep"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_xml(F.col("html")).cast("binary")).alias("escaped"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')) AS plain FROM pages")
def xml_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape_xml(F.col("html")).cast("binary")).alias("plain"))


@query("SELECT p_partkey, round(floor(p_retailprice)::INTEGER / 20.0, 2)::DOUBLE AS points, try_cast(p_name AS DOUBLE) AS none FROM part")
def twips_to_pt(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.twips_to_points(F.floor("p_retailprice").cast("int").cast("string")).alias("points"), text.twips_to_points(F.col("p_name")).alias("none"))


@query("SELECT o_orderkey, (CASE WHEN o_totalprice > 200000 THEN 'landscape' ELSE 'portrait' END) AS orientation, round(o_custkey / 20.0, 2)::DOUBLE AS page_width, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS section FROM orders")
def section_geometry(spark, d):
    """Orders of a customer as the sections of a document."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "landscape").otherwise("portrait").alias("orientation"), text.twips_to_points(F.col("o_custkey").cast("string")).alias("page_width"), (F.row_number().over(w) - 1).cast("int").alias("section"))


@query("SELECT regexp_extract(url, '[^/]*$') AS last, count(*) AS n FROM pages GROUP BY 1")
def last_segment(spark, d):
    return table(spark, d, "pages").groupBy(text.last_segment(F.col("url")).alias("last")).agg(F.count(F.lit(1)).alias("n"))


_TARGET = "CASE page_id % 5 WHEN 0 THEN '../media/image' || page_id || '.png' WHEN 1 THEN '/word/styles.xml' WHEN 2 THEN './theme//theme1.xml' WHEN 3 THEN '../../x' || page_id ELSE 'settings.xml' END"


def _target(k: Column) -> Column:
    n = k.cast("string")
    return F.when(k % 5 == 0, F.concat(F.lit("../media/image"), n, F.lit(".png"))).when(k % 5 == 1, F.lit("/word/styles.xml")).when(k % 5 == 2, F.lit("./theme//theme1.xml")).when(k % 5 == 3, F.concat(F.lit("../../x"), n)).otherwise(F.lit("settings.xml"))


_RESOLVED = "CASE page_id % 5 WHEN 0 THEN 'media/image' || page_id || '.png' WHEN 1 THEN 'word/styles.xml' WHEN 2 THEN 'word/theme/theme1.xml' WHEN 3 THEN 'x' || page_id ELSE 'word/settings.xml' END"


@query(f"SELECT page_id, {_TARGET} AS target, {_RESOLVED} AS part_name FROM pages")
def resolve_path(spark, d):
    p = table(spark, d, "pages").withColumn("target", _target(F.col("page_id")))
    return p.select("page_id", "target", text.resolve_path(F.lit("word/"), F.col("target")).alias("part_name"))


# headings

_OPEN = ", open_ AS (SELECT * FROM paras WHERE style_class IS NULL OR NOT (starts_with(style_class, 'heading') OR style_class = 'title'))"
_CAND = ", cand AS (SELECT doc_id, p_idx, text, coalesce(size, 0.0) AS size FROM open_ WHERE bold AND trim(text) <> '' AND length(text) < 100)"


@query(with_("items", "font_runs", "paras") + "SELECT doc_id, p_idx, bold FROM paras")
def effective_bold(spark, d):
    return headings.paragraphs(proxies.font_runs(spark, d)).select("doc_id", "p_idx", "bold")


@query(with_("items", "font_runs", "paras") + "SELECT doc_id, p_idx, round(size, 4) AS size FROM paras")
def effective_size(spark, d):
    return headings.paragraphs(proxies.font_runs(spark, d)).select("doc_id", "p_idx", F.round("size", 4).alias("size"))


@query(with_("items", "font_runs") + "SELECT doc_id, p_idx, count(*) AS n_runs FROM font_runs GROUP BY doc_id, p_idx HAVING bool_and(bold)")
def all_bold_paragraphs(spark, d):
    return headings.all_bold(proxies.font_runs(spark, d))


@query(with_("items", "font_runs", "paras") + _OPEN[2:].join([", ", ""]) + " SELECT doc_id, p_idx, style_class FROM open_")
def body_class_filter(spark, d):
    return headings.body_class(headings.paragraphs(proxies.font_runs(spark, d))).select("doc_id", "p_idx", "style_class")


@query(with_("items", "font_runs", "paras") + _OPEN + _CAND + " SELECT doc_id, p_idx, text FROM cand")
def heading_candidates(spark, d):
    return headings.candidates(headings.body_class(headings.paragraphs(proxies.font_runs(spark, d)))).select("doc_id", "p_idx", "text")


@query(with_("items", "font_runs", "paras") + _OPEN + ", " + proxies.SQL["body"] + " SELECT doc_id, body_size FROM body")
def mode_body_size(spark, d):
    return headings.body_size(headings.body_class(headings.paragraphs(proxies.font_runs(spark, d))))


_LEVELS = (
    _OPEN
    + _CAND
    + ", "
    + proxies.SQL["body"]
    + """, sized AS (SELECT c.*, coalesce(b.body_size, 0.0) AS body_size FROM cand c LEFT JOIN body b USING (doc_id)),
thresholds AS (SELECT doc_id, size AS t, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS i FROM (SELECT DISTINCT doc_id, size FROM sized WHERE size > 0 AND (body_size = 0 OR size > body_size + 0.4))),
inferred AS (SELECT s.doc_id, s.p_idx, s.size, s.text, CASE WHEN max(t.i) IS NULL THEN 1 ELSE least(coalesce(min(t.i) FILTER (WHERE s.size >= t.t - 0.4), max(t.i)), 9) END::INTEGER AS level
 FROM sized s LEFT JOIN thresholds t USING (doc_id) GROUP BY s.doc_id, s.p_idx, s.size, s.text)"""
)


@query(with_("items", "font_runs", "paras") + _LEVELS + " SELECT doc_id, p_idx, level, round(size, 4) AS size, substring(text, 1, 60) AS preview FROM inferred")
def infer_headings(spark, d):
    return headings.infer_headings(headings.paragraphs(proxies.font_runs(spark, d))).withColumn("size", F.round("size", 4))


@query(
    with_("items", "font_runs", "paras")
    + _LEVELS
    + """ SELECT p.doc_id, p.p_idx, CASE WHEN style_class IS NOT NULL THEN coalesce(CASE WHEN level <= 3 THEN 'BP' || level END, style_class) END AS style_id, coalesce(style_class IS NOT NULL AND level <= 3, false) AS rewritten
FROM paras p LEFT JOIN inferred USING (doc_id, p_idx)"""
)
def apply_headings(spark, d):
    paras = headings.paragraphs(proxies.font_runs(spark, d))
    style_of = spark.range(1, 4).select(F.col("id").cast("int").alias("level"), F.concat(F.lit("BP"), F.col("id").cast("string")).alias("new_id"))
    return headings.apply_headings(paras.withColumnRenamed("style_class", "style_id"), headings.infer_headings(paras), style_of)


# styles

_CLASS, _LEVEL = style_names.classify_sql("name")
#: Style names by class and level, written down by hand.
_NAMES = """heading1 1: Heading 1|heading 10|h1|titolo 1|标题 1|Rubrik 1; heading2 2: Überschrift 2|Ueberschrift_02|Titre2|nagłówek 2; heading3 3: HEADING 3 Char|Kop 3; heading4 4: Заголовок 4|my heading - 4; heading7 7: rubrik  07
; title 0: Title|DocumentTitle; unknown 0: Subtitle|List Paragraph|heading|Zwischenzeile; footnote 0: footnote text|Fußnotentext; caption 0: Caption|Légende; blockquote 0: Intense Quote|Zitat; abstract 0: Abstract|Résumé; body 0: Normal|Normal (Web)|Body Text 2|No Spacing|  standard  """.replace("\n", "")
_NAMES = [(name, label.split()[0], int(label.split()[1])) for label, names in (x.split(": ", 1) for x in _NAMES.split("; ")) for name in names.split("|")]


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', {k})" for n, c, k in _NAMES) + """) AS t(name, class, heading_level)
UNION SELECT p_type, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'body' ELSE 'unknown' END, 0 FROM part UNION SELECT c_mktsegment, 'unknown', 0 FROM customer"""
)
def classify_style(spark, d):
    given = spark.range(1).select(F.explode(F.array(*(F.lit(n) for n, _, _ in _NAMES))).alias("name"))
    names = given.unionByName(table(spark, d, "part").select(F.col("p_type").alias("name"))).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))).distinct()
    c = style_names.classify_style("name")
    return names.select("name", c["class"].alias("class"), c["heading_level"].alias("heading_level"))


_INDEX = "idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord DESC) AS rn FROM style_rows) WHERE rn = 1)"


@query(with_("style_rows") + f", {_INDEX} SELECT doc_id, name, style_id, type_val, outline_level FROM idx")
def style_index(spark, d):
    return styles.style_index(proxies.style_rows(spark, d)).select("doc_id", "name", "style_id", "type_val", "outline_level")


@query(with_("style_rows") + "SELECT DISTINCT doc_id, style_id FROM style_rows WHERE type_val = 1")
def body_styles_distinct(spark, d):
    return styles.body_styles(proxies.style_rows(spark, d).where("type_val = 1"))


_USED = "used AS (SELECT DISTINCT doc_id, name AS style_id FROM style_rows WHERE ord % 4 = 0)"
_SLOTS = f"""marked AS (SELECT i.*, {_CLASS} AS class, ({_LEVEL})::INTEGER AS lv, EXISTS (SELECT 1 FROM used u WHERE u.doc_id = i.doc_id AND u.style_id = i.name) AS used FROM idx i WHERE type_val = 1),
both_ AS (SELECT doc_id, outline_level + 1 AS level, 0 AS pass, name, used FROM marked WHERE outline_level BETWEEN 0 AND 8 UNION ALL SELECT doc_id, lv, 1, name, used FROM marked WHERE lv > 0),
slots AS (SELECT doc_id, level, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY used DESC, CASE WHEN used THEN -pass ELSE pass END, CASE WHEN used THEN -nr ELSE nr END) AS rn
 FROM (SELECT *, row_number() OVER (ORDER BY name) AS nr FROM both_)) WHERE rn = 1)"""
_WANTED = f"wanted AS (SELECT DISTINCT idx.doc_id, n.name, {_CLASS.replace('name', 'n.name')} AS class, ({_LEVEL.replace('name', 'n.name')})::INTEGER AS heading_level FROM (SELECT DISTINCT doc_id FROM idx) idx, (SELECT unnest(['Heading 1', 'heading 5', 'TITLE', 'Quote', 'my style', 'Unheard of', 'Caption', 'Abstract', 'footnote text', 'Heading 9']) AS name) n)"
_WANTED_NAMES = ["Heading 1", "heading 5", "TITLE", "Quote", "my style", "Unheard of", "Caption", "Abstract", "footnote text", "Heading 9"]
_NEAREST = """near AS (SELECT w.doc_id, w.name, w.heading_level, s.name AS slot, row_number() OVER (PARTITION BY w.doc_id, w.name ORDER BY CASE s.level - w.heading_level WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 WHEN -2 THEN 4 WHEN 3 THEN 5 WHEN -3 THEN 6 ELSE 10 + s.level END) AS rn
 FROM wanted w JOIN slots s USING (doc_id))"""


def _wanted(index: DataFrame) -> DataFrame:
    w = index.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, _WANTED_NAMES))).alias("name"))
    c = style_names.classify_style("name")
    return w.select("doc_id", "name", c["class"].alias("class"), c["heading_level"].alias("heading_level"))


def _blueprint(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = proxies.style_rows(spark, d)
    return styles.style_index(rows), rows.where(F.col("ord") % 4 == 0).select("doc_id", F.col("name").alias("style_id")).distinct()


@query(with_("style_rows") + f", {_INDEX}, {_USED}, {_SLOTS}, {_WANTED}, {_NEAREST} SELECT w.doc_id, w.name, w.heading_level, n.slot FROM wanted w LEFT JOIN near n ON n.doc_id = w.doc_id AND n.name = w.name AND n.rn = 1 WHERE w.heading_level > 0")
def nearest_heading_level(spark, d):
    index, used = _blueprint(spark, d)
    w = _wanted(index).where("heading_level > 0").select("doc_id", F.col("name").alias("src"), "heading_level", F.col("heading_level").alias("level"))
    return styles.nearest_level(w, styles.heading_slots(index, used)).select("doc_id", F.col("src").alias("name"), "heading_level", F.col("name").alias("slot"))


@query(with_("style_rows") + f", {_INDEX}, {_WANTED} SELECT w.doc_id, w.name, (SELECT min(i.name) FROM idx i WHERE i.doc_id = w.doc_id AND lower(i.name) = lower(w.name)) AS match FROM wanted w")
def style_ci_match(spark, d):
    index, _ = _blueprint(spark, d)
    return styles.ci_match(_wanted(index).select("doc_id", "name"), index)


_RESOLVE = f"""{_NEAREST}, classes AS (SELECT doc_id, min(name) FILTER (WHERE class = 'title') AS title, min(name) FILTER (WHERE class = 'body') AS body, min(name) FILTER (WHERE class = 'footnote') AS footnote,
 min(name) FILTER (WHERE class = 'caption') AS caption, min(name) FILTER (WHERE class = 'blockquote') AS blockquote, min(name) FILTER (WHERE class = 'abstract') AS abstract, min(name) AS any_ FROM marked GROUP BY doc_id),
resolved AS (SELECT w.doc_id, w.name, w.class, w.heading_level, coalesce(CASE WHEN w.heading_level > 0 THEN n.slot END, (SELECT i.name FROM idx i WHERE i.doc_id = w.doc_id AND i.name = w.name),
 (SELECT min(i.name) FROM idx i WHERE i.doc_id = w.doc_id AND lower(i.name) = lower(w.name)),
 CASE w.class WHEN 'title' THEN coalesce(c.title, (SELECT s.name FROM slots s WHERE s.doc_id = w.doc_id AND s.level = 1)) WHEN 'footnote' THEN c.footnote WHEN 'caption' THEN c.caption WHEN 'blockquote' THEN c.blockquote WHEN 'abstract' THEN c.abstract END,
 c.body, (SELECT i.name FROM idx i WHERE i.doc_id = w.doc_id AND i.name = 'Normal'), c.any_, 'Normal') AS mapped
FROM wanted w LEFT JOIN near n ON n.doc_id = w.doc_id AND n.name = w.name AND n.rn = 1 LEFT JOIN classes c ON c.doc_id = w.doc_id)"""


@query(with_("style_rows") + f", {_INDEX}, {_USED}, {_SLOTS}, {_WANTED}, {_RESOLVE} SELECT * FROM resolved")
def style_mapper_resolve(spark, d):
    index, used = _blueprint(spark, d)
    return styles.resolve(_wanted(index), index, used).select("doc_id", "name", "class", "heading_level", "mapped")


@query(
    with_("style_rows")
    + f""", {_INDEX}, src AS (SELECT doc_id, style_id, min(name) AS name FROM (SELECT doc_id, name, 'X' || style_id AS style_id FROM idx WHERE ord % 3 <> 0) GROUP BY doc_id, style_id),
bp AS (SELECT doc_id, name, min(style_id) AS style_id FROM idx GROUP BY doc_id, name),
hop AS (SELECT r.doc_id, r.ord AS p_idx, 'X' || r.style_id AS style_id, coalesce(s.name, 'X' || r.style_id) AS name FROM style_rows r LEFT JOIN src s ON s.doc_id = r.doc_id AND s.style_id = 'X' || r.style_id),
named AS (SELECT *, CASE WHEN name = 'Quote' THEN 'Normal' WHEN name = 'caption' THEN 'nowhere' ELSE name END AS mapped FROM hop),
done AS (SELECT n.*, coalesce(b.style_id, n.mapped) AS new_id FROM named n LEFT JOIN bp b ON b.doc_id = n.doc_id AND b.name = n.mapped)
SELECT doc_id, p_idx, style_id, new_id, style_id <> new_id AS rewritten FROM done"""
)
def style_remap(spark, d):
    rows = proxies.style_rows(spark, d)
    index = styles.style_index(rows)
    paras = rows.select("doc_id", F.col("ord").alias("p_idx"), F.concat(F.lit("X"), "style_id").alias("style_id"))
    source = index.where(F.col("ord") % 3 != 0).select("doc_id", "name", F.concat(F.lit("X"), "style_id").alias("style_id"))
    mapping = index.select("doc_id").distinct().select("doc_id", F.explode(F.expr("map('Quote', 'Normal', 'caption', 'nowhere')")).alias("name", "mapped"))
    return styles.remap(paras, source, mapping, index)


# checks

_USED_VALUES = "used AS (SELECT DISTINCT (l_orderkey // 64)::BIGINT AS doc_id, 'R' || (l_partkey % 97) AS value FROM lineitem)"
_DECLARED = "declared AS (SELECT DISTINCT (l_orderkey // 64)::BIGINT AS doc_id, 'R' || (l_partkey % 89) AS value FROM lineitem WHERE l_linenumber <> 2)"
_UNDECLARED = "u AS (SELECT used.doc_id, used.value, declared.value IS NULL AS missing, row_number() OVER (PARTITION BY used.doc_id, declared.value IS NULL ORDER BY used.value) AS rn FROM used LEFT JOIN declared USING (doc_id, value))"


def _values(spark, d) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    doc = F.expr("l_orderkey div 64").alias("doc_id")
    used = li.select(doc, F.concat(F.lit("R"), (F.col("l_partkey") % 97).cast("string")).alias("value"))
    return used, li.where("l_linenumber <> 2").select(doc, F.concat(F.lit("R"), (F.col("l_partkey") % 89).cast("string")).alias("value"))


@query(
    f"""WITH {_USED_VALUES}, {_DECLARED}, {_UNDECLARED}
SELECT doc_id, 2 AS check_no, CASE WHEN bool_or(missing) THEN 'issue' ELSE 'ok' END AS severity, 0 AS seq,
CASE WHEN bool_or(missing) THEN count(*) FILTER (WHERE missing) || ' revision ids of paragraphs aren''t in the settings: ' || string_agg(value, ', ' ORDER BY value) FILTER (WHERE missing AND rn <= 4) ELSE count(*) || ' revision ids, all in the settings' END AS message FROM u GROUP BY doc_id"""
)
def check_rsids(spark, d):
    return checks.check_rsids(*_values(spark, d))


@query(
    f"""WITH {_USED_VALUES}, {_DECLARED}, {_UNDECLARED}
SELECT doc_id, 7 AS check_no, CASE WHEN bool_or(missing) THEN 'issue' ELSE 'ok' END AS severity, 0 AS seq,
CASE WHEN bool_or(missing) THEN 'References without a relationship: ' || string_agg(value, ', ' ORDER BY value) FILTER (WHERE missing) ELSE count(*) || ' references, all with a relationship' END AS message FROM u GROUP BY doc_id"""
)
def check_inline_rids(spark, d):
    return checks.check_inline_rids(*_values(spark, d))


def _unique_sql(no: int, what: str, ids: str) -> str:
    return f"""WITH ids AS ({ids}), g AS (SELECT doc_id, id, count(*) AS n FROM ids GROUP BY doc_id, id HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS rn FROM g)
SELECT doc_id, {no} AS check_no, 'issue' AS severity, (rn - 1)::INTEGER AS seq, '{what} ' || id || ' occurs ' || n || ' times' AS message FROM r WHERE rn <= 3
UNION ALL SELECT doc_id, {no}, 'ok', 0, count(*) || ' of {what}, no two alike' FROM ids WHERE doc_id NOT IN (SELECT doc_id FROM g) GROUP BY doc_id"""


@query(_unique_sql(3, "paragraph id", "SELECT l_orderkey AS doc_id, 'P' || (l_partkey % 40) AS id FROM lineitem"))
def check_para_ids(spark, d):
    return checks.check_para_ids(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("id"), F.col("l_linestatus").alias("part")))


@query(_unique_sql(6, "bookmark id", "SELECT o_custkey AS doc_id, 'B' || (o_orderkey % 23) AS id FROM orders"))
def check_bookmark_ids(spark, d):
    return checks.check_bookmark_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("B"), (F.col("o_orderkey") % 23).cast("string")).alias("id"), F.lit("d").alias("part")))


@query(
    f"""WITH rels AS (SELECT page_id // 4 AS doc_id, page_id, 'word/_rels/document.xml.rels' AS rels_part, {_TARGET} AS target, {_RESOLVED} AS part_name FROM pages WHERE page_id % 9 <> 0),
p AS (SELECT DISTINCT page_id // 4 AS doc_id, unnest(['word/styles.xml', 'word/settings.xml', 'x' || page_id]) AS part_name FROM pages),
gone AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rels_part, target) AS rn FROM rels r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.part_name = r.part_name))
SELECT doc_id, 4 AS check_no, 'issue' AS severity, (rn - 1)::INTEGER AS seq, rels_part || ' points to ' || target || ' (' || part_name || '), which isn''t there' AS message FROM gone WHERE rn <= 5
UNION ALL SELECT DISTINCT doc_id, 4, 'ok', 0, 'All relationship targets are there' FROM p WHERE doc_id NOT IN (SELECT doc_id FROM gone)"""
)
def check_rel_targets(spark, d):
    p = table(spark, d, "pages")
    doc = F.expr("page_id div 4").alias("doc_id")
    rels = p.select(doc, F.lit("word/_rels/document.xml.rels").alias("rels_part"), _target(F.col("page_id")).alias("target"), F.when(F.col("page_id") % 9 == 0, "External").alias("target_mode"))
    there = p.select(doc, F.explode(F.array(F.lit("word/styles.xml"), F.lit("word/settings.xml"), F.concat(F.lit("x"), F.col("page_id").cast("string")))).alias("part_name")).distinct()
    return checks.check_rel_targets(rels, there)


@query(
    with_("items") + """, c AS (SELECT l_orderkey AS doc_id, n AS ord, CASE l_suppkey % 29 WHEN 0 THEN 'w:sdt' WHEN 1 THEN 'w:sectPr' WHEN 2 THEN 'w:tbl' ELSE 'w:p' END AS tag FROM items),
g AS (SELECT doc_id, string_agg(DISTINCT tag, ', ') FILTER (WHERE tag = 'w:sdt') AS bad, (array_agg(tag ORDER BY ord DESC))[1] AS last, bool_or(tag = 'w:sectPr') AS section, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, 5 AS check_no, CASE WHEN bad IS NOT NULL OR (section AND last <> 'w:sectPr') THEN 'issue' ELSE 'ok' END AS severity, 0 AS seq,
CASE WHEN bad IS NOT NULL THEN 'Tags that don''t belong in the body: ' || bad WHEN section AND last <> 'w:sectPr' THEN 'The section properties of the body aren''t its last child' ELSE n || ' children of the body' END AS message FROM g"""
)
def check_body_structure(spark, d):
    k = F.col("l_suppkey") % 29
    return checks.check_body_structure(proxies.items(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("ord"), F.when(k == 0, "w:sdt").when(k == 1, "w:sectPr").when(k == 2, "w:tbl").otherwise("w:p").alias("tag")))


@query("SELECT l_orderkey AS doc_id, (max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey END) + 1)::BIGINT AS next_id FROM lineitem GROUP BY l_orderkey")
def next_rid(spark, d):
    rid = F.when(F.col("l_linenumber") % 3 == 0, F.lit("other7")).otherwise(F.concat(F.lit("rId"), F.col("l_partkey").cast("string")))
    return checks.next_rid(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), rid.alias("id")))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def dangling_notes(spark, d):
    """Orders as references, customers as the notes that there are."""
    defined = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.lit(0).alias("doc_id"), F.col("c_custkey").alias("note_id"))
    orders = table(spark, d, "orders").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("note_id"), "o_orderkey")
    return notes.dangling(orders, defined).select(F.col("note_id").alias("o_custkey"), "o_orderkey")


# notes

_CITED = "cited_lines AS (SELECT doc_id, p_idx, 0 AS r_idx, text || ' [' || (doc_id % 5) || '] tail [' || (p_idx % 9) || ']' AS text FROM lines)"
_NOTES = "notes AS (SELECT DISTINCT doc_id, unnest([1, 2, 3, 77]::BIGINT[]) AS note_id FROM documents)"


def _cited(spark, d) -> tuple[DataFrame, DataFrame]:
    t = F.concat("text", F.lit(" ["), (F.col("doc_id") % 5).cast("string"), F.lit("] tail ["), (F.col("p_idx") % 9).cast("string"), F.lit("]"))
    runs = proxies.lines(spark, d).select("doc_id", "p_idx", F.lit(0).alias("r_idx"), t.alias("text"))
    return runs, table(spark, d, "documents").select("doc_id", F.explode(F.expr("array(1L, 2L, 3L, 77L)")).alias("note_id")).distinct()


@query(with_("lines") + f", {_CITED}, {_NOTES}, found AS (SELECT doc_id, p_idx, r_idx, unnest(range(len(m)))::INTEGER AS seq, unnest(m)::BIGINT AS note_id FROM (SELECT doc_id, p_idx, r_idx, regexp_extract_all(text, '\\[([0-9]+)\\]', 1) AS m FROM cited_lines)) SELECT f.* FROM found f JOIN notes USING (doc_id, note_id)")
def find_markers(spark, d):
    return notes.find_markers(*_cited(spark, d))


@query(with_("lines") + f", {_CITED}, {_NOTES}, c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\[([0-9]+)\\]', 1))::BIGINT AS note_id FROM cited_lines) SELECT doc_id, note_id, CASE WHEN n.doc_id IS NULL THEN 'unknown' WHEN c.doc_id IS NULL THEN 'unused' ELSE 'cited' END AS status FROM c FULL JOIN notes n USING (doc_id, note_id)")
def note_ref_reconcile(spark, d):
    return notes.reconcile(*_cited(spark, d))


@query(
    with_("lines")
    + f""", {_CITED}, {_NOTES}, refs AS (SELECT doc_id, p_idx, 0 AS k, doc_id % 5 AS note_id FROM cited_lines UNION ALL SELECT doc_id, p_idx, 1, p_idx % 9 FROM cited_lines),
known AS (SELECT r.* FROM refs r JOIN notes n ON n.doc_id = r.doc_id AND n.note_id = r.note_id),
g AS (SELECT doc_id, note_id, count(*) AS n_refs, min(p_idx * 2 + k) AS first_at FROM known GROUP BY doc_id, note_id)
SELECT doc_id, note_id::BIGINT AS note_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at)::INTEGER AS n, n_refs FROM g"""
)
def inject_footnotes(spark, d):
    return notes.injection_order(notes.split_at_markers(*_cited(spark, d)))


def _note_runs(spark, d) -> DataFrame:
    """Line items as the runs of an order's note; the first run is the marker, the second the separator or the text."""
    n, k, v = F.col("n"), F.col("l_orderkey"), F.col("l_partkey") % 4
    return proxies.items(spark, d).select(
        F.expr("l_orderkey div 64").alias("doc_id"), k.alias("note_id"), n.cast("int").alias("r_idx"), (n == 1).alias("is_marker"), ((n == 2) & (v == 0)).alias("has_tab"),
        F.when((n == 2) & (v == 1), " ").when((n == 2) & (v == 2), "").otherwise("text").alias("text"), F.when(v > 0, F.concat(F.lit("rpr"), v.cast("string"))).alias("format"),
    )


_NOTE_RUNS = """note_runs AS (SELECT (l_orderkey // 64)::BIGINT AS doc_id, l_orderkey AS note_id, n::INTEGER AS r_idx, n = 1 AS is_marker, n = 2 AND l_partkey % 4 = 0 AS has_tab,
 CASE WHEN n = 2 AND l_partkey % 4 = 1 THEN ' ' WHEN n = 2 AND l_partkey % 4 = 2 THEN '' ELSE 'text' END AS text, CASE WHEN l_partkey % 4 > 0 THEN 'rpr' || (l_partkey % 4) END AS format FROM items)"""


@query(
    f"""WITH {proxies.SQL['items']}, {_NOTE_RUNS}, ids AS (SELECT DISTINCT doc_id, note_id FROM note_runs WHERE note_id > 0), three AS (SELECT doc_id, note_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY note_id) AS rn FROM ids) WHERE rn <= 3),
nexts AS (SELECT *, lead(has_tab) OVER w AS nt, lead(text) OVER w AS nx FROM note_runs SEMI JOIN three USING (doc_id, note_id) WINDOW w AS (PARTITION BY doc_id, note_id ORDER BY r_idx)),
s AS (SELECT doc_id, note_id, format, CASE WHEN nt IS NULL THEN NULL WHEN nt THEN chr(9) WHEN trim(nx) = '' THEN nx ELSE '' END AS sep FROM nexts WHERE is_marker)
SELECT doc_id, arg_min(format, note_id) FILTER (WHERE format IS NOT NULL) AS marker_format, coalesce(arg_min(sep, note_id) FILTER (WHERE sep IS NOT NULL), '') AS separator FROM s GROUP BY doc_id"""
)
def footnote_format(spark, d):
    return notes.footnote_format(_note_runs(spark, d))


@query(
    f"""WITH {proxies.SQL['items']}, {_NOTE_RUNS}, nexts AS (SELECT *, lead(has_tab) OVER w AS nt, lead(text) OVER w AS nx FROM note_runs WHERE note_id > 0 WINDOW w AS (PARTITION BY doc_id, note_id ORDER BY r_idx)),
m AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ' ' ELSE '' END AS sep FROM nexts WHERE is_marker)
SELECT doc_id, note_id, r_idx, CASE WHEN nt IS NULL OR NOT (nt OR trim(nx) = '') THEN CASE WHEN sep <> '' THEN 'insert' ELSE 'keep' END WHEN sep = '' THEN 'strip' WHEN (nt AND sep = chr(9)) OR (NOT nt AND nx = sep) THEN 'keep' ELSE 'replace' END AS action FROM m"""
)
def footnote_separator_normalize(spark, d):
    runs = _note_runs(spark, d)
    wanted = runs.select("doc_id").distinct().withColumn("separator", F.when(F.col("doc_id") % 3 == 0, "\t").when(F.col("doc_id") % 3 == 1, " ").otherwise(""))
    return notes.normalize_separators(runs, wanted)


# alignment


@query(with_("tokens", "sim") + "SELECT * FROM sim")
def cosine_matrix(spark, d):
    return alignment.cosine_matrix(proxies.tokens(spark, d))


_FWD = "fwd AS (SELECT pair_id, src, tgt, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, src ORDER BY sim DESC, tgt DESC) AS rn FROM sim) WHERE rn = 1)"
_BWD = "bwd AS (SELECT pair_id, src, tgt, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, tgt ORDER BY sim DESC, src) AS rn FROM sim) WHERE rn = 1)"


@query(with_("tokens", "sim") + f", {_FWD} SELECT * FROM fwd")
def argmax_src_to_tgt(spark, d):
    return alignment.argmax_source(alignment.cosine_matrix(proxies.tokens(spark, d)))


@query(with_("tokens", "sim") + f", {_BWD} SELECT * FROM bwd")
def argmax_tgt_to_src(spark, d):
    return alignment.argmax_target(alignment.cosine_matrix(proxies.tokens(spark, d)))


@query(with_("tokens", "sim") + f", {_FWD}, {_BWD} SELECT f.* FROM fwd f JOIN bwd b USING (pair_id, src, tgt)")
def align_intersection(spark, d):
    return alignment.intersection(alignment.cosine_matrix(proxies.tokens(spark, d)))


@query(with_("tokens", "sim") + f", {_FWD}, {_BWD}, o AS (SELECT pair_id, src, tgt, true AS f FROM fwd), p AS (SELECT pair_id, src, tgt, true AS b FROM bwd) SELECT pair_id, src, tgt, CASE WHEN f AND b THEN 'both' WHEN f THEN 'forward' ELSE 'backward' END AS kind FROM o FULL JOIN p USING (pair_id, src, tgt)")
def edge_set_ops(spark, d):
    sim = alignment.cosine_matrix(proxies.tokens(spark, d))
    f, b = (x.select("pair_id", "src", "tgt") for x in (alignment.argmax_source(sim), alignment.argmax_target(sim)))
    both = f.intersect(b).withColumn("kind", F.lit("both"))
    return both.unionByName(f.subtract(b).withColumn("kind", F.lit("forward"))).unionByName(b.subtract(f).withColumn("kind", F.lit("backward")))


@query(with_("tokens", "sim", "greedy") + "SELECT * FROM matching")
def align_itermax(spark, d):
    return alignment.itermax(alignment.cosine_matrix(proxies.tokens(spark, d)), 0.0)


@query(with_("tokens") + "SELECT pair_id, side, tok_idx, token FROM tokens WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]', '[MASK]', '<s>', '</s>', '<pad>', '<unk>', '<mask>')")
def drop_special_tokens(spark, d):
    return alignment.without_special(proxies.tokens(spark, d)).select("pair_id", "side", "tok_idx", "token")


@query(with_("tokens", "word_tokens") + "SELECT pair_id, side, w_idx, string_agg(piece, '' ORDER BY tok_idx) AS text, count(*) AS n_tokens FROM word_tokens GROUP BY pair_id, side, w_idx")
def subword_grouping(spark, d):
    return alignment.word_texts(alignment.words(proxies.tokens(spark, d)))


_WORD_EDGES = """edges_ AS (SELECT m.pair_id, s.w_idx AS src_word, t.w_idx AS tgt_word, max(m.sim) AS sim FROM matching m JOIN word_tokens s ON s.pair_id = m.pair_id AND s.side = 'src' AND s.tok_idx = m.src
 JOIN word_tokens t ON t.pair_id = m.pair_id AND t.side = 'tgt' AND t.tok_idx = m.tgt GROUP BY ALL)"""


@query(with_("tokens", "sim", "greedy", "word_tokens") + f", {_WORD_EDGES} SELECT * FROM edges_")
def word_edges(spark, d):
    t = proxies.tokens(spark, d)
    return alignment.word_edges(alignment.itermax(alignment.cosine_matrix(t), 0.0), alignment.words(t))


@query(with_("tokens", "sim", "greedy", "word_tokens") + f", {_WORD_EDGES} SELECT pair_id, count(*) AS n_edges, round(avg(sim), 4) AS mean_sim FROM edges_ GROUP BY pair_id")
def align_texts(spark, d):
    e = alignment.align(proxies.tokens(spark, d), min_sim=0.0)
    return e.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("sim"), 4).alias("mean_sim"))


# formats

_WHOLE = "whole AS (SELECT pair_id, string_agg(text, '' ORDER BY r_idx) AS text FROM turns GROUP BY pair_id)"


def _spans(name: str, texts: str) -> str:
    return f"""{name}_p AS (SELECT pair_id, unnest(range(len(m))) AS k, unnest(m) AS word FROM (SELECT pair_id, regexp_extract_all(text, '([^\\s]+|\\s+)') AS m FROM {texts})),
{name}_s AS (SELECT *, sum(length(word)) OVER (PARTITION BY pair_id ORDER BY k) AS stop FROM {name}_p),
{name} AS (SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY k) - 1)::INTEGER AS w_idx, (stop - length(word))::INTEGER AS start, stop::INTEGER AS stop, word FROM {name}_s WHERE regexp_matches(word, '[^\\s]'))"""


_RUN_SPANS = "run_spans AS (SELECT *, (sum(length(text)) OVER (PARTITION BY pair_id ORDER BY r_idx))::INTEGER AS stop FROM turns)"
_MAJORITY = """majority AS (SELECT pair_id, w_idx, r_idx, format FROM (SELECT w.pair_id, w.w_idx, r.r_idx, r.format, row_number() OVER (PARTITION BY w.pair_id, w.w_idx ORDER BY least(w.stop, r.stop) - greatest(w.start, r.stop - length(r.text)) DESC, r.r_idx DESC) AS rn
 FROM src_words w JOIN run_spans r ON r.pair_id = w.pair_id AND r.stop - length(r.text) < w.stop AND w.start < r.stop) WHERE rn = 1)"""
_TRANSLATED = "translated AS (SELECT pair_id, string_agg(w, ' ' ORDER BY k DESC) || '  ' AS text FROM (SELECT pair_id, unnest(range(len(m))) AS k, unnest(m) AS w FROM (SELECT pair_id, string_split(text, ' ') AS m FROM whole)) GROUP BY pair_id)"
_EDGES = "word_links AS (SELECT s.pair_id, s.w_idx AS src_word, (s.w_idx * 2) AS tgt_word FROM src_words s WHERE s.w_idx % 3 <> 0)"


def _translations(spark, d) -> DataFrame:
    whole = formatting.whole_text(proxies.turns(spark, d))
    return whole.select("pair_id", F.concat(F.array_join(F.reverse(F.split("text", " ")), " "), F.lit("  ")).alias("text"))


def _links(spark, d) -> DataFrame:
    s = formatting.word_spans(formatting.whole_text(proxies.turns(spark, d))).where(F.col("w_idx") % 3 != 0)
    return s.select("pair_id", F.col("w_idx").alias("src_word"), (F.col("w_idx") * 2).alias("tgt_word"))


@query(with_("turns") + f", {_WHOLE}, {_spans('src_words', 'whole')} SELECT * FROM src_words")
def word_spans(spark, d):
    return formatting.word_spans(formatting.whole_text(proxies.turns(spark, d)))


@query(with_("turns") + f", {_WHOLE}, {_spans('src_words', 'whole')}, {_RUN_SPANS}, {_MAJORITY} SELECT * FROM majority")
def word_majority_format(spark, d):
    return formatting.majority_format(proxies.turns(spark, d))


_FILL = """direct AS (SELECT l.pair_id, l.tgt_word AS w_idx, arg_min(m.format, l.src_word) AS f FROM word_links l JOIN majority m ON m.pair_id = l.pair_id AND m.w_idx = l.src_word GROUP BY ALL),
filled AS (SELECT t.pair_id, t.w_idx, t.start, t.stop, coalesce(d.f, last_value(d.f IGNORE NULLS) OVER (PARTITION BY t.pair_id ORDER BY t.w_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 first_value(d.f IGNORE NULLS) OVER (PARTITION BY t.pair_id ORDER BY t.w_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS format FROM tgt_words t LEFT JOIN direct d USING (pair_id, w_idx))"""
_TO_FILL = with_("turns") + f", {_WHOLE}, {_spans('src_words', 'whole')}, {_RUN_SPANS}, {_MAJORITY}, {_TRANSLATED}, {_spans('tgt_words', 'translated')}, {_EDGES}, {_FILL}"


@query(_TO_FILL + " SELECT pair_id, w_idx, format FROM filled")
def format_fill(spark, d):
    return formatting.fill_formats(formatting.word_spans(_translations(spark, d)), _links(spark, d), formatting.majority_format(proxies.turns(spark, d))).select("pair_id", "w_idx", "format")


_MERGE = """, cuts AS (SELECT *, CASE WHEN lag(w_idx) OVER w IS NULL OR format IS DISTINCT FROM lag(format) OVER w THEN 1 ELSE 0 END AS c, CASE WHEN lag(w_idx) OVER w IS NULL THEN 0 ELSE start END AS a, coalesce(lead(start) OVER w, 1000000000) AS z FROM filled WINDOW w AS (PARTITION BY pair_id ORDER BY w_idx)),
islands AS (SELECT *, sum(c) OVER (PARTITION BY pair_id ORDER BY w_idx) AS r FROM cuts),
merged AS (SELECT pair_id, r, min(a) AS a, max(z) AS z, min(format) AS format FROM islands GROUP BY pair_id, r)
SELECT t.pair_id, coalesce(m.r - 1, 0)::INTEGER AS r_idx, CASE WHEN m.r IS NULL THEN t.text ELSE substring(t.text, (m.a + 1)::INTEGER, (m.z - m.a)::INTEGER) END AS text, m.format FROM translated t LEFT JOIN merged m USING (pair_id) WHERE t.text <> ''"""


@query(_TO_FILL + _MERGE)
def format_merge_runs(spark, d):
    t = _translations(spark, d)
    filled = formatting.fill_formats(formatting.word_spans(t), _links(spark, d), formatting.majority_format(proxies.turns(spark, d)))
    return formatting.merge_runs(t, filled)


@query(_TO_FILL + _MERGE)
def transfer_format(spark, d):
    return formatting.transfer(proxies.turns(spark, d), _translations(spark, d), _links(spark, d))


# translation

#: Input, name and code, written down by hand.
_LANGUAGES = """de|German|de;German|German|de;Klingon|Klingon|Klingon;Deutsch|Deutsch|de;français|français|fr;中文|中文|zh;xx|xx|xx;EN|English|en;Tiếng Việt|Tiếng Việt|vi;русский|русский|ru
; German |German|de; fr |French|fr;en|English|en;es|Spanish|es;fr|French|fr;it|Italian|it;日本語|日本語|ja;Castellano|Castellano|es;norsk|norsk|no;abcd|abcd|abcd;|| ;zh|Chinese|zh;pt |Portuguese|pt""".replace("\n", "").split(";")
_LANGUAGES = [x.split("|") for x in _LANGUAGES if x != "|| "]


@query("SELECT * FROM (VALUES " + ", ".join("({})".format(", ".join(f"'{y}'" for y in x)) for x in _LANGUAGES) + ") AS t(input, name, code)")
def language_parse(spark, d):
    given = spark.range(1).select(F.explode(F.array(*(F.lit(x[0]) for x in _LANGUAGES))).alias("input"))
    p = languages.parse_language(F.col("input"))
    return given.select("input", p["name"].alias("name"), p["code"].alias("code"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x[0]}', '{x[2]}')" for x in _LANGUAGES) + ") AS t(input, code)")
def language_code(spark, d):
    given = spark.range(1).select(F.explode(F.array(*(F.lit(x[0]) for x in _LANGUAGES))).alias("input"))
    return given.select("input", languages.language_code(F.col("input")).alias("code"))


@query("SELECT page_id, md5(CASE WHEN length(html) > 400 THEN substring(html, 1, 400) || '…' ELSE html END) AS short FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE substring(html, 1, 400) END AS html FROM pages)")
def shortened_errors(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.substring("html", 1, 400))
    return table(spark, d, "pages").select("page_id", F.md5(text.shortened(html).cast("binary")).alias("short"))


@query(f"SELECT item_id, 'Translate from English into German. {languages.STYLES['fluent']} Answer with the translation only.' || chr(10) || chr(10) || text AS prompt FROM benchmark")
def build_prompt(spark, d):
    return table(spark, d, "benchmark").select("item_id", languages.build_prompt(F.col("text"), F.lit("English"), F.lit("German"), "fluent").alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE trim(text) END AS text FROM conversations")
def parse_provider_json(spark, d):
    c = table(spark, d, "conversations")
    reply = F.when(F.col("role") == "user", F.lit('{"choices": []}')).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))))
    return c.select("conv_id", "turn", translation.reply_text(reply, "chat").alias("text"))


@query("SELECT 'p' || (p_partkey % 3) AS provider, p_name AS id, CASE WHEN p_size % 2 = 0 THEN 'ctx: ' || p_size ELSE 'Available' END AS capabilities FROM part WHERE p_size % 7 <> 0")
def list_models(spark, d):
    p = table(spark, d, "part")
    model = F.struct(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_name")).alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("context_window"))
    replies = p.select(F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("provider"), F.to_json(F.struct(F.array(model).alias("data"))).alias("reply"))
    return translation.list_models(replies, "chat")


_REVERSED = "'[de] ' || array_to_string(list_reverse(string_split(text, ' ')), ' ')"


@query(with_("lines") + f"SELECT doc_id, p_idx, CASE WHEN trim(text) <> '' THEN {_REVERSED} END AS translated FROM lines")
def mock_translate(spark, d):
    """The plug-in path: batches to Python and back."""
    return translation.translate(proxies.lines(spark, d), [translation.MockProvider()], "en", "de").select("doc_id", "p_idx", "translated")


@query(with_("lines") + f"SELECT doc_id, p_idx, CASE WHEN trim(text) = '' THEN NULL WHEN NOT contains(text, 'a') THEN 'first' WHEN NOT contains(text, 'e') THEN 'second' END AS provider, CASE WHEN trim(text) <> '' AND NOT (contains(text, 'a') AND contains(text, 'e')) THEN {_REVERSED} END AS translated, CASE WHEN trim(text) <> '' AND contains(text, 'a') AND contains(text, 'e') THEN 'second refuses' END AS error FROM lines")
def provider_fallback(spark, d):
    chain = [translation.MockProvider("first", refuses="a"), translation.MockProvider("second", refuses="e")]
    return translation.translate(proxies.lines(spark, d), chain, "en", "de").select("doc_id", "p_idx", "provider", "translated", "error")


@query(with_("lines") + f"SELECT doc_id, p_idx, CASE WHEN trim(text) = '' THEN NULL WHEN contains(text, 'the') THEN 'b' ELSE 'a' END AS provider, CASE WHEN trim(text) <> '' THEN md5({_REVERSED}) END AS translated FROM lines")
def translate_batch(spark, d):
    chain = [translation.MockProvider("a", refuses="the"), translation.MockProvider("b")]
    return translation.translate(proxies.lines(spark, d), chain, "en", "de", concurrency=8).select("doc_id", "p_idx", "provider", _md5("translated"))


@query(with_("lines") + f"SELECT doc_id, p_idx, md5(CASE WHEN p_idx % 4 <> 0 THEN {_REVERSED} ELSE text END) AS text, p_idx % 4 <> 0 AS changed FROM lines")
def translation_writeback(spark, d):
    p = proxies.lines(spark, d)
    done = p.withColumn("translated", F.when(F.col("p_idx") % 4 != 0, translation.mock_translation(F.col("text"), "de")))
    return translation.write_back(p, done).select("doc_id", "p_idx", _md5("text"), "changed")


@query(with_("lines") + "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE trim(text) <> '' AND NOT contains(text, 'the')) AS n_ok, count(*) FILTER (WHERE trim(text) <> '' AND contains(text, 'the')) AS n_failed FROM lines GROUP BY doc_id")
def translation_summary(spark, d):
    return translation.summary(translation.translate(proxies.lines(spark, d), [translation.MockProvider("a", refuses="the")], "en", "de"))


# whole packages: made of documents, taken apart and put together again in Python workers


def made_packages(spark: SparkSession, d: str) -> DataFrame:
    """A package for each document, its lines as paragraphs, every third line bold, its defaults by its id; parts as rows."""
    made, W = X.made, f'xmlns:w="{X.MAIN}" xmlns:w14="{X.WORD_2010}"'

    def line(t: Column, i: Column) -> Column:
        kept = made("color", val="FF0000")
        props = F.when(i % 3 == 0, made("b") + made("sz", val=36) + kept).otherwise(made("sz", val=24) + kept)
        styled = F.when(i == 0, made("pPr", made("pStyle", val="Heading1"))).otherwise(made("pPr", made("pStyle", val="Normal")))
        shell = made("p", "|", made("r", made("rPr", "|"), made("t", "|", space=True)), rsidR="00A1").split("|")
        head = F.concat(F.lit(shell[0][:-1] + ' w14:paraId="'), F.lpad(F.hex(i + 1), 8, "0"), F.lit('">'))
        return F.concat(head, styled, F.lit(shell[1]), props, F.lit(shell[2]), text.escape_xml(t), F.lit(shell[3]))

    body = F.array_join(F.transform(F.split("text", "\n"), line), "")
    section = made("sectPr", made("pgSz", w=12240, h=15840), made("pgMar", top=1440, left=1800))
    head, tail = made("document", made("body", "|", section)).replace("<w:document", f"<w:document {W}").split("|")
    doc = F.concat(F.lit('<?xml version="1.0"?>' + head), body, F.lit(tail))

    def style(sid: str, name: str, more: str = "") -> str:
        return made("style", made("name", val=name), more, type="paragraph", styleId=sid)

    kept = "|" + style("Normal", "Normal") + style("Heading1", "heading 1", made("outlineLvl", val=0))
    sheet = [F.lit(x) for x in made("styles", kept).replace("<w:styles", f"<w:styles {W}").split("|")]
    font, size = made("rFonts", ascii="Calibri"), made("sz", val=22)
    own = [F.lit(made("docDefaults", made("rPrDefault", made("rPr", x)))) for x in (font + size, size)]
    n = F.col("doc_id")
    sheet = F.concat(sheet[0], F.when(n % 3 == 0, own[0]).when(n % 3 == 1, own[1]).otherwise(F.lit("")), sheet[1])
    rels = f'<Relationships xmlns="{X.PACKAGE_RELATIONS}"><Relationship Id="rId1" Type="styles" Target="styles.xml"/></Relationships>'
    rows = F.array(*(F.struct(F.lit(k).alias("part_ord"), F.lit(n).alias("part_name"), c.alias("data")) for k, (n, c) in enumerate([(packages.CONTENT_TYPES, F.lit("<Types/>")), (packages.DOCUMENT, doc), (packages.RELS, F.lit(rels)), (packages.STYLES, sheet)])))
    docs = tables.spread(table(spark, d, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.inline(rows)).withColumn("data", F.encode("data", "UTF-8"))


_W = f'xmlns:w="{X.MAIN}" xmlns:w14="{X.WORD_2010}"'
_HEAD = f'<?xml version="1.0"?><w:document {_W}><w:body>'
_TAIL = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:left="1800"/></w:sectPr></w:body></w:document>'
_IDS = """' w:rsidR="00A1" w14:paraId="' || printf('%08X', p_idx + 1) || '"'"""
_PPR = """'<w:pPr><w:pStyle w:val="' || CASE WHEN p_idx = 0 THEN 'Heading1' ELSE 'Normal' END || '"/></w:pPr>'"""
_RPR = """'<w:rPr>' || CASE WHEN p_idx % 3 = 0 THEN '<w:b/><w:sz w:val="36"/>' ELSE '<w:sz w:val="24"/>' END || '<w:color w:val="FF0000"/></w:rPr>'"""
_NO_BOLD = _RPR.replace("<w:b/>", "")
_CLEAN = """'<w:rPr>' || CASE WHEN p_idx % 3 = 0 THEN '<w:b/>' ELSE '' END || '</w:rPr>'"""


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_TEXT = f"""'<w:t xml:space="preserve">' || {_escaped('text')} || '</w:t>'"""


def _rebuilt(c: str) -> str:
    """A text element as it is written for new text."""
    return f"""CASE WHEN {c} = '' THEN '' ELSE CASE WHEN regexp_matches({c}, '^[ \\t\\n\\r]|[ \\t\\n\\r]$') THEN '<w:t xml:space="preserve">' ELSE '<w:t>' END || {_escaped(c)} || '</w:t>' END"""


def _xml(ids: str = _IDS, rpr: str = _RPR, text: str = _TEXT, head: str = _HEAD, tail: str = _TAIL) -> str:
    """DuckDB: the document part of each made package, as docs(doc_id, xml)."""
    para = f"'<w:p' || {ids} || '>' || {_PPR} || '<w:r>' || {rpr} || {text} || '</w:r></w:p>'"
    return f"docs AS (SELECT doc_id::VARCHAR AS doc_id, doc_id AS n, count(*) AS n_paras, '{head}' || string_agg({para}, '' ORDER BY p_idx) || '{tail}' AS xml FROM lines GROUP BY doc_id)"


_SHEET = f"""'<w:styles {_W}>' || CASE n % 3 WHEN 0 THEN '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>' WHEN 1 THEN '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>' ELSE '' END
 || '<w:style w:type="paragraph" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:outlineLvl w:val="0"/></w:style></w:styles>'"""
_RELS = f"""'<Relationships xmlns="{X.PACKAGE_RELATIONS}"><Relationship Id="rId1" Type="styles" Target="styles.xml"/></Relationships>'"""
_PARTS = f""", made AS (SELECT doc_id, 0 AS part_ord, '[Content_Types].xml' AS part_name, '<Types/>' AS data FROM docs UNION ALL SELECT doc_id, 1, 'word/document.xml', xml FROM docs
 UNION ALL SELECT doc_id, 2, 'word/_rels/document.xml.rels', {_RELS} FROM docs UNION ALL SELECT doc_id, 3, 'word/styles.xml', {_SHEET} FROM docs)"""


def _document(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part_name") == packages.DOCUMENT).select("doc_id", *[c for c in ("n_changed",) if c in parts.columns], _md5("data"))


@query(with_("lines") + "SELECT doc_id::VARCHAR AS doc_id, p_idx, '[' || lpad(p_idx::VARCHAR, greatest(3, length(p_idx::VARCHAR))::INTEGER, '0') || '] ' || text AS line FROM lines")
def dry_run_dump(spark, d):
    return documents.dump(made_packages(spark, d))


@query(with_("lines") + "SELECT doc_id::VARCHAR AS doc_id, p_idx, md5(text) AS text FROM lines")
def paragraph_texts(spark, d):
    return documents.paragraph_texts(made_packages(spark, d)).select("doc_id", "p_idx", _md5("text"))


@query(with_("lines") + f"SELECT doc_id::VARCHAR AS doc_id, p_idx, {_PPR} AS ppr_xml, 1 AS n_runs FROM lines")
def paragraph_index(spark, d):
    return documents.paragraphs(made_packages(spark, d)).select("doc_id", "p_idx", "ppr_xml", "n_runs")


@query(with_("lines") + f"SELECT doc_id::VARCHAR AS doc_id, p_idx, 0 AS r_idx, md5(text) AS text, {_RPR} AS rpr_xml, 0 AS n_refs FROM lines")
def paragraph_runs(spark, d):
    return documents.paragraph_runs(made_packages(spark, d)).select("doc_id", "p_idx", "r_idx", _md5("text"), "rpr_xml", F.size("note_refs").alias("n_refs"))


def _event_packages(spark: SparkSession, d: str) -> DataFrame:
    """A package for each user, one paragraph with their events as its children: purchases are runs with a text box of two runs, clicks bookmark starts, views bookmark ends."""
    e = table(spark, d, "events")
    box = X.made("r", X.made("pict", X.made("p", X.made("r", X.made("t", "in")), X.made("r", X.made("t", "box")))), X.made("t", "|")).split("|")
    child = F.when(F.col("event_type") == "purchase", F.concat(F.lit(box[0]), F.col("event_id").cast("string"), F.lit(box[1])))
    child = child.when(F.col("event_type") == "click", F.concat(F.lit('<w:bookmarkStart w:id="'), F.col("event_id").cast("string"), F.lit('"/>')))
    child = child.when(F.col("event_type") == "view", F.concat(F.lit('<w:bookmarkEnd w:id="'), F.col("event_id").cast("string"), F.lit('"/>'))).otherwise(F.lit(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", child.alias("x")))), lambda x: x.x), "")
    xml = F.concat(F.lit(f"<w:document {_W}><w:body><w:p>"), body, F.lit("</w:p></w:body></w:document>"))
    return e.groupBy(F.col("user_id").cast("string").alias("doc_id")).agg(F.encode(xml, "UTF-8").alias("data")).select("doc_id", F.lit(0).alias("part_ord"), F.lit(packages.DOCUMENT).alias("part_name"), "data")


@query(
    """WITH counted AS (SELECT user_id::VARCHAR AS doc_id, event_id AS ord, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT doc_id, ord, CASE WHEN event_type = 'click' AND before = 0 THEN 'leading' ELSE 'trailing' END AS place FROM counted WHERE event_type IN ('click', 'view')"""
)
def bookmark_framing(spark, d):
    p = documents.paragraphs(_event_packages(spark, d))
    sides = F.explode(F.array(*(F.struct(F.col(c).alias("marks"), F.lit(side).alias("place")) for c, side in (("leading_bookmark_starts", "leading"), ("trailing_bookmark_ends", "trailing")))))
    marks = p.select("doc_id", sides.alias("s")).select("doc_id", F.explode("s.marks").alias("mark"), "s.place")
    return marks.select("doc_id", F.regexp_extract("mark", '"([0-9]+)"', 1).cast("bigint").alias("ord"), "place")


@query("SELECT user_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS r_idx, 'inbox' || event_id AS text FROM events WHERE event_type = 'purchase'")
def top_level_runs(spark, d):
    """Runs inside of a run belong to it."""
    return documents.paragraph_runs(_event_packages(spark, d)).select("doc_id", "r_idx", "text")


@query(with_("lines") + f", {_xml()} SELECT doc_id, md5('{_HEAD}') AS head, md5(substr(xml, {len(_HEAD) + 1}, length(xml) - {len(_HEAD) + len(_TAIL)})) AS body, '{_TAIL.removesuffix('</w:body></w:document>')}' AS section, '</w:body></w:document>' AS tail FROM docs")
def body_slice(spark, d):
    return documents.body_slices(made_packages(spark, d)).select("doc_id", _md5("head"), _md5("body"), "section", "tail")


@query(with_("lines") + ", docs AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Calibri' ELSE 'Times New Roman' END AS default_font, CASE WHEN doc_id % 3 = 2 THEN 12.0 ELSE 11.0 END::DOUBLE AS default_size, 1::BIGINT AS n_sections, 2::BIGINT AS n_styles, CASE WHEN n > 1 THEN 2 ELSE 1 END::BIGINT AS n_body_styles FROM docs")
def analyze_blueprint(spark, d):
    return documents.blueprint(made_packages(spark, d)).select("doc_id", "default_font", "default_size", "n_sections", "n_styles", "n_body_styles")


@query("SELECT doc_id::VARCHAR AS doc_id, 0 AS section, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height, 72.0::DOUBLE AS top, 90.0::DOUBLE AS \"left\", NULL::DOUBLE AS gutter FROM documents")
def docx_sections(spark, d):
    return documents.sections(made_packages(spark, d)).select("doc_id", "section", "page_width", "page_height", "top", "left", "gutter")


@query(with_("lines") + f", {_xml(ids="''")} SELECT doc_id, (2 * n_paras)::INTEGER AS n_changed, md5(xml) AS data FROM docs")
def strip_rsids(spark, d):
    return _document(documents.strip_rsids(made_packages(spark, d)))


@query(with_("lines") + f", {_xml(rpr=_CLEAN)} SELECT doc_id, (2 * n_paras)::INTEGER AS n_changed, md5(xml) AS data FROM docs")
def docx_clean_runs(spark, d):
    return _document(documents.clean_runs(made_packages(spark, d)))


@query(with_("lines") + f", {_xml(rpr=_NO_BOLD)} SELECT doc_id, ((n_paras + 2) // 3)::INTEGER AS n_changed, md5(xml) AS data FROM docs")
def docx_strip_paragraph_bold(spark, d):
    return _document(documents.strip_paragraph_bold(made_packages(spark, d)))


def _edited(parts: DataFrame, *pairs: tuple[str, str], when: Column | None = None) -> DataFrame:
    """The document parts with texts replaced."""
    data = F.col("data").cast("string")
    for old, new in pairs:
        data = F.replace(data, F.lit(old), F.lit(new))
    concerned = (F.col("part_name") == packages.DOCUMENT) & (F.lit(True) if when is None else when)
    return parts.withColumn("data", F.when(concerned, data.cast("binary")).otherwise(F.col("data")))


@query(with_("lines") + f""", {_xml(rpr=f"CASE WHEN doc_id % 2 = 0 THEN {_RPR.replace('<w:b/>', '<w:b w:val="false"/>')} ELSE {_NO_BOLD} END")} SELECT doc_id, CASE WHEN n % 2 = 0 THEN 0 ELSE (n_paras + 2) // 3 END::INTEGER AS n_changed, md5(xml) AS data FROM docs""")
def bold_switched_off(spark, d):
    """Bold that says false is none: nothing to strip in every second document."""
    p = _edited(made_packages(spark, d), ("<w:b/>", '<w:b w:val="false"/>'), when=F.col("doc_id").cast("bigint") % 2 == 0)
    return _document(documents.strip_paragraph_bold(p))


@query(with_("lines") + f""", {_xml(rpr=f"CASE WHEN doc_id % 2 = 0 THEN {_RPR} || '<w:footnoteReference w:id=\"1\"/>' ELSE {_CLEAN} END")} SELECT doc_id, CASE WHEN n % 2 = 0 THEN 0 ELSE 2 * n_paras END::INTEGER AS n_changed, md5(xml) AS data FROM docs""")
def runs_with_references_stay(spark, d):
    """Runs with a note reference keep their properties."""
    p = _edited(made_packages(spark, d), ("</w:rPr><w:t", '</w:rPr><w:footnoteReference w:id="1"/><w:t'), when=F.col("doc_id").cast("bigint") % 2 == 0)
    return _document(documents.clean_runs(p))


def _cited_packages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Packages in which each line cites note 1, and notes 1 and 2 for each."""
    p = _edited(made_packages(spark, d), ("</w:t>", " [1] [9]</w:t>"))
    notes_ = p.where("part_ord = 0").select("doc_id", F.explode(F.expr("array(named_struct('note_id', 1L, 'body', 'one <'), named_struct('note_id', 2L, 'body', 'two'))")).alias("n"))
    return p, notes_.select("doc_id", "n.note_id", "n.body")


_MARKED = f"""'<w:t xml:space="preserve">' || {_escaped('text')} || ' </w:t></w:r><w:r><w:rPr><w:rStyle w:val="FootnoteReference"/></w:rPr><w:footnoteReference w:id="1"/></w:r><w:r>' || {_RPR} || '<w:t xml:space="preserve"> [9]</w:t>'"""


@query(with_("lines") + f", {_xml(text=_MARKED)} SELECT doc_id, md5(xml) AS data FROM docs")
def inject_footnotes_packages(spark, d):
    return _document(documents.inject_footnotes(*_cited_packages(spark, d))[0])


@query(with_("lines") + "SELECT doc_id::VARCHAR AS doc_id, count(*)::INTEGER AS n_inserted, [2]::BIGINT[] AS unused_ids, [9]::BIGINT[] AS cited_unknown_ids FROM lines GROUP BY doc_id")
def inject_footnotes_report(spark, d):
    return documents.inject_footnotes(*_cited_packages(spark, d))[1]


@query(with_("lines") + f", {_xml().replace("ELSE 'Normal' END", "ELSE 'Body' END")} SELECT doc_id, md5(xml) AS data FROM docs")
def apply_style_mapping(spark, d):
    p = made_packages(spark, d)
    mapping = p.where("part_ord = 0").select("doc_id", F.explode(F.expr("map('Normal', 'Body', 'Other', 'X')")).alias("style_id", "new_id"))
    return _document(documents.apply_mapping(p, mapping))


@query(with_("lines") + f", {_xml(rpr=_RPR.replace('<w:b/>', '<w:bCs/>').replace('w:sz ', 'w:szCs '))} SELECT doc_id, (n_paras + (n_paras + 2) // 3)::INTEGER AS n_changed, md5(xml) AS data FROM docs")
def normalize_tags(spark, d):
    """Misspelt tags are made right."""
    misspelt = F.replace(F.replace(F.col("data").cast("string"), F.lit("<w:b/>"), F.lit("<w:b-cs/>")), F.lit("<w:sz "), F.lit("<w:sz-cs ")).cast("binary")
    p = made_packages(spark, d).withColumn("data", F.when(F.col("part_name") == packages.DOCUMENT, misspelt).otherwise(F.col("data")))
    return _document(documents.normalize_tags(p))


def _noted_packages(spark: SparkSession, d: str) -> DataFrame:
    """Made packages with a picture that is no text, footnotes (not in every fifth), and endnotes too in every seventh."""
    p = made_packages(spark, d)
    ids = p.where("part_ord = 0").select("doc_id", F.col("doc_id").cast("bigint").alias("n"))
    note = F.lit('<w:footnotes><w:footnote w:id="1"><w:footnoteRef/>FootnoteText</w:footnote></w:footnotes>').cast("binary")
    rows = [(4, "word/media/image1.png", F.unhex(F.lit("89504E47FFFE00C3")), F.lit(True)), (5, packages.FOOTNOTES, note, F.col("n") % 5 != 0), (6, packages.ENDNOTES, note, F.col("n") % 7 == 0)]
    more = F.array(*(F.struct(F.lit(k).alias("part_ord"), F.lit(name).alias("part_name"), data.alias("data"), there.alias("there")) for k, name, data, there in rows))
    return p.unionByName(ids.select("doc_id", F.inline(more)).where("there").drop("there"))


@query(
    with_("lines")
    + f""", {_xml()}{_PARTS}, ids AS (SELECT doc_id, n FROM docs), noted AS (SELECT m.*, n, n % 5 <> 0 AND n % 7 <> 0 AS c FROM made m JOIN ids USING (doc_id))
SELECT doc_id, part_ord, part_name, md5(data) AS data FROM noted
UNION ALL SELECT doc_id, 4, 'word/media/image1.png', md5('\\x89\\x50\\x4E\\x47\\xFF\\xFE\\x00\\xC3'::BLOB) FROM ids
UNION ALL SELECT doc_id, 5, CASE WHEN n % 7 <> 0 THEN 'word/endnotes.xml' ELSE 'word/footnotes.xml' END, md5(CASE WHEN n % 7 <> 0 THEN '<w:endnotes><w:endnote w:id="1"><w:endnoteRef/>EndnoteText</w:endnote></w:endnotes>' ELSE '<w:footnotes><w:footnote w:id="1"><w:footnoteRef/>FootnoteText</w:footnote></w:footnotes>' END) FROM ids WHERE n % 5 <> 0
UNION ALL SELECT doc_id, 6, 'word/endnotes.xml', md5('<w:footnotes><w:footnote w:id="1"><w:footnoteRef/>FootnoteText</w:footnote></w:footnotes>') FROM ids WHERE n % 7 = 0"""
)
def convert_notes_kind(spark, d):
    return documents.convert_notes_kind(_noted_packages(spark, d)).select("doc_id", "part_ord", "part_name", _md5("data"))


@query(with_("lines") + "SELECT doc_id::VARCHAR AS doc_id, p_idx, text FROM lines")
def docx_paragraph_texts(spark, d):
    return documents.paragraph_texts(made_packages(spark, d))


@query(
    with_("lines")
    + """, c AS (SELECT doc_id, p_idx, text FROM lines WHERE p_idx > 0 AND p_idx % 3 = 0 AND trim(text) <> '' AND length(text) < 100), b AS (SELECT DISTINCT doc_id FROM lines WHERE p_idx > 0 AND trim(text) <> '' AND NOT (p_idx % 3 = 0 AND length(text) < 100) AND p_idx % 3 <> 0)
SELECT doc_id::VARCHAR AS doc_id, p_idx, 1 AS level, 18.0::DOUBLE AS size, substring(text, 1, 60) AS preview FROM c"""
)
def docx_infer_headings(spark, d):
    return documents.infer_headings(made_packages(spark, d))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    from quillframe.sources.docx import package_bytes

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [g.doc_id.iloc[0]], "content": [package_bytes([(n, bytes(x)) for n, x in zip(g.sort_values("part_ord").part_name, g.sort_values("part_ord").data)])]})

    return made_packages(spark, d).groupBy("doc_id").applyInPandas(pack, "doc_id string, content binary")


@query(
    with_("lines")
    + """, n AS (SELECT doc_id::VARCHAR AS doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, 1 AS check_no, 'ok' AS severity, 0 AS seq, '4 parts parse' AS message FROM n
UNION ALL SELECT doc_id, 2, 'issue', 0, '1 revision ids of paragraphs aren''t in the settings: 00A1' FROM n
UNION ALL SELECT doc_id, 3, 'ok', 0, n || ' of paragraph id, no two alike' FROM n
UNION ALL SELECT doc_id, 4, 'ok', 0, 'All relationship targets are there' FROM n
UNION ALL SELECT doc_id, 5, 'ok', 0, (n + 1) || ' children of the body' FROM n"""
)
def check_package(spark, d):
    return documents.check_package(made_packages(spark, d))


@query(with_("lines") + "SELECT DISTINCT doc_id::VARCHAR AS doc_id, 'ok' AS severity, '4 parts parse' AS message FROM lines WHERE doc_id % 4 <> 0 UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'issue', 'word/document.xml' FROM lines WHERE doc_id % 4 = 0")
def check_xml_parses(spark, d):
    """Every fourth document's end is cut off."""
    p = made_packages(spark, d)
    broken = (F.col("part_name") == packages.DOCUMENT) & (F.col("doc_id").cast("bigint") % 4 == 0)
    p = p.withColumn("data", F.when(broken, F.expr("substring(data, 1, length(data) - 5)")).otherwise(F.col("data")))
    found = documents.check_package(p).where("check_no = 1")
    return found.select("doc_id", "severity", F.when(F.col("severity") == "ok", F.col("message")).otherwise(F.substring_index("message", " ", 1)).alias("message"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """Packages as archives, each seventh cut short."""
    from quillframe.sources import docx

    cut = F.expr("substring(content, 1, length(content) - 40)")
    return docx.archives_of(made_packages(spark, d)).withColumn("content", F.when(F.col("doc_id").cast("bigint") % 7 == 0, cut).otherwise(F.col("content")))


@query(with_("lines") + f", {_xml()}{_PARTS} SELECT doc_id, part_ord, part_name, md5(data) AS data, false AS failed FROM made WHERE doc_id::BIGINT % 7 <> 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM docs WHERE n % 7 = 0")
def scan_parts(spark, d):
    """Archives as binary rows to parts; broken ones are rows with an error."""
    from quillframe.sources import docx

    return docx.parts_of(_archives(spark, d)).select("doc_id", "part_ord", "part_name", _md5("data"), F.col("error").isNotNull().alias("failed"))


@query(with_("lines") + f", {_xml()}{_PARTS} SELECT 'group' || (doc_id::BIGINT % 3) || '/same' || (doc_id::BIGINT // 3) AS doc_id, part_ord, part_name, md5(data) AS data FROM made")
def write_packages(spark, d):
    """Written as files by the sink, into three folders with the same names in each, and read again by the source."""
    from quillframe import api
    from quillframe.sources import docx

    n = F.col("doc_id").cast("bigint")
    name = F.concat(F.lit("group"), (n % 3).cast("string"), F.lit("/same"), F.expr("cast(doc_id as bigint) div 3").cast("string"))
    where = tables.new_path(spark, "packages")
    docx.write_packages(made_packages(spark, d).withColumn("doc_id", name), where)
    return api.read(spark, where).select("doc_id", "part_ord", "part_name", _md5("data"))


@query(
    with_("lines")
    + f""", {_xml(ids="''", rpr=_CLEAN)}{_PARTS.replace('CASE n % 3', 'CASE 0')} SELECT doc_id, part_ord, part_name, md5(data) AS data FROM made"""
)
def transplant_body(spark, d):
    """The frame of document 0 around the body of each."""
    p = made_packages(spark, d)
    pairs = table(spark, d, "documents").select(F.lit("0").alias("blueprint_id"), F.col("doc_id").cast("string").alias("source_id"))
    return documents.transplant(p.where("doc_id = '0'"), p, pairs).select("doc_id", "part_ord", "part_name", _md5("data"))


_NEW_RUN = f"CASE WHEN trim(text) <> '' THEN '<w:r>' || {_rebuilt(_REVERSED)} || '</w:r>' ELSE '<w:r>' || {_RPR} || {_TEXT} || '</w:r>' END"


@query(with_("lines") + f", {_xml().replace("'<w:r>' || " + _RPR + " || " + _TEXT + " || '</w:r></w:p>'", _NEW_RUN + " || '</w:p>'")} SELECT doc_id, md5(xml) AS data FROM docs")
def translate_pipeline(spark, d):
    out, _ = documents.translate_packages(made_packages(spark, d), [translation.MockProvider()], "en", "de")
    return _document(out)


@query(with_("lines") + f", {_xml(text=_rebuilt("(text || '!')"))} SELECT doc_id, md5(xml) AS data FROM docs")
def replace_runs(spark, d):
    p = made_packages(spark, d)
    return _document(documents.replace_runs(p, documents.paragraph_runs(p).withColumn("text", F.concat("text", F.lit("!")))))


@query(with_("lines") + f", {_xml(text=f"CASE WHEN trim(text) <> '' THEN {_rebuilt(_REVERSED)} ELSE {_TEXT} END")} SELECT doc_id, md5(xml) AS data FROM docs")
def preserve_formatting(spark, d):
    """Translated texts written back as runs with the formats of their sources."""
    out, _ = documents.translate_runs(made_packages(spark, d), [translation.MockProvider()], "en", "de")
    return _document(out)
