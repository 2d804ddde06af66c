"""Classification of style names, generated as one CASE from tables of names."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import SPACE

#: Words that a digit follows, by how far their level goes.
_NUMBERED = (
    ("heading {}", 9), ("heading{}", 9), ("h{}", 9), ("überschrift {}", 6), ("titre {}", 5), ("titolo {}", 3), ("encabezado {}", 3),
    ("заголовок {}", 4), ("标题 {}", 3), ("kop {}", 3), ("nagłówek {}", 3), ("rubrik {}", 1), ("heading{}char", 1),
)
KEYWORDS = "heading ueberschrift überschrift titre titolo encabezado заголовок kop rubrik nagłówek".split()
TITLES = "title|documenttitle|thetitle|doc title".split("|")
#: In the order in which they are tried; any part of the name counts.
CONTAINED = {
    "footnote": "footnote text|fußnotentext|note de bas de page|nota a piè di pagina|nota al pie|сноска|footnote|footnotetext".split("|"),
    "caption": "caption|bildunterschrift|légende|didascalia|leyenda".split("|"),
    "blockquote": "block text|blockquote|quote|intense quote|block quotation|zitat|citation|citazione|bloque de texto".split("|"),
    "abstract": "abstract|zusammenfassung|résumé|riassunto".split("|"),
}
BODY = "normal|standard|body text|bodytext|fließtext|texte de corps|corpo del testo|cuerpo de texto|основной текст|no spacing|default paragraph style|tekst podstawowy".split("|")


def prefixes(level: int) -> list[str]:
    """Names that begin so are headings of this level; an exact name is its own prefix."""
    return [word.format(level) for word, most in _NUMBERED if level <= most]


def classify_style(name: str = "name") -> Column:
    """STRUCT<class, heading_level> of a style name (SQL text of a string), case and outer white space ignored; null for null.

    Levels are tried from 1 to 9 by prefix, so that "heading 10" is level 1; then, for each keyword in
    turn, the digit after its first occurrence; then titles, parts of names, and body text. The name is
    trimmed once (the lambda binds it), and the expression is parsed from text: it has too many parts to
    be built call by call.
    """
    return F.expr(_spark_sql(name))


@lru_cache
def _spark_sql(name: str) -> str:
    def to(label: str, level: str) -> str:
        return f"THEN named_struct('class', {label}, 'heading_level', {level})"

    cases = ["WHEN n IS NULL THEN NULL"]
    for k in range(1, 10):
        cases.append("WHEN " + _sql_any("startswith(n, '{}')", prefixes(k)) + to(f"'heading{k}'", str(k)))
    for w in KEYWORDS:
        digit = f"regexp_extract(substring(n, locate('{w}', n) + {len(w)}), '^[ \\\\t_-]*0*([1-9])', 1)"
        cases.append(f"WHEN locate('{w}', n) > 0 AND {digit} <> '' " + to(f"concat('heading', {digit})", f"cast(nullif({digit}, '') as int)"))
    cases.append("WHEN n IN (" + ", ".join(f"'{t}'" for t in TITLES) + ") " + to("'title'", "0"))
    for label, words in CONTAINED.items():
        cases.append("WHEN " + _sql_any("contains(n, '{}')", words) + to(f"'{label}'", "0"))
    cases.append("WHEN " + _sql_any("startswith(n, '{}')", BODY) + to("'body'", "0"))
    space = SPACE.replace("\\", "\\\\")
    trimmed = f"regexp_replace(lower({name}), '^{space}+|{space}+$', '')"
    return f"get(transform(array({trimmed}), n -> CASE {' '.join(cases)} ELSE named_struct('class', 'unknown', 'heading_level', 0) END), 0)"


def _sql_any(pattern: str, words: list[str]) -> str:
    return "(" + " OR ".join(pattern.format(w) for w in words) + ")"


def classify_sql(name: str) -> tuple[str, str]:
    """DuckDB expressions for (class, heading_level) of the expression ``name``."""
    n = f"trim(lower({name}))"
    label, level = [], []
    for k in range(1, 10):
        test = _sql_any(f"starts_with({n}, '{{}}')", prefixes(k))
        label.append(f"WHEN {test} THEN 'heading{k}'")
        level.append(f"WHEN {test} THEN {k}")
    for w in KEYWORDS:
        digit = f"regexp_extract(substr({n}, instr({n}, '{w}') + {len(w)}), '^[ \\t_-]*0*([1-9])', 1)"
        label.append(f"WHEN instr({n}, '{w}') > 0 AND {digit} <> '' THEN 'heading' || {digit}")
        level.append(f"WHEN instr({n}, '{w}') > 0 AND {digit} <> '' THEN {digit}::INTEGER")
    label.append(f"WHEN {n} IN ({', '.join(repr(t) for t in TITLES)}) THEN 'title'")
    for k, words in CONTAINED.items():
        label.append("WHEN " + _sql_any(f"contains({n}, '{{}}')", words) + f" THEN '{k}'")
    label.append("WHEN " + _sql_any(f"starts_with({n}, '{{}}')", BODY) + " THEN 'body'")
    return f"CASE WHEN {name} IS NULL THEN NULL {' '.join(label)} ELSE 'unknown' END", f"CASE WHEN {name} IS NULL THEN NULL {' '.join(level)} ELSE 0 END"
