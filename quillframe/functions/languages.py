"""Language names and codes as a literal map, and the translation prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import trim_all

#: Code: the name that it stands for, then the other names that are understood.
NAMES = {
    k: v.split(",")
    for k, v in (
        line.split(": ")
        for line in """en: english
de: german,deutsch
fr: french,français,francais
es: spanish,español,espanol,castellano
it: italian,italiano
pt: portuguese,português,portugues
nl: dutch,nederlands
pl: polish,polski
ru: russian,русский,russky,russkiy
uk: ukrainian,українська,ukrayinska
cs: czech,čeština,cestina
sv: swedish,svenska
no: norwegian,norsk
da: danish,dansk
fi: finnish,suomi
el: greek,ελληνικά
tr: turkish,türkçe,turkce
ar: arabic,العربية
he: hebrew,עברית
zh: chinese,中文,mandarin
ja: japanese,日本語
ko: korean,한국어
hi: hindi,हिन्दी
vi: vietnamese,tiếng việt,tieng viet
th: thai,ไทย
id: indonesian,bahasa indonesia
ro: romanian,română,romana
hu: hungarian,magyar
bg: bulgarian,български
sr: serbian,српски,srpski
hr: croatian,hrvatski
sl: slovenian,slovenščina,slovenski
sk: slovak,slovenský,slovensky""".splitlines()
    )
}
BY_CODE = {code: names[0].capitalize() for code, names in NAMES.items()}
BY_NAME = {name: code for code, names in NAMES.items() for name in names}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def parse_language(c: Column) -> Column:
    """STRUCT<name, code>: up to three ASCII letters are a code, anything else a name; what isn't known is echoed. White space around it goes."""
    c = trim_all(c)
    low = F.lower(c)
    is_code = c.rlike(r"^[A-Za-z]{1,3}\z")
    return F.struct(
        F.when(is_code, F.coalesce(F.element_at(_map(BY_CODE), low), c)).otherwise(c).alias("name"),
        F.when(is_code, low).otherwise(F.coalesce(F.element_at(_map(BY_NAME), low), c)).alias("code"),
    )


def language_code(c: Column) -> Column:
    """The code alone, as local models want it."""
    return parse_language(c)["code"]


STYLES = {
    "preserve_order": "Keep to the order of the words where you can, so that they can be aligned.",
    "fluent": "Translate naturally and fluently.",
}


def build_prompt(text: Column, source: Column, target: Column, style: str = "preserve_order") -> Column:
    """The instruction for a model that translates; source and target are language names."""
    return F.concat(F.lit("Translate from "), source, F.lit(" into "), target, F.lit(f". {STYLES[style]} Answer with the translation only.\n\n"), text)
