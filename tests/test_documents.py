"""Packages made in memory, through the XML functions, the data source and the jobs."""

import json
import os
import re

import pytest

from quillframe import api, cli
from quillframe.operators import packages as P
from quillframe.operators import translation as T
from quillframe.plans import documents as D
from quillframe.sources import docx
from quillframe.sources import xmlparts as X
from quillframe.streaming.ingest import ingest



def ox(s):
    """XML written without the prefix w, with it."""
    s = re.sub(r"(</?)([A-Za-z]\w*)(?=[\s/>]|$)", r"\1w:\2", s)
    return re.sub(r"(?<!\?xml)(\s)([A-Za-z]\w*)(?==[\"'])", r"\1w:\2", s)


W = f'xmlns:w="{X.MAIN}" xmlns:w14="{X.WORD_2010}"'
SECT = ox('<sectPr><pgSz w="12240" h="15840"/><pgMar top="1440" bottom="1440" left="720"/></sectPr>')


def relations(i, kind):
    return f'<Relationships xmlns="r"><Relationship Id="{i}" Type="http://x/relationships/{kind}" Target="{kind}.xml"/></Relationships>'


RELS = relations("rId3", "styles")
NOTES = ox(f'<footnotes {W}><footnote id="-1"><p><r><separator/></r></p></footnote><footnote id="1"><p><r><rPr><i/></rPr><footnoteRef/></r><r><tab/></r><r><t>note</t></r></p></footnote></footnotes>')


def document(inner, sect=SECT):
    return ox(f'<?xml version="1.0"?><document {W}><body>{inner}{sect}</body></document>')


def para(text, rpr="", ppr="", attrs=""):
    return ox(f"<p{attrs}>{ppr}<r>{rpr}<t>{text}</t></r></p>")


def package(doc_id, body, **more):
    rows = [(P.CONTENT_TYPES, '<Types xmlns="c"></Types>'), (P.DOCUMENT, body), (P.RELS, more.pop("rels", RELS))]
    rows += [(f"word/{k}.xml", v) for k, v in more.items()]
    return [(doc_id, k, n, bytearray(d.encode())) for k, (n, d) in enumerate(rows)]


def frame(spark, *rows):
    return spark.createDataFrame([r for p in rows for r in p], "doc_id string, part_ord int, part_name string, data binary")


def part(df, doc_id, name):
    return [bytes(r.data).decode() for r in df.where(f"doc_id = '{doc_id}' and part_name = '{name}'").collect()][0]


def styles(*given):
    return ox(f"<styles {W}>") + "".join(ox(f'<style type="paragraph" styleId="{i}"><name val="{n}"/>') + (ox(f'<outlineLvl val="{o}"/>') if o is not None else "") + ox("</style>") for i, n, o in given) + ox("</styles>")


@pytest.mark.parametrize("xml", [document(para("a &lt; b")), "<a><!-- <b> --><![CDATA[<c>]]><d x='>'/></a>", "not xml < at all", "", "<open><never"])
def test_tokens_join_to_the_source(xml):
    assert X.join(X.tokens(xml)) == xml


def test_paragraphs_and_runs():
    tabs = ox('<pPr><tabs><tab val="left"/></tabs></pPr>')
    doc = document(
        para("Plain ") + ox(f'<p>{tabs}<bookmarkStart id="1"/><r><t>a</t><tab/><t>b</t><br/><t>c &amp; d</t></r><hyperlink><r><rPr><b/></rPr><t>link</t></r></hyperlink>'
        '<r><footnoteReference id="2"/></r><bookmarkEnd id="1"/></p><p/><p><r><pict><p><r><t>box</t></r></p></pict><t> outer</t></r></p>')
    )
    got = X.paragraphs(doc)
    assert [p.text for p in got] == ["Plain ", "a\tb\nc & dlink", "", "box outer"]
    assert got[1].runs[1].rpr == ox("<rPr><b/></rPr>") and got[1].runs[2].refs == [ox('<footnoteReference id="2"/>')] and got[1].ppr == tabs
    assert got[1].starts == [ox('<bookmarkStart id="1"/>')] and got[1].ends == [ox('<bookmarkEnd id="1"/>')]
    again = X.paragraphs(X.replace_paragraphs(doc, [None, got[1]]))
    assert [(p.text, p.ppr, p.starts, p.ends) for p in again] == [(p.text, p.ppr, p.starts, p.ends) for p in got]


def test_replace_texts_keeps_the_rest():
    doc = document(para("one", ox("<rPr><b/></rPr>"), ox('<pPr><pStyle val="X"/></pPr>'), ' w:rsidR="1"') + ox('<p><r><t>two</t><endnoteReference id="4"/></r></p>') + para("three"))
    out = X.replace_texts(doc, [" uno & ", "dos", None])
    assert ox('<p rsidR="1"><pPr><pStyle val="X"/></pPr><r><t xml:space="preserve"> uno &amp; </t></r></p>') in out
    assert ox('<endnoteReference id="4"/>') in out and [p.text for p in X.paragraphs(out)] == [" uno & ", "dos", "three"]
    assert out.endswith(para("three") + SECT + ox("</body></document>"))


def test_strip_tracking_is_idempotent():
    doc = document(ox('<p rsidR="1" rsidRDefault="2" w14:paraId="3" w14:textId="4" rsidP="5" rsidRPr="6"><r rsidR="7" rsidRPr="8"><t>hello rsidR="9"</t></r></p>'))
    once, n = X.strip_tracking(doc)
    assert n == 8 and 'hello w:rsidR="9"' in once and X.strip_tracking(once) == (once, 0)


def test_clean_runs():
    props = "".join(ox(f"<{x}/>") for x in ("b", "caps", "color", "rFonts", "sz", "lang", "i")) + ox("<shd><deep/></shd>")
    doc = document(ox(f"<p><r><rPr>{props}</rPr><t>x</t></r><r><rPr>{props}</rPr><footnoteReference id='1'/></r></p>"))
    out, n = X.clean_runs(doc)
    assert n == 6 and ox("<rPr><b/><i/></rPr><t>x") in out and out.count("w:deep") == 1


@pytest.mark.parametrize("inner,n", [(para("a", ox("<rPr><b/></rPr>")), 1), (para("a", ox('<rPr><b val="0"/></rPr>')), 0), (ox("<p/>"), 0), (ox("<p><r><rPr><b/></rPr><t>a</t></r><r><t>b</t></r></p>"), 0)])
def test_strip_paragraph_bold(inner, n):
    out, found = X.strip_paragraph_bold(document(inner))
    assert found == n and ((ox("<b/>") in out) == (n == 0 and ox("<b/>") in inner))


def test_sections_defaults_and_slices():
    (s,) = X.sections(document(""))
    assert (s["page_width"], s["page_height"], s["top"], s["left"], s["gutter"]) == (612.0, 792.0, 72.0, 36.0, None)
    assert X.defaults(ox("<styles/>")) == ("Times New Roman", 12.0)
    assert X.defaults(ox('<styles><docDefaults><rPrDefault><rPr><rFonts ascii="Calibri"/><sz val="22"/></rPr></rPrDefault></docDefaults></styles>')) == ("Calibri", 11.0)
    head, body, sect, tail = X.body_slice(document(para("x") + ox("<p><pPr><sectPr/></pPr></p>")))
    assert sect == SECT and body.endswith(ox("</p>")) and head + body + sect + tail == document(para("x") + ox("<p><pPr><sectPr/></pPr></p>"))


def test_footnote_format():
    assert X.footnote_format(NOTES) == (ox("<rPr><i/></rPr>"), "\t") and X.footnote_format(ox("<footnotes/>")) == (None, None)
    wrong = NOTES.replace(ox("<i/>"), ox("<b/>")).replace(ox("<r><tab/></r>"), ox('<r><t xml:space="preserve"> </t></r>'))
    out, n = X.apply_footnote_format(wrong, ox("<rPr><i/></rPr>"), "\t")
    assert n == 1 and X.footnote_format(out) == (ox("<rPr><i/></rPr>"), "\t") and "note" in out
    bare = NOTES.replace(ox("<r><tab/></r>"), "")
    assert X.footnote_format(bare) == (ox("<rPr><i/></rPr>"), "")  # the note's text is no separator
    assert ox("<r><tab/></r><r><t>note") in X.apply_footnote_format(bare, None, "\t")[0]
    assert ox("<tab/>") not in X.apply_footnote_format(NOTES, None, "")[0]


def test_references_are_injected_and_the_rest_of_the_run_stays():
    doc = document(para("opener.[1] middle.[2] end.[007]", ox("<rPr><b/></rPr>")))
    out, used, cited = X.inject_references(doc, {1, 7, 99})
    assert used == [1, 7] and cited == [1, 2, 7]
    assert "".join(r.text for r in X.paragraphs(out)[0].runs) == "opener. middle.[2] end."
    assert [r.rpr for r in X.paragraphs(out)[0].runs if r.text] == [ox("<rPr><b/></rPr>")] * 2 and X.parse_error(out.encode()) is None


def test_notes_kind_there_and_back(spark):
    doc = document(ox('<p><r><footnoteReference id="1"/></r></p>'))
    kind = "footnotes"
    types = f'<Types xmlns="c"><Override PartName="/word/{kind}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml"/></Types>'
    rels = relations("rId10", kind)
    rows = package("a", doc, rels=rels, footnotes=NOTES)
    rows[0] = ("a", 0, P.CONTENT_TYPES, bytearray(types.encode()))
    df = frame(spark, rows, package("b", doc))
    there = D.convert_notes_kind(df)
    assert "w:endnoteReference" in part(there, "a", P.DOCUMENT) and "endnotes+xml" in part(there, "a", P.CONTENT_TYPES) and 'Target="endnotes.xml"' in part(there, "a", P.RELS)
    assert ox("<endnotes ") in part(there, "a", P.ENDNOTES)
    back = D.convert_notes_kind(there, to_endnotes=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("doc_id", "part_ord", "part_name", "data").collect()))


def test_inject_footnotes_job(spark):
    df = frame(spark, package("a", document(para("x[2] y[1] z[9]"))), package("b", document(para("x[1]")), footnotes=NOTES))
    notes = spark.createDataFrame([(d, i, f"body <{i}>") for d in "ab" for i in (1, 2, 5)], "doc_id string, note_id long, body string")
    out, report = D.inject_footnotes(df, notes)
    r = {x.doc_id: x for x in report.collect()}
    assert (r["a"].n_inserted, r["a"].unused_ids, r["a"].cited_unknown_ids) == (2, [5], [9])
    made = part(out, "a", P.FOOTNOTES)
    assert made.index('w:id="2"') < made.index('w:id="1"') and "body &lt;1&gt;" in made and X.parse_error(made.encode()) is None
    assert "/word/footnotes.xml" in part(out, "a", P.CONTENT_TYPES) and 'Id="rId4"' in part(out, "a", P.RELS)
    assert part(out, "b", P.FOOTNOTES) == NOTES


def test_transplant(spark):
    bp = package("bp", document(para("blueprint text")), styles=styles(("MyH1", "heading 1", 0), ("N", "Normal", None)), footnotes=NOTES)
    src = package("s", document(para("source text", ox("<rPr><color/></rPr>"), ox('<pPr><pStyle val="Heading1"/></pPr>'), ' w:rsidR="1"'), ox('<sectPr><pgSz w="8000"/></sectPr>')), styles=styles(("Heading1", "heading 1", 0)), footnotes=NOTES.replace(ox("<i/>"), ox("<b/>")))
    out = D.transplant(frame(spark, bp), frame(spark, src), spark.createDataFrame([("bp", "s")], "blueprint_id string, source_id string"))
    doc = part(out, "s", P.DOCUMENT)
    assert "source text" in doc and "blueprint text" not in doc and SECT in doc and "8000" not in doc and "rsidR" not in doc and "w:color" not in doc
    assert ox('<pStyle val="MyH1"/>') in doc and ox("<i/>") in part(out, "s", P.FOOTNOTES) and "MyH1" in part(out, "s", P.STYLES)
    assert "footnotes" in part(out, "s", P.CONTENT_TYPES)


def test_headings(spark):
    big, mid, small = (ox('<rPr><b/><sz val="48"/></rPr>'), ox('<rPr><b/><sz val="36"/></rPr>'), ox('<rPr><sz val="28"/></rPr>'))
    styled = ox('<pPr><pStyle val="Heading1"/></pPr>')
    body = para("Large", big, ox('<pPr><pStyle val="N"/></pPr>')) + para("body text", small) + para("Middle", mid) + para("Done", big, styled) + para("x" * 100, big) + para("more body", small)
    df = frame(spark, package("a", document(body), styles=styles(("Heading1", "heading 1", 0))), package("none", document(para("plain"))))
    found = D.infer_headings(df)
    assert sorted((r.doc_id, r.p_idx, r.level, r.size) for r in found.collect()) == [("a", 0, 1, 24.0), ("a", 2, 2, 18.0)]
    blueprint = frame(spark, package("bp", document(""), styles=styles(("H1", "heading 1", 0), ("H4", "heading 4", 3))))
    out = part(D.apply_headings(df, found, blueprint), "a", P.DOCUMENT)
    assert ox('<pStyle val="H1"/></pPr><r><rPr><b/><sz val="48"/></rPr><t>Large') in out and out.count("w:pStyle") == 2
    assert part(D.apply_headings(df, found, blueprint, insert_missing=True), "a", P.DOCUMENT).count("w:pStyle") == 3


def test_check(spark):
    bad = document(ox('<p rsidR="AA" w14:paraId="1"/><p w14:paraId="1"/><sdt/><bookmarkStart id="5"/><bookmarkStart id="5"/><p><hyperlink r:id="rId8"/></p>').replace("r:id", "id"))
    good = document(ox('<p rsidR="BB" w14:paraId="1"/>'))
    settings = ox(f'<settings {W}><rsids><rsid val="BB"/></rsids></settings>')
    df = frame(spark, package("bad", bad, settings=ox("<settings")), package("good", good, styles=styles(), settings=settings))
    got = D.check_package(df).collect()
    assert {r.check_no for r in got if r.doc_id == "bad" and r.severity == "issue"} == {1, 2, 3, 4, 5, 6, 7}
    assert {r.severity for r in got if r.doc_id == "good"} == {"ok"}


def test_source_and_sink(spark, tmp_path):
    df = frame(spark, package("a", document(para("one"))), package("b", document(para("two"))))
    folder = str(tmp_path / "in")
    docx.write_packages(df, folder)
    assert sorted(os.listdir(folder)) == ["a.docx", "b.docx"]
    with open(f"{folder}/c.docx", "wb") as f:
        f.write(b"no archive")
    with open(f"{folder}/d.docx", "wb") as f:
        f.write(docx.package_bytes([("word/document.xml", b"<x/>")]))
    got = api.read(spark, folder)
    assert sorted(map(tuple, got.where("error is null").select("doc_id", "part_ord", "part_name", "data").collect())) == sorted(map(tuple, df.collect()))
    assert {r.doc_id for r in got.where("error is not null").collect()} == {"c", "d"}
    assert {r.part_name for r in api.read(spark, folder, parts=P.DOCUMENT).where("error is null").collect()} == {P.DOCUMENT}
    with pytest.raises(Exception, match="c.docx|d.docx"):
        api.read(spark, folder, mode="FAILFAST").count()
    table, check = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, folder, table, check).awaitTermination()
    again = spark.read.parquet(table)
    assert again.count() == got.count() and again.where("error is not null").count() == 2


def test_command_line(spark, tmp_path, capsys):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = frame(spark, package("a", document(para("Fine [1]", attrs=' w:rsidR="1"')), styles=styles(("N", "Normal", None))))
    docx.write_packages(df, folder)
    assert cli.main(["clean", folder, "--output", out], spark) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["inspect", folder], spark) == 0 and P.DOCUMENT in capsys.readouterr().out
    assert cli.main(["check", folder], spark) == 1
    assert cli.main(["check", out], spark) == 0
    notes = tmp_path / "notes.json"
    notes.write_text(json.dumps({"1": "a note"}))
    assert cli.main(["inject-footnotes", folder, "-o", str(tmp_path / "notes"), "--notes", str(notes)], spark) == 0
    assert cli.main(["notes-kind", str(tmp_path / "notes"), "-o", str(tmp_path / "end")], spark) == 0
    assert P.ENDNOTES in {r.part_name for r in api.read(spark, str(tmp_path / "end")).collect()}
    assert cli.main(["transplant", folder, "--blueprint", folder, "-o", str(tmp_path / "t")], spark) == 0
    capsys.readouterr()
    assert cli.main(["translate", folder, "--target-lang", "de", "--dry-run"], spark) == 0 and "[000] Fine [1]" in capsys.readouterr().out


def test_translation(spark, tmp_path):
    rows = [("d", k, t) for k, t in enumerate(["good one", "bad one", "", None, "  ", "good two"])]
    paras = spark.createDataFrame(rows, "doc_id string, p_idx int, text string").selectExpr("1L as doc_id", "p_idx", "text")
    got = {r.p_idx: r for r in T.translate(paras, [T.MockProvider("a", "bad"), T.MockProvider("b", "one")], "en", "de", 3).collect()}
    assert (got[0].translated, got[0].provider) == ("[de] one good", "a") and got[1].translated is None and "refuses" in got[1].error
    assert all(got[k].translated is None and got[k].error is None for k in (2, 3, 4))
    back = {r.p_idx: r.text for r in T.write_back(paras, T.translate(paras, [T.MockProvider("a", "bad")], "en", "de")).collect()}
    assert back[1] == "bad one" and back[5] == "[de] two good"
    with pytest.raises(ValueError):
        T.translate(paras, [], "en", "de")
    df = frame(spark, package("x", document(para("hello there") + para("bad"))))
    out, summary = D.translate_packages(df, [T.MockProvider("a", "bad")], "en", "de")
    assert [p.text for p in X.paragraphs(part(out, "x", P.DOCUMENT))] == ["[de] there hello", "bad"]
    assert [(r.n, r.n_ok, r.n_failed) for r in summary.collect()] == [(2, 1, 1)]


def test_provider_requests_and_replies(spark, monkeypatch):
    chain = T.providers_from({"ANTHROPIC_API_KEY": "k", "GROQ_API_KEY": "g"}, "own")
    assert [(p.name, p.model == "own") for p in chain] == [("groq", True), ("anthropic", False)]
    replies = {"chat": {"choices": [{"message": {"content": " a "}}]}, "messages": {"content": [{"type": "x"}, {"type": "text", "text": " a "}]}, "generate": {"response": "a"}}
    for kind, reply in replies.items():
        monkeypatch.setattr(T, "_post", lambda url, body, headers, reply=reply: reply)
        p = T.HttpProvider("n", kind, "http://h", "m", "key")
        assert p.translate("text", "English", "German") == "a" and "English" in json.dumps(p.request("t", "English", "German")[1])
        df = spark.createDataFrame([(json.dumps(reply),), ("{}",), ("no json",)], "r string")
        assert [x.t for x in df.select(T.reply_text(df.r, kind).alias("t")).collect()] == ["a", None, None]
        monkeypatch.setattr(T, "_post", lambda url, body, headers: {})
        with pytest.raises(T.ProviderError):
            p.translate("text", "English", "German")


class Counting:
    """Writes a file for each call."""

    def __init__(self, folder):
        self.name, self.folder = "counting", str(folder)

    def translate(self, text, source, target):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return text.upper() + "."


@pytest.mark.parametrize("job", [D.translate_packages, D.translate_runs])
def test_each_text_is_sent_once(spark, tmp_path, job):
    df = frame(spark, package("x", document(para("hello there") + para("  ") + para("good day"))))
    out, summary = job(df, [Counting(tmp_path)], "en", "de")
    assert [p.text for p in X.paragraphs(part(out, "x", P.DOCUMENT))] == ["HELLO THERE.", "  ", "GOOD DAY."]
    assert [(r.doc_id, r.n, r.n_ok, r.n_failed) for r in summary.collect()] == [("x", 3, 2, 0)]
    assert len(os.listdir(tmp_path)) == 2


def test_formats_go_along_to_a_translation(spark):
    runs = ox("<p><r><rPr><b/></rPr><t>one two </t></r><r><rPr><i/></rPr><t>three four</t></r></p>")
    df = frame(spark, package("x", document(runs + para("bad"))), package('y"[,', document(runs)))
    out, _ = D.translate_runs(df, [T.MockProvider("a", "bad")], "en", "de")
    for doc in ("x", 'y"[,'):
        got = [[(r.text, r.rpr) for r in p.runs] for p in X.paragraphs(part(out, doc, P.DOCUMENT))]
        assert got[0] == [("[de] four three ", ox("<rPr><b/></rPr>")), ("two one", ox("<rPr><i/></rPr>"))]
    assert [p.text for p in X.paragraphs(part(out, "x", P.DOCUMENT))][1] == "bad"
    reverse = lambda s, t: spark.createDataFrame([(r.pair_id, 3 - k, k + 1) for r in s.collect() for k in range(4)], "pair_id string, src_word int, tgt_word int")
    out, _ = D.translate_runs(df, [T.MockProvider("a", "bad")], "en", "de", reverse)
    assert [(r.text, r.rpr) for r in X.paragraphs(part(out, "x", P.DOCUMENT))[0].runs] == [("[de] four three ", ox("<rPr><i/></rPr>")), ("two one", ox("<rPr><b/></rPr>"))]


def test_bytes_that_are_no_utf8(spark):
    rows = package("a", document(para("fine"))) + [("a", 9, "word/media/x.png", bytearray(b"\x89PNG\xff\xc3"))] + package("b", document(para("b~d")), footnotes=NOTES)
    rows = [(d, k, n, bytearray(bytes(x).replace(b"~", b"\xff")) if n == P.DOCUMENT else x) for d, k, n, x in rows]
    df = frame(spark, rows)
    assert {(r.doc_id, r.text) for r in D.paragraph_texts(df).collect()} == {("a", "fine"), ("b", "b\ufffdd")}
    there = {(r.doc_id, r.part_name): bytes(r.data) for r in D.convert_notes_kind(df).collect()}
    assert there["a", "word/media/x.png"] == b"\x89PNG\xff\xc3" and b"b\xffd" in there["b", P.DOCUMENT] and ("b", P.ENDNOTES) in there and ("b", P.FOOTNOTES) not in there
    assert [(r.doc_id, r.severity) for r in D.check_package(df).where("check_no = 1").orderBy("doc_id").collect()] == [("a", "ok"), ("b", "issue")]
    assert b"b\xffd" in next(bytes(r.data) for r in D.clean_runs(df).collect() if r.doc_id == "b" and r.part_name == P.DOCUMENT)


def test_files_of_one_name_stay_apart(spark, tmp_path):
    folder = str(tmp_path / "in")
    docx.write_packages(frame(spark, package("x/same", document(para("one"))), package("y/same", document(para("two"))), package("z", document(""))), folder)
    assert sorted(os.listdir(folder)) == ["x", "y", "z.docx"]
    texts = lambda path: {(r.doc_id, r.text) for r in api.extract_paragraph_texts(spark, path).collect()}
    both = {("x/same", "one"), ("y/same", "two")}
    assert texts(folder) == texts(f"file://{folder}") == texts(f"{folder}/**/*.docx") == texts(f"{folder}/*/same.docx") == both
    assert texts(f"{folder}/x") == texts(f"{folder}/x/*.docx") == texts(f"{folder}/x/same.docx") == {("same", "one")} and texts(f"{folder}/none") == set()
    table = str(tmp_path / "table")
    ingest(spark, folder, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(table).collect()} == {"x/same", "y/same", "z"}


def test_deep_nesting_takes_linear_time():
    import time

    xml = ox("<p><r>") * 20_000 + ox("<t>x</t>") + ox("</r></p>") * 20_000
    began = time.process_time()
    assert X.clean_runs(document(xml))[1] == 0 and len(X.tokens(xml).ends) == 80_003
    assert time.process_time() - began < 20


def test_models_of_a_provider(monkeypatch, capsys):
    replies = {"/models": {"data": [{"id": "a", "context_window": 8}, {"id": ""}, {"id": "b"}]}, "/v1/models": {"data": [{"id": "c", "display_name": "C"}]}, "/api/tags": {"models": [{"name": "d", "details": {"parameter_size": "3B"}}]}}
    monkeypatch.setattr(T, "_get", lambda url, headers: replies[url.removeprefix("http://h")])
    got = [T.HttpProvider("n", kind, "http://h", "m").list_models() for kind in ("chat", "messages", "generate")]
    assert got == [[("a", "ctx: 8"), ("b", "Available")], [("c", "Display: C")], [("d", "3B params")]]
    monkeypatch.setattr(T, "_get", lambda url, headers: {})
    with pytest.raises(T.ProviderError):
        T.HttpProvider("n", "chat", "http://h", "m").list_models()
    monkeypatch.setenv("GROQ_API_KEY", "k")
    assert cli.main(["list-models"], object()) == 0 and "groq" in capsys.readouterr().err


def test_formats_of_texts_are_carried_without_rows_for_words(spark):
    """the formats of a package's runs go along in the task that rewrites it; nothing is exploded into words or sorted by them."""
    runs = ox("<p><r><rPr><b/></rPr><t>one two </t></r><r><t>three four</t></r></p>")
    out, _ = D.translate_runs(frame(spark, package("x", document(runs))), [T.MockProvider()], "en", "de")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert [(r.text, r.rpr) for r in X.paragraphs(part(out, "x", P.DOCUMENT))[0].runs] == [("[de] four three ", ox("<rPr><b/></rPr>")), ("two one", None)]


@pytest.mark.parametrize("xml", ['<a b=">"/><c>', "<a b='x\"'>'</a>", "<!DOCTYPE a [<!ENTITY b '>'>]><a/>", "<![CDATA[a>b]]>c", "<!--a>b--><!-->--><?x>?>", "a < b <c", "<a<b><a\"b><//></>"])
def test_odd_tokens_are_those_of_the_whole_pattern(xml):
    whole = [m[0] for m in X._TOKEN.findall(xml)]
    assert [t.source for t in X.tokens(xml)] == whole and "".join(whole) == xml


def test_rows_become_python_objects_one_at_a_time():
    """a batch of any size is worked on row by row, and what was made of it sent on."""
    import pyarrow as pa

    made = []
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(50)]), pa.array([b"x" * (D.BATCH_BYTES // 4)] * 50)], names=["doc_id", "data"])
    rows = ((len(data), [made.append(doc) or (doc,)]) for doc, data in D._one_by_one(batch))
    sent = D._sent(rows, pa.schema([("doc_id", pa.string())]))
    assert len(next(sent)) == 5 and len(made) == 5
    assert sum(map(len, sent)) == 45


def test_packages_are_read_in_bounded_batches(tmp_path):
    """large packages are sent on by their bytes, not by ten thousand rows, and written from batches a row at a time."""
    import pyarrow as pa

    for k in range(8):
        (tmp_path / f"{k}.docx").write_bytes(docx.package_bytes([(P.CONTENT_TYPES, b"<Types/>"), ("word/media/a.bin", os.urandom(docx.BATCH_BYTES // 2))]))
    reader = docx._Reader({"path": str(tmp_path)})
    sent = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) and b.nbytes <= 2 * docx.BATCH_BYTES for b in sent) and len(sent) > 2
    assert sum(map(len, sent)) == 16
    assert issubclass(docx._Writer, docx.DataSourceArrowWriter)


def test_formats_of_a_long_text_take_one_pass(spark):
    """words are matched with runs and filled with formats in linear time; by overlap of all with all this took hours."""
    import time

    from quillframe.operators import formatting

    n = 30_000
    runs = spark.range(n).selectExpr("1L as pair_id", "cast(id as int) as r_idx", "concat('w', id, ' v ') as text", "cast(id % 7 as int) as format")
    text = spark.range(1).selectExpr("1L as pair_id", f"array_join(transform(sequence(0, {2 * n - 1}), x -> concat('t', x)), ' ') as text")
    edges = spark.range(n).selectExpr("1L as pair_id", "cast(id * 2 as int) as src_word", "cast(id * 2 as int) as tgt_word")
    began = time.time()
    got = formatting.transfer(runs, text, edges).orderBy("r_idx").collect()
    assert [(r.r_idx, r.text, r.format) for r in got[:2]] == [(0, "t0 t1 ", 0), (1, "t2 t3 ", 1)] and len(got) == n
    assert formatting.majority_format(runs).count() == 2 * n
    filled = formatting.fill_formats(formatting.word_spans(text), edges, formatting.majority_format(runs))
    assert {tuple(r) for r in formatting.merge_runs(text, filled).collect()} == {tuple(r) for r in got}
    assert time.time() - began < 90


def test_formats_of_any_type_are_carried(spark):
    from quillframe.operators import formatting

    for kind, a in (("string", "'x'"), ("double", "double('NaN')"), ("struct<b:boolean>", "named_struct('b', true)"), ("date", "date'2020-01-01'")):
        runs = spark.range(3).selectExpr("concat('p', id div 3) as pair_id", "cast(id as int) as r_idx", "concat('w', id, ' ') as text", f"case when id < 2 then {a} end as format")
        text, edges = spark.sql("select 'p0' as pair_id, 'a b c' as text union all select 'q', ' ' union all select 'r', ''"), spark.range(3).selectExpr("'p0' as pair_id", "cast(id as int) as src_word", "cast(id as int) as tgt_word")
        out = formatting.transfer(runs, text, edges)
        assert out.schema["format"].dataType.simpleString() == kind
        assert sorted((r.pair_id, r.r_idx, r.text, r.format is None) for r in out.collect()) == [("p0", 0, "a b ", False), ("p0", 1, "c", True), ("q", 0, " ", True)]


def test_a_transplant_reads_its_body_once_for_all_changes(spark, monkeypatch):
    """tracking, run properties and styles in one reading, the blueprint's frame once, and sources read once for both kinds of styles."""
    doc = document(ox('<p rsidR="1"><pPr><pStyle val="a"/></pPr><r><rPr><b/><sz val="4"/></rPr><t>x</t></r></p>'))
    want = X.remap_styles(X.clean_runs(X.strip_tracking(doc)[0])[0], {"a": "z"})[0]
    read, tokens = [], X.tokens
    monkeypatch.setattr(X, "tokens", lambda xml: read.append(1) or tokens(xml))
    assert X.cleaned_and_remapped(doc, {"a": "z"}) == want and len(read) == 1
    declared, used = D._declared_and_used(frame(spark, package("x", doc, styles=styles(("a", "A", None)))))
    assert [tuple(r) for r in declared.collect()] == [("x", 0, "A", "a", 1, None)] and [tuple(r) for r in used.collect()] == [("x", "a")]
