"""XML parts as token lists that join to the same bytes, and the rewrites on them.

Names are matched with their prefix as written. A token is (kind, name, source): kind is one of start,
end, empty, text, other. All nesting is followed by depth, so that text boxes inside runs are safe.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict, namedtuple
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.parsers import expat

_TOKEN = re.compile(r"(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(/?)([^\s/>]+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|lt|gt|amp|quot|apos);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
WORD_2010 = "http://schemas.microsoft.com/office/word/2010/wordml"


def made(tag: str, *inner: str, space: bool = False, **attributes: object) -> str:
    """An element of the prefix w, its attributes too; self-closing without content."""
    start = f"w:{tag}" + "".join(f' w:{k}="{v}"' for k, v in attributes.items()) + (' xml:space="preserve"' if space else "")
    return f"<{start}>{''.join(inner)}</w:{tag}>" if inner else f"<{start}/>"


def marker_style() -> str:
    return made("rPr", made("rStyle", val="FootnoteReference"))


KEPT_PROPERTIES = frozenset(f"w:{x}" for x in "b bCs i iCs u strike dstrike vertAlign highlight smallCaps allCaps em vanish".split())
TRACKING = frozenset("w14:paraId w14:textId w:rsidR w:rsidRPr w:rsidDel w:rsidRDefault w:rsidP w:rsidTr w:rsidSect".split())


class Token(namedtuple("Token", "kind name source")):
    __slots__ = ()


class Tokens(list):
    """The tokens of a source; where each element ends is found once, in one pass."""

    _ends: list[int] | None = None

    @property
    def ends(self) -> list[int]:
        if self._ends is None:
            ends, open_ = [len(self)] * len(self), defaultdict(list)
            for k, (kind, name, _) in enumerate(self):
                if kind == "start":
                    open_[name].append(k)
                elif kind == "empty":
                    ends[k] = k + 1
                elif kind == "end" and open_[name]:
                    ends[open_[name].pop()] = k + 1
            self._ends = ends
        return self._ends


#: Pieces that are tokens wherever nothing else is inside them: see _Known.
_PIECE = re.compile(r"<[^>]*>|[^<]+")
_TAG = re.compile(r"<(/?+)([^\s/>!?][^\s/>]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")


class _Known(dict):
    """Source to token; short sources that occur again are the same token. KeyError on a piece that isn't surely a token of its own."""

    def __missing__(self, s: str) -> Token:
        if s[0] != "<":
            t = Token("text", "", s)
        elif (s[:2] == "<?" and s[-2:] == "?>" and len(s) > 3) or (s[:4] == "<!--" and s[-3:] == "-->" and len(s) > 6):
            t = Token("other", "", s)
        elif m := _TAG.fullmatch(s):
            empty = s[-2] == "/"
            t = Token("end" if m[1] else "empty" if empty else "start", m[2], s)
        else:
            raise KeyError(s)
        if len(s) <= 64:
            self[s] = t
        return t


_KNOWN, _KNOWN_MOST = _Known(), 20_000

def tokens(xml: str) -> Tokens:
    pieces = _PIECE.findall(xml)
    if len(_KNOWN) > _KNOWN_MOST:
        _KNOWN.clear()
    if sum(map(len, pieces)) == len(xml):
        try:
            return Tokens(map(_KNOWN.__getitem__, pieces))
        except KeyError:
            pass
    out = Tokens()
    for s, slash, name in _TOKEN.findall(xml):
        if name:
            out.append(Token("end" if slash else "empty" if s[-2] == "/" else "start", name.rstrip("/") if s[-2] == "/" else name, s))
        else:
            out.append(Token("text" if s[0] != "<" or s.startswith("<![CDATA[") else "other", "", s))
    return out


def join(ts: list[Token]) -> str:
    return "".join(t[2] for t in ts)


def attributes(t: Token) -> list[tuple[str, str]]:
    return [(k, unescape(v[1:-1])) for k, v in _ATTR.findall(t.source[1 + len(t.name) :])]


def attribute(t: Token, name: str) -> str | None:
    return next((v for k, v in attributes(t) if k == name), None)


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] != "#":
            return _NAMED[e]
        n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
        return chr(n) if n < 0x110000 else ""

    return _ENTITY.sub(one, s)


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def text_of(t: Token) -> str:
    return t.source[9:-3] if t.source.startswith("<![CDATA[") else unescape(t.source)


def span(ts: Tokens, at: int) -> int:
    """Index behind the element that starts at ``at``; the end of the list if it is never closed."""
    return ts.ends[at]


def outermost(ts: list[Token], name: str, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Spans of the elements of this name that aren't inside another of it."""
    out, k, last = [], first, len(ts) if last is None else last
    while k < last:
        t = ts[k]
        if t[1] == name and t[0] in ("start", "empty"):
            end = span(ts, k)
            out.append((k, end))
            k = end
        else:
            k += 1
    return out


def parse_error(data: bytes) -> str | None:
    try:
        expat.ParserCreate(namespace_separator=None).Parse(data, True)
    except expat.ExpatError as e:
        return str(e)
    return None


@dataclass
class Run:
    text: str = ""
    rpr: str | None = None
    refs: list[str] = field(default_factory=list)


@dataclass
class Paragraph:
    ppr: str | None = None
    runs: list[Run] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(r.text for r in self.runs)


_REFS = ("w:footnoteReference", "w:endnoteReference")


def run_of(ts: list[Token], a: int, b: int) -> Run:
    """The run ts[a:b]: its own properties as written, the text of all it holds, and its note references."""
    run, k, inside = Run(), a + 1, False
    while k < b:
        t = ts[k]
        if t.name == "w:rPr" and t.kind in ("start", "empty") and run.rpr is None:
            end = span(ts, k)
            run.rpr = join(ts[k:end])
            k = end
            continue
        if t.name == "w:t":
            inside = t.kind == "start"
        elif t.kind == "text" and inside:
            run.text += text_of(t)
        elif t.kind in ("start", "empty") and t.name in ("w:tab", "w:br"):
            run.text += "\t" if t.name == "w:tab" else "\n"
        elif t.kind in ("start", "empty") and t.name in _REFS:
            run.refs.append(join(ts[k : span(ts, k)]))
        k += 1
    return run


def paragraph_of(ts: list[Token], a: int, b: int) -> Paragraph:
    """The outermost paragraph ts[a:b]; runs in links and revisions count, those inside runs belong to theirs."""
    p, k = Paragraph(), a + 1
    while k < b:
        t = ts[k]
        if t.name == "w:pPr" and t.kind in ("start", "empty"):
            end = span(ts, k)
            if p.ppr is None:
                p.ppr = join(ts[k:end])
            k = end
        elif t.name == "w:r" and t.kind in ("start", "empty"):
            end = span(ts, k)
            p.runs.append(run_of(ts, k, end))
            k = end
        else:
            if t.kind in ("start", "empty") and t.name in ("w:bookmarkStart", "w:bookmarkEnd"):
                leading = t.name == "w:bookmarkStart" and not p.runs
                (p.starts if leading else p.ends).append(t.source)
            k += 1
    return p


def paragraphs(xml: str) -> list[Paragraph]:
    """One for each outermost w:p, in document order."""
    ts = tokens(xml)
    return [paragraph_of(ts, a, b) for a, b in outermost(ts, "w:p")]


def run_xml(run: Run) -> str:
    text = ""
    if run.text:
        text = made("t", escape(run.text), space=run.text[0] in " \t\n\r" or run.text[-1] in " \t\n\r")
    return made("r", run.rpr or "", text, *run.refs)


def paragraph_xml(start: str, p: Paragraph) -> str:
    opened = start[:-2] + ">" if start.endswith("/>") else start
    return opened + (p.ppr or "") + "".join(p.starts) + "".join(map(run_xml, p.runs)) + "".join(p.ends) + "</w:p>"


def rebuild_paragraphs(xml: str, new: Callable[[int, Paragraph], Paragraph | None]) -> str:
    """Rebuild the paragraphs for which new(index, paragraph) gives another; others stay as they are, byte for byte. One reading."""
    ts, out, done = tokens(xml), [], 0
    for i, (a, b) in enumerate(outermost(ts, "w:p")):
        p = new(i, paragraph_of(ts, a, b))
        if p is not None:
            out += [join(ts[done:a]), paragraph_xml(ts[a].source, p)]
            done = b
    return "".join([*out, join(ts[done:])])


def replace_paragraphs(xml: str, new: list[Paragraph | None]) -> str:
    """Replacements by position."""
    return rebuild_paragraphs(xml, lambda i, _: new[i] if i < len(new) else None)


def replace_texts(xml: str, texts: list[str | None]) -> str:
    """One run without properties for each replaced paragraph, with all note references behind its text."""

    def new(i: int, p: Paragraph) -> Paragraph | None:
        t = texts[i] if i < len(texts) else None
        return None if t is None else Paragraph(p.ppr, [Run(t, None, [r for run in p.runs for r in run.refs])], p.starts, p.ends)

    return rebuild_paragraphs(xml, new)


_ANY_ATTR = re.compile(r"\s+([^\s=/>]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')")


class _Stripped(dict):
    """Token to (its source without tracking attributes, how many there were)."""

    def __missing__(self, t: Token) -> tuple[str, int]:
        s, n = t.source, 0
        if t.kind in ("start", "empty") and "w" in s:
            for m in reversed([m for m in _ANY_ATTR.finditer(s) if m[1] in TRACKING]):
                s, n = s[: m.start()] + s[m.end() :], n + 1
        self[t] = s, n
        return s, n


def strip_tracking(xml: str) -> tuple[str, int]:
    found = list(map(_Stripped().__getitem__, tokens(xml)))
    return "".join(s for s, _ in found), sum(n for _, n in found)


def _children(ts: list[Token], a: int, b: int) -> list[tuple[int, int]]:
    out, k = [], a + 1
    while k < b - 1:
        if ts[k].kind in ("start", "empty"):
            end = min(span(ts, k), b - 1)
            out.append((k, end))
            k = end
        else:
            k += 1
    return out


def _own_properties(ts: list[Token], a: int, b: int) -> tuple[int, int] | None:
    return next(((x, y) for x, y in _children(ts, a, b) if ts[x].name == "w:rPr"), None)


def _unkept(ts: Tokens) -> tuple[set[int], int]:
    """The tokens of run properties that aren't kept, and how many properties that are."""
    drop, n = set(), 0
    refs = [k for k, t in enumerate(ts) if t[1] in ("w:footnoteReference", "w:footnoteRef")]
    for a, t in enumerate(ts):
        if t[1] == "w:r" and t[0] == "start":
            b = span(ts, a)
            if bisect_left(refs, a) < bisect_left(refs, b):
                continue
            own = _own_properties(ts, a, b)
            for x, y in _children(ts, *own) if own and ts[own[0]].kind == "start" else ():
                if ts[x].name not in KEPT_PROPERTIES:
                    drop.update(range(x, y))
                    n += 1
    return drop, n


def clean_runs(xml: str) -> tuple[str, int]:
    """Drop properties that aren't kept from runs without a footnote reference; n counts those dropped, not what is inside them."""
    ts = tokens(xml)
    drop, n = _unkept(ts)
    return "".join(t.source for k, t in enumerate(ts) if k not in drop), n


def cleaned_and_remapped(xml: str, mapping: dict[str, str]) -> str:
    """``strip_tracking``, ``clean_runs`` and ``remap_styles``, in this order, in one reading."""
    stripped, ts = _Stripped(), Tokens()
    for t in tokens(xml):
        s, n = stripped[t]
        try:
            ts.append(_KNOWN[s] if n else t)
        except KeyError:
            ts += tokens(s)
    drop, _ = _unkept(ts)
    return "".join(_remapped(t, mapping) for k, t in enumerate(ts) if k not in drop)


def _bold(t: Token) -> bool:
    return t.kind in ("start", "empty") and t.name in ("w:b", "w:bCs") and attribute(t, "w:val") not in ("0", "false")


def strip_paragraph_bold(xml: str) -> tuple[str, int]:
    """Where every run of a paragraph is bold, drop that; n counts paragraphs."""
    ts, drop, n = tokens(xml), set(), 0
    for a, b in outermost(ts, "w:p"):
        found = []
        for x, y in outermost(ts, "w:r", a + 1, b):
            own = _own_properties(ts, x, y)
            found.append([c for c in _children(ts, *own) if _bold(ts[c[0]])] if own and ts[own[0]].kind == "start" else [])
        if found and all(found):
            n += 1
            drop.update(k for f in found for x, y in f for k in range(x, y))
    return "".join(t.source for k, t in enumerate(ts) if k not in drop), n


def styles(xml: str) -> list[tuple[int, str | None, str, int, int | None]]:
    """(ord, name, style_id, type_val, outline_level) of the styles that aren't self-closing."""
    ts, out = tokens(xml), []
    kinds = {"paragraph": 1, "character": 2, "table": 3, "numbering": 4}
    for a, b in outermost(ts, "w:style"):
        if ts[a].kind == "empty":
            continue
        name = outline = None
        for t in ts[a + 1 : b]:
            if t.kind in ("start", "empty") and t.name == "w:name":
                name = attribute(t, "w:val")
            if t.kind in ("start", "empty") and t.name == "w:outlineLvl":
                v = attribute(t, "w:val") or ""
                outline = int(v) if v.isdigit() else None
        sid = attribute(ts[a], "w:styleId") or ""
        out.append((len(out), name or sid, sid, kinds.get(attribute(ts[a], "w:type") or "", 0), outline))
    return out


def body_styles(xml: str) -> list[str]:
    return sorted({v for t in tokens(xml) if t.kind in ("start", "empty") and t.name == "w:pStyle" and (v := attribute(t, "w:val"))})


def _remapped(t: Token, mapping: dict[str, str]) -> str:
    """The token's source, with another style where it is a paragraph style that changes."""
    old = attribute(t, "w:val") if t[1] == "w:pStyle" and t[0] != "end" else None
    if old is None or mapping.get(old, old) == old:
        return t.source
    return re.sub(r"w:val\s*=\s*(?:\"[^\"]*\"|'[^']*')", lambda _: f'w:val="{escape(mapping[old])}"', t.source)


def remap_styles(xml: str, mapping: dict[str, str]) -> tuple[str, int]:
    """New values of w:pStyle; n counts those that changed."""
    n, out = 0, []
    for t in tokens(xml):
        new = _remapped(t, mapping)
        n += new is not t.source
        out.append(new)
    return "".join(out), n


def restyle_paragraphs(xml: str, ids: dict[int, str], insert_missing: bool = False) -> tuple[str, int]:
    """Paragraph index to style id: replaces the style that a paragraph has; inserts one only if asked."""
    ts, n, edits = tokens(xml), 0, {}
    for i, (a, b) in enumerate(outermost(ts, "w:p")):
        if i not in ids:
            continue
        new = made("pStyle", val=escape(ids[i]))
        ppr = next(((x, y) for x, y in _children(ts, a, b) if ts[x].name == "w:pPr"), None)
        old = next(((x, y) for x, y in _children(ts, *ppr) if ts[x].name == "w:pStyle"), None) if ppr and ts[ppr[0]].kind == "start" else None
        if old:
            edits[old[0]] = (old[1], new)
            n += 1
        elif insert_missing and ts[a].kind == "start":
            at = ppr[0] + 1 if ppr and ts[ppr[0]].kind == "start" else a + 1
            edits[at] = (at, new if ppr else made("pPr", new))
            n += 1
    out, k = [], 0
    while k < len(ts):
        if k in edits:
            stop, new = edits.pop(k)
            out.append(new)
            k = stop
        else:
            out.append(ts[k].source)
            k += 1
    return "".join(out), n


def formatted_runs(xml: str) -> list[tuple]:
    """(p_idx, r_idx, text, bold, size, ppr_bold, ppr_size, style_id) for heading inference; a paragraph without runs has r_idx -1."""
    ts, out = tokens(xml), []

    def props(a: int, b: int) -> tuple[bool, float | None]:
        bold, size = False, None
        for t in ts[a:b]:
            if t.kind == "empty" and t.name == "w:b":
                bold = attribute(t, "w:val") not in ("0", "false")
            if t.kind == "empty" and t.name == "w:sz":
                try:
                    size = float(attribute(t, "w:val") or "") / 2
                except ValueError:
                    pass
        return bold, size

    for i, (a, b) in enumerate(outermost(ts, "w:p")):
        style, ppr = None, (False, None)
        for x, y in _children(ts, a, b):
            if ts[x].name == "w:pPr":
                ppr = props(x, y)
                style = next((attribute(t, "w:val") for t in ts[x:y] if t.kind in ("start", "empty") and t.name == "w:pStyle"), None)
        runs = outermost(ts, "w:r", a + 1, b)
        for k, (x, y) in enumerate(runs):
            own = _own_properties(ts, x, y)
            bold, size = props(*own) if own else (False, None)
            out.append((i, k, run_of(ts, x, y).text, bold, size, *ppr, style))
        if not runs:
            out.append((i, -1, "", False, None, *ppr, style))
    return out


def points(twips: str | None) -> float | None:
    try:
        return round(float(twips) / 20 * 100 + 1e-9) / 100
    except (TypeError, ValueError):
        return None


def sections(xml: str) -> list[dict]:
    """Geometry of every section, in points."""
    ts, out = tokens(xml), []
    for a, b in outermost(ts, "w:sectPr"):
        s = dict.fromkeys("page_width page_height top bottom left right header footer gutter orientation".split())
        for t in ts[a:b]:
            if t.kind in ("start", "empty") and t.name == "w:pgSz":
                s |= {"page_width": points(attribute(t, "w:w")), "page_height": points(attribute(t, "w:h")), "orientation": attribute(t, "w:orient")}
            if t.kind in ("start", "empty") and t.name == "w:pgMar":
                s |= {k: points(attribute(t, f"w:{k}")) for k in ("top", "bottom", "left", "right", "header", "footer", "gutter")}
        out.append({"section": len(out), **s})
    return out


def defaults(xml: str) -> tuple[str, float]:
    """Font and size of the document's defaults or its Normal style, whichever comes first; Times New Roman, 12 points."""
    ts, font, size = tokens(xml), None, None
    spans = [s for d in outermost(ts, "w:docDefaults") for s in outermost(ts, "w:rPr", *d)]
    spans += [s for d in outermost(ts, "w:style") if attribute(ts[d[0]], "w:styleId") == "Normal" for s in outermost(ts, "w:rPr", *d)]
    for a, b in sorted(spans):
        for t in ts[a:b]:
            if t.kind in ("start", "empty") and t.name == "w:rFonts":
                font = font or attribute(t, "w:ascii")
            if t.kind in ("start", "empty") and t.name == "w:sz" and size is None:
                v = attribute(t, "w:val") or ""
                size = float(v) / 2 if v.replace(".", "", 1).isdigit() else None
    return font or "Times New Roman", 12.0 if size is None else size


def body_slice(xml: str) -> tuple[str, str, str, str]:
    """(head with the body's start tag, inner body, its own last section properties, tail)."""
    ts = tokens(xml)
    found = outermost(ts, "w:body")
    if not found:
        raise ValueError("no w:body")
    a, b = found[0]
    if ts[a].kind == "empty":
        return join(ts[:a]) + ts[a].source[:-2] + ">", "", "", "</w:body>" + join(ts[b:])
    children = _children(ts, a, b)
    last = children[-1] if children and ts[children[-1][0]].name == "w:sectPr" else (b - 1, b - 1)
    return join(ts[: a + 1]), join(ts[a + 1 : last[0]]), join(ts[last[0] : last[1]]), join(ts[last[1] :])


def first_paragraph_runs(xml: str) -> list[tuple]:
    """(note_id, r_idx, is_marker, has_tab, text, format) of the first paragraph of each note."""
    ts, out = tokens(xml), []
    for a, b in outermost(ts, "w:footnote"):
        v = attribute(ts[a], "w:id") or ""
        paras = outermost(ts, "w:p", a + 1, b)
        if not v.lstrip("-").isdigit() or not paras:
            continue
        for k, (x, y) in enumerate(outermost(ts, "w:r", paras[0][0] + 1, paras[0][1])):
            names = {t.name for t in ts[x:y]}
            text = "".join(text_of(t) for t in ts[x:y] if t.kind == "text")
            out.append((int(v), k, "w:footnoteRef" in names, "w:tab" in names, text, run_of(ts, x, y).rpr))
    return out


def footnote_format(xml: str, sample: int = 3) -> tuple[str | None, str | None]:
    """(marker properties, separator) of the first notes; (None, None) without any numbered note."""
    rows = [r for r in first_paragraph_runs(xml) if r[0] > 0]
    ids = list(dict.fromkeys(r[0] for r in rows))[:sample]
    if not ids:
        return None, None
    fmt = sep = None
    for i in ids:
        own = [r for r in rows if r[0] == i]
        k = next((k for k, r in enumerate(own) if r[2]), None)
        if k is None:
            continue
        fmt = fmt or own[k][5]
        if sep is None and k + 1 < len(own):
            n = own[k + 1]
            sep = "\t" if n[3] else "" if n[4].strip() else n[4]
    return fmt, sep or ""


def separator_xml(wanted: str, payload_only: bool = False) -> str:
    inner = made("tab") if wanted == "\t" else made("t", escape(wanted), space=" " in wanted)
    return inner if payload_only else made("r", inner)


def apply_footnote_format(xml: str, marker: str | None, separator: str | None) -> tuple[str, int]:
    """Marker properties and separator of the first paragraph of every numbered note; n counts notes touched."""
    ts, edits, n = tokens(xml), [], 0
    for a, b in outermost(ts, "w:footnote"):
        v = attribute(ts[a], "w:id") or ""
        paras = outermost(ts, "w:p", a + 1, b)
        if not v.isdigit() or int(v) <= 0 or not paras:
            continue
        runs = outermost(ts, "w:r", paras[0][0] + 1, paras[0][1])
        m = next((k for k, (x, y) in enumerate(runs) if any(t.name == "w:footnoteRef" for t in ts[x:y])), None)
        if m is None:
            continue
        touched, (x, y) = False, runs[m]
        if marker is not None:
            own = _own_properties(ts, x, y)
            edits.append((*(own or (x + 1, x + 1)), marker))
            touched = True
        if separator is not None and m + 1 < len(runs):
            touched = True
            c, d = runs[m + 1]
            tab = any(t.name == "w:tab" for t in ts[c:d])
            text = "".join(text_of(t) for t in ts[c:d] if t.kind == "text")
            if not tab and text.strip():
                edits += [(c, c, separator_xml(separator))] if separator else []
            elif not separator or not ((tab and separator == "\t") or (not tab and text == separator)):
                kept = "".join(t.source for t in ts[c : d - 1] if t.kind != "text" and t.name not in ("w:t", "w:tab"))
                edits.append((c, d, kept + (separator_xml(separator, True) if separator else "") + ts[d - 1].source))
        elif separator:
            edits.append((y, y, separator_xml(separator)))
            touched = True
        n += touched
    out, k = [], 0
    for a, b, new in sorted(edits):
        out += [join(ts[k:a]), new]
        k = b
    return "".join([*out, join(ts[k:])]), n


_MARKER = re.compile(r"\[([0-9]+)\]")


def inject_references(xml: str, notes: set[int]) -> tuple[str, list[int], list[int]]:
    """Markers [N] of known notes in the text of runs become references: (xml, ids in order of use, all cited ids).

    Run properties and everything else in the run stay; the run is cut at the markers.
    """
    ts, out, used, cited, k = tokens(xml), [], [], [], 0

    def ref(i: int) -> str:
        return made("r", marker_style(), made("footnoteReference", id=i))

    while k < len(ts):
        t = ts[k]
        if t.kind != "start" or t.name != "w:r":
            out.append(t.source)
            k += 1
            continue
        end = span(ts, k)
        own = _own_properties(ts, k, end)
        rpr = join(ts[own[0] : own[1]]) if own else ""
        part, depth = [], 0
        for j in range(k, end):
            x = ts[j]
            if x.kind in ("start", "end"):
                depth += 1 if x.kind == "start" else -1
            inside = x.kind == "text" and ts[j - 1].name == "w:t" and depth == 2
            if not inside or not _MARKER.search(x.source):
                part.append(x.source)
                continue
            at, source = 0, x.source
            for m in _MARKER.finditer(source):
                i = int(m[1])
                cited.append(i)
                if i not in notes:
                    continue
                used.append(i)
                part += [source[at : m.start()], "</w:t></w:r>", ref(i), t.source, rpr, '<w:t xml:space="preserve">']
                at = m.end()
            part.append(source[at:])
            if at:
                part = ["".join(part)]
        run = "".join(part)
        if len(run) != sum(len(x.source) for x in ts[k:end]):
            run = re.sub(re.escape(t.source + rpr) + r'<w:t(?: xml:space="preserve")?></w:t></w:r>', "", run)
            run = re.sub(r"<w:t>(?=[ \t\n])|<w:t>(?=[^<]*[ \t\n]</w:t>)", '<w:t xml:space="preserve">', run)
        out.append(run)
        k = end
    return "".join(out), used, cited
