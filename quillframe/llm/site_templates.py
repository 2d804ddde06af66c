"""HTML extraction by site template removal.

Each page is parsed into elements (tags left open are closed as browsers do for the common cases), in time
linear in its length, however deep its elements and however its quotes and tags are left open. An element's
subtree is hashed from its own source, runs of white space as one space, and the hashes of its children.
Spark counts on how many pages of a host each subtree recurs; those on many pages are deleted from every page
of that host, the outermost first, and the text of what is left is extracted. Subtrees are counted by
(host, hash), so that a large host is no hot key. Pages stay where they are read: the templates, which are few
beside them, are broadcast in slices of whole hosts, with a pass over the pages of those hosts for each. Only
the pages of hosts beyond those slices move, to meet their hashes by page: no host's templates need to fit
anywhere together.
"""

from __future__ import annotations

import html as entities
import math
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Container, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import shared

#: A subtree is a template from so many pages of its host on; shorter subtrees are left alone.
MIN_PAGES, MIN_CHARS = 5, 24
#: About so many templates are broadcast at once, 8 bytes each, and so often at most. Where they are more than a slice, hosts with over a sixteenth of one are left to the join.
SLICE, PASSES = 2_000_000, 16

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(>?))", re.S)
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_HIDDEN = frozenset("head script style template noscript".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
#: Start tags that close an open element of these names first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= {b: {"p"} for b in _BLOCK - {"br", "body", "html"} if b not in _CLOSES}
_WALL = frozenset("html body div article section table ul ol dl nav aside main footer header td".split())
#: White space that isn't one single space.
_SPACE = re.compile(r"\s\s+|[^\S ]")


def collapse(source: str) -> str:
    """Runs of white space as one space, once for the whole page, so that subtrees are hashed as they stand."""
    return _SPACE.sub(" ", source)


class _OpenTags:
    """Tokens of a source in which some tag has no end; such a tag is text from its ``<`` on, the next one is tried.

    A try that fails would fail from every quote on that it came past: those are remembered, and each is
    passed once at most.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.special = [m.start() for m in _SPECIAL.finditer(source)]
        self.name_end, self.dead = -1, set()

    def _end(self, at: int) -> int:
        """Behind the ``>`` of the tag whose name ends at ``at``; -1 without one."""
        source, passed = self.source, []
        k = bisect_left(self.special, at)
        while k < len(self.special):
            q = self.special[k]
            if source[q] == ">":
                return q + 1
            if q in self.dead:
                break
            passed.append(q)
            close = source.find(source[q], q + 1)
            if close < 0:
                break
            k = bisect_left(self.special, close + 1, k)
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        source = self.source
        while (m := _TOKEN_START.search(source, at)) is not None:
            if m[2] is None:
                m = _TOKEN.match(source, m.start())
                return m.start(), m.end(), "", ""
            at = m.end()
            if self.name_end < at:
                found = _NAME_END.search(source, at)
                self.name_end = found.start() if found else len(source)
            end = self._end(self.name_end)
            if end >= 0:
                return m.start(), end, m[1], source[m.start(2) : self.name_end]
        return None


_TOKEN_START = re.compile(r"<(?:[!?]|(/?)([a-zA-Z]))")


def _tokens(source: str, at: int) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, slash, name) of the markup; the place to go on from may be sent back."""
    while m := _TOKEN.search(source, at):
        if m[2] is not None and not m[3]:
            break
        at = m.end()
        at = (yield m.start(), at, m[1] or "", m[2] or "") or at
    if m:
        rest, at = _OpenTags(source), m.start()
        while (found := rest.next(at)) is not None:
            at = (yield found) or found[1]


def _elements(source: str, hashed: bool) -> tuple[list[list], list[tuple[int, int, str]]]:
    """[name, start, end, hash] of the elements in the order of their starts, and (start, end, name) of the markup."""
    elements: list[list] = []
    markup: list[tuple[int, int, str]] = []
    stack: list[int] = []
    hashes: list = []  # of the open elements
    open_: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
    walls: list[int] = []
    n, mark = len(source), 0  # what stands from mark on isn't hashed yet

    def feed(stop: int) -> None:
        nonlocal mark
        if hashes and stop > mark:
            hashes[-1].update(source[mark:stop].encode("utf-8", "surrogatepass"))
        mark = max(mark, stop)

    def told(element: list, digest: int) -> None:
        element[3] = digest - (1 << 63)
        if hashes:
            hashes[-1].update(b"\xff" + digest.to_bytes(8, "little"))  # no byte of a text is 0xff

    def close(down_to: int, where: int) -> None:
        while len(stack) > down_to:
            element = elements[stack.pop()]
            element[2] = where
            open_[element[0]].pop()
            if element[0] in _WALL:
                walls.pop()
            if hashed:
                feed(where)
                told(element, hashes.pop().intdigest())

    tokens = _tokens(source, 0)
    found = next(tokens, None)
    while found is not None:
        start, at, slash, name = found
        name = name.lower()
        markup.append((start, at, slash + name))
        go_on = None
        if slash:
            if depths := open_[name]:
                close(depths[-1] + 1, start)
                close(depths[-1], at)
        elif name:
            if shut := _CLOSES.get(name):
                depth = max((open_[x][-1] for x in shut if open_[x]), default=-1)
                if depth >= 0 and depth >= (walls[-1] if walls else -1):
                    close(depth, start)
            element = [name, start, at, 0]
            elements.append(element)
            if name in _VOID or source[at - 2] == "/" or name in _RAW:
                if name in _RAW and name not in _VOID and source[at - 2] != "/":
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    stop, go_on = (end.start(), end.end()) if end else (n, n)
                    element[2] = go_on
                    markup.append((stop, go_on, "/" + name))
                if hashed:
                    feed(start)
                    told(element, xxhash.xxh64_intdigest(source[start : element[2]].encode("utf-8", "surrogatepass")))
                    mark = element[2]
            else:
                if hashed:
                    feed(start)
                    hashes.append(xxhash.xxh64())
                open_[name].append(len(stack))
                if name in _WALL:
                    walls.append(len(stack))
                stack.append(len(elements) - 1)
        try:
            found = tokens.send(go_on)
        except StopIteration:
            found = None
    close(0, n)
    return elements, markup


def parse(source: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]]]:
    """(name, start, end) of the elements in the order of their starts, and (start, end, name) of the markup.

    Elements left open end with their parent. An end tag without a start is only markup. A tag without an end,
    as one with an open quote, is text.
    """
    elements, markup = _elements(source, False)
    return [(name, a, b) for name, a, b, _ in elements], markup


def _can_go(name: str, length: int, min_chars: int) -> bool:
    return length >= min_chars and name not in ("html", "head", "body")


def subtree_hashes(source: str, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the elements that can be templates: not html, head and body, and not short."""
    return [(a, b, h) for name, a, b, h in _elements(collapse(source), True)[0] if _can_go(name, b - a, min_chars)]


def extract(source: str, templates: Container[int], min_chars: int = MIN_CHARS) -> tuple[str, int]:
    """The text without the outermost subtrees whose hash is a template, and how many those were."""
    source = collapse(source)
    elements, markup = _elements(source, bool(templates))
    gone, removed, end = [], 0, -1
    for name, a, b, h in elements:
        if a < end:
            continue
        hidden = name in _HIDDEN
        if hidden or (templates and h in templates and _can_go(name, b - a, min_chars)):
            gone.append((a, b))
            removed += not hidden
            end = b
    out: list[str] = []
    at, k = 0, 0
    for a, b, name in [*markup, (len(source), len(source), "")]:
        while at < a:
            while k < len(gone) and gone[k][1] <= at:
                k += 1
            if k < len(gone) and gone[k][0] <= at:
                at = min(a, gone[k][1])
                continue
            stop = min(a, gone[k][0]) if k < len(gone) else a
            piece = source[at:stop]
            out.append(" ".join(("." + entities.unescape(piece) + ".").split())[1:-1] if "&" in piece else piece)
            at = stop
        at = max(at, b)
        if name.lstrip("/") in _BLOCK:
            out.append("\n")
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def subtrees(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(page_key, host, hash) of the pages (page_key, host, html), each hash of a row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                keys, hosts, found = [], [], []
                for key, host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = {h for *_, h in subtree_hashes(source, min_chars)}
                    keys += [key] * len(own)
                    hosts += [host] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["page_key", "host", "hash"])

    pages = pages.where("html is not null and host is not null").select("page_key", "host", "html")
    return pages.mapInArrow(run, "page_key long, host string, hash long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS, min_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """All (page_key, host, hash), and (host, hash, n_pages) of those on min_pages pages and ``min_share`` of the host's pages at least.

    pages: page_key, host, html. Several rows of one page count once.
    """
    nodes = subtrees(pages, min_chars)
    counts = nodes.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    if min_share > 0:
        hosts = pages.where("html is not null and host is not null").groupBy("host").agg(F.count_distinct("page_key").alias("_all"))
        counts = counts.join(hosts, "host").where(F.col("n_pages") >= F.col("_all") * min_share).select("host", "hash", "n_pages")
    return nodes, counts


class Known:
    """The templates of many hosts, 8 bytes each: hashes in the order of their hosts' seeds."""

    def __init__(self, seeds: np.ndarray, hashes: np.ndarray) -> None:
        order = np.lexsort((hashes, seeds))
        of_host, starts = np.unique(seeds[order], return_index=True)
        self.seeds, self.starts, self.hashes = (array("q", x.astype(np.int64).tobytes()) for x in (of_host, np.append(starts, len(order)), hashes[order]))

    def of(self, seed: int) -> Container[int]:
        k = bisect_left(self.seeds, seed)
        return _Between(self.hashes, self.starts[k], self.starts[k + 1]) if k < len(self.seeds) and self.seeds[k] == seed else ()


class _Between:
    """The sorted hashes from start to end, looked up where they are."""

    def __init__(self, hashes: array, start: int, end: int) -> None:
        self.hashes, self.start, self.end = hashes, start, end

    def __contains__(self, digest: int) -> bool:
        k = bisect_left(self.hashes, digest, self.start, self.end)
        return k < self.end and self.hashes[k] == digest


def _extracted(batches: Iterator[pa.RecordBatch], found: Callable[[Any], Container[int]], min_chars: int) -> Iterator[pa.RecordBatch]:
    """page_id, host, text, n_removed of page_id, host, html and a last column of which ``found`` makes the page's templates."""
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            got = [(None, None) if source is None else extract(source, () if x is None else found(x), min_chars) for source, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([r for _, r in got], pa.int32())], names=["page_id", "host", "text", "n_removed"])


_EXTRACTED = "page_id long, host string, text string, n_removed int"


def _by_broadcast(pages: DataFrame, counts: DataFrame, min_chars: int) -> DataFrame:
    """The text of pages (page_id, host, html), where they are, by the templates (host, hash) of all their hosts."""
    held = counts.select(F.xxhash64("host").alias("seed"), "hash").toArrow()
    known = pages.sparkSession.sparkContext.broadcast(Known(held["seed"].to_numpy(), held["hash"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _extracted(batches, known.value.of, min_chars)

    return pages.select("page_id", "host", "html", F.expr("if(host is null, null, xxhash64(host))").alias("seed")).mapInArrow(run, _EXTRACTED)


def _by_join(pages: DataFrame, counts: DataFrame, min_chars: int) -> DataFrame:
    """The text of pages (page_id, host, html, page_key) by joins: of their subtrees with the templates (host, hash), and of pages with what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _extracted(batches, set, min_chars)

    per_page = subtrees(pages, min_chars).join(counts, ["host", "hash"]).groupBy("page_key").agg(F.collect_set("hash").alias("hashes"))
    return pages.join(per_page, "page_key", "left").select("page_id", "host", "html", "hashes").mapInArrow(run, _EXTRACTED)


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS, min_share: float = 0.0, slice_size: int = SLICE, passes: int = PASSES) -> DataFrame:
    """``page_id, host, text, n_removed``: one row for each row of pages (page_id, url, html).

    A subtree of at least ``min_chars`` characters is a template of its host from ``min_pages`` of its pages on, if those are
    ``min_share`` of all its pages at least: on a large host a few copies of an article aren't one. n_removed counts the deleted subtrees. A null html has a null text; an empty one an empty text. Pages
    whose url has no host keep everything, and so do hosts with fewer than ``min_pages`` pages. Rows are told apart
    by id and content: repeated rows, and rows with one id or a null one, each give their own row, and equal ones count
    as one page. ``slice_size`` and ``passes`` say how the templates travel and don't change the result.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    base = base.withColumn("page_key", F.xxhash64("page_id", "host", "html"))
    counts = shared.table(templates(base, min_pages, min_chars, min_share)[1], "templates")
    if counts.count() <= slice_size:
        return _by_broadcast(base, counts, min_chars)
    fits = F.col("n") <= slice_size // 16
    per_host = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total, large = per_host.agg(F.sum(F.when(fits, F.col("n"))), F.collect_list(F.when(~fits, F.col("host")))).first()
    slices = max(1, math.ceil((total or 0) / slice_size))
    passes = min(slices, passes)
    host = F.col("host")
    which = F.when(host.isNull(), 0).when(host.isin(large), passes).otherwise(F.least(F.pmod(F.xxhash64(host), F.lit(slices)), F.lit(passes)))
    parts = [_by_broadcast(base.where(which == k), counts.where(which == k), min_chars) for k in range(passes)]
    if large or slices > passes:
        parts.append(_by_join(base.where(which == passes), counts.where(which == passes), min_chars))
    return reduce(DataFrame.union, parts)
