"""Main text of web pages by nearest-URL page differencing.

Pages are cut into lines (the text of block elements). Each page meets the pages of its host whose URL paths
are nearest in path order (MOST of up to NEAR on either side, of other text and another path: equal pages never meet).
Their lines are aligned by longest common subsequence. Pages that share more than COPY of a page's characters are its
copies (a print or mobile version): they would take its text with them, so they don't count. A line outside an article
element goes if at least two other near pages have it and they are most of them: that is what the site's template puts
on every page. One near page alone leaves doubt (two pages may quote one sentence), so it takes only lines that both pages
begin or end with. Two pages that carry one sentence in their articles both own it, so lines inside an article stay; with
inside_articles they are deleted if there are MANY or more such pages and all of them have the line aligned, not counting copies
(pages that share half of the article's lines or more). That is for sites that put notices into their article elements.
What no page shows as text (scripts, styles, forms, what has the attribute hidden, aria-hidden=true or display:none) or what markup
itself names as navigation, header, footer, sidebar, notice, advert or comments is left out before (an article
element too, if its class or id says that it is a comment). Inside an article words of a class mostly describe the text
(related-work, a hidden-gem), so only a whole class or id that says nothing else leaves an element out. Others with such a word
are boxes, on which differencing decides: a box (comment-list, ad-slot) whose element and classes most near pages have in
their articles too belongs to the template and goes with all its lines, whatever they say; one that stands on this page alone
is text. Every page keeps all lines that differencing leaves, in or beside an article.

Null, empty and broken html give the text that can be read, at least the empty one. Rows that repeat and
pages of equal URL are extracted row by row; a null or odd URL has its own host "". A page alone on its
host has no partner and loses no line by differencing. Pages of equal text on one host count once. The order
of the pages is spread by ranges of (host, path), so no host meets in one task; the pages at the ends of the
ranges travel to their neighbours. Alignment takes memory in proportion to the lines of two pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import binary_rows, cut, shuffle_partitions, sized_broadcast, text_slices

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that may be boxes; a paragraph or heading of such a class is text.
_BOX = frozenset("div section aside ul ol dl details figure table".split())
_OUT = frozenset("nav aside footer form head button menu dialog select option label fieldset title audio video canvas map".split())
#: Pages that lose lines and may be broadcast with their deleted lines; beyond it the join shuffles.
MOST_BROADCAST = 100_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset("article main".split())
#: Whole class or id of an article that is a reader's comment; a post's article may well be of class has-comments.
_COMMENT = re.compile(r"(?:[a-z]+-)?(?:comment|comments|reply|replies)(?:-(?:body|content|item|\d+))?")
_NOT_COMMENT = frozenset("has no with post".split())
#: Pages looked at on either side of a page, in path order; how many it is aligned with; how many must share a line inside an article.
NEAR = 3
MOST = 4
MANY = 3
#: Hundredths of a page's characters that a copy of it shares at least.
COPY = 67
#: Classes and ids, as wholes, that name what is not main text inside an article.
_INSIDE = frozenset("ad ads advert adverts advertisement advertising adsense banner promo sponsor sponsored sidebar newsletter comments disqus breadcrumb breadcrumbs pagination cookie-notice share-buttons".split())
#: Words of class, id and role that name what is not main text.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar side aside rail widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments disqus replies related recommended share sharing social toolbar search pagination pager "
    "masthead topbar header complementary contentinfo skip login".split()
)


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes, the first of equal names."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _reading(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is left out by its markup, and else, inside an article, its name as a box ("": it is none)."""
    if tag in _OUT or (tag == "header" and not inside):
        return True, ""
    if not attrs or tag in ("html", "body"):
        return False, ""
    told = _attributes(attrs)
    names = [x for a in ("class", "id", "role") for x in told.get(a, "").lower().split()]
    if tag == "article" and any(_COMMENT.fullmatch(x) and x.split("-")[0] not in _NOT_COMMENT for x in names):
        return True, ""
    if tag in _MAIN:
        return False, ""
    if "hidden" in told or told.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(entities.unescape(told.get("style", ""))):
        return True, ""
    named = any(word in _WORDS for name in names for word in re.split(r"[^a-z0-9]+", name))
    if not inside:
        return named, ""
    if not _INSIDE.isdisjoint(names):
        return True, ""
    return False, " ".join([tag, *sorted(re.sub(r"[0-9]+", "#", x) for x in names)]) if named else ""


def lines(page: str) -> tuple[list[tuple[str, bool, int]], list[str]]:
    """The lines of a page that markup leaves, in order, each with whether it is inside an article or main element and the number of its box
    (the outermost; -1: none), and the boxes' names."""
    out: list[tuple[str, bool, int]] = []
    boxes: dict[str, int] = {}
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    skipped = main = 0
    box = -1

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, main > 0, box))
            held.clear()

    def pop() -> None:
        nonlocal skipped, main, box
        _, skip, core, opened = stack.pop()
        skipped -= skip
        main -= core
        box = -1 if opened else box

    at = 0
    for m in _PART.finditer(page):
        if m.start() > at and not skipped:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        block = tag in _BLOCK
        if tag == "br" and not skipped:
            held.append(" ")
        if block:
            if not skipped:
                close()
            held.clear()
        if m["end"]:
            if any(s[0] == tag for s in stack):
                if block and not skipped:
                    close()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        if tag in ("p", "li") or block:
            while stack and stack[-1][0] in (("p", "li") if tag == "li" else ("p",)):
                pop()
        skip, name = _reading(tag, m["attrs"], main > 0)
        opens = bool(name) and tag in _BOX and box < 0 and not skipped
        if opens:
            box = boxes.setdefault(name, len(boxes))
        if block or skip:
            stack.append((tag, skip, tag in _MAIN, opens))
            skipped += skip
            main += tag in _MAIN
    if at < len(page) and not skipped:
        held.append(page[at:])
    close()
    return out, list(boxes)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with b[:0], b[:1], ..."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(np.where(b == x, row[:-1] + 1, 0), row[1:]))
    return row


def _align(a: np.ndarray, b: np.ndarray, at: int, shared: np.ndarray) -> None:
    """Marks in shared the rows (a's first is row at) of a longest common subsequence, halving a so that memory stays linear."""
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        shared[at] = bool((b == a[0]).any())
        return
    half = len(a) // 2
    best = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    _align(a[:half], b[:best], at, shared)
    _align(a[half:], b[best:], at + half, shared)


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each line of a, whether it is in a longest common subsequence with b."""
    a, b = np.asarray(a), np.asarray(b)
    shared = np.zeros(len(a), np.bool_)
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[:most] != b[:most])
    lo = int(differ[0]) if len(differ) else most
    differ = np.flatnonzero(a[lo:][::-1][: most - lo] != b[lo:][::-1][: most - lo])
    hi = int(differ[0]) if len(differ) else most - lo
    shared[:lo] = True
    shared[len(a) - hi :] = True
    left, right = a[lo : len(a) - hi], b[lo : len(b) - hi]
    rows = np.flatnonzero(np.isin(left, right))
    if len(rows):
        found = np.zeros(len(rows), np.bool_)
        _align(left[rows], right[np.isin(right, left)], 0, found)
        shared[lo + rows] = found
    return shared


def address(url: str | None) -> tuple[str, str]:
    """Host and path (with the numbers padded, so that near numbers are near in order) of a URL."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or ""), parts.path
    except ValueError:
        host, path = "", url or ""
    return host, re.sub(r"\d+", lambda m: m[0].zfill(12), path)


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_PAGE = "host string, path string, content long, line binary, size binary, core binary, box binary, boxes binary"
_LINES = f"url string, print long, {_PAGE.replace('content long, ', '')}"
_NAMES = tuple(x.split()[0] for x in _PAGE.split(", "))


def read_lines(pages: DataFrame) -> DataFrame:
    """url, print (hash of the html), host, path; for each line of the page its hash, its characters, if it is inside an article, its box; the boxes' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in text_slices(batches, column=2):
            got, boxes = zip(*map(lines, b.column(2).to_pylist()), strict=True)
            hosts, paths = zip(*(address(u) for u in b.column(0).to_pylist()), strict=True)
            hashed = lambda texts: np.fromiter(map(xxh3_64_intdigest, texts), np.uint64, len(texts))
            arrays = [binary_rows([hashed([x[0] for x in g]) for g in got], "<u8"), binary_rows([np.array([len(x[0]) for x in g]) for g in got], "<u4")]
            arrays += [binary_rows([np.array([x[i] for x in g]) for g in got], kind) for i, kind in ((1, "u1"), (2, "<i4"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *arrays, binary_rows([hashed(x) for x in boxes], "<u8")], names=[x.split()[0] for x in _LINES.split(", ")])

    return _keyed(pages).select("url", "print", "html").mapInArrow(run, _LINES)


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.xxhash64("html").alias("print"), "html")


def _shared(row: tuple, near: list[tuple], inside_articles: bool) -> np.ndarray:
    """A byte for each line of row (as of _NAMES), 1 if the pages near it say that it goes."""
    host, path, _, line, size, core, box, boxes = row
    mine, size, core, box = np.frombuffer(line, "<u8"), np.frombuffer(size, "<u4"), np.frombuffer(core, np.uint8) > 0, np.frombuffer(box, "<i4")
    partners = [x for x in near if x[0] == host and x[1] != path and x[3]][:MOST]
    theirs = [np.frombuffer(x[3], "<u8") for x in partners]
    aligned = [common_lines(mine, x) for x in theirs]
    counted = [i for i, x in enumerate(aligned) if 100 * int(size[x].sum()) < COPY * int(size.sum())]
    gone = np.zeros(len(mine), np.bool_)
    if not counted:
        return gone.astype(np.uint8)
    if len(counted) == 1:
        gone = _ends(mine, theirs[counted[0]])
    else:
        votes = np.sum([aligned[i] for i in counted], axis=0)
        gone = (votes > 1) & (2 * votes > len(counted))
    others = [x for x in aligned if 2 * np.count_nonzero(x & core) < np.count_nonzero(core)]
    template = np.all(others, axis=0) if inside_articles and len(others) >= MANY else np.zeros(len(mine), np.bool_)
    own = np.frombuffer(boxes, "<u8")
    if len(own):
        votes = np.sum([np.isin(own, np.frombuffer(partners[i][7], "<u8")) for i in counted], axis=0)
        template = template | np.append(2 * votes > len(counted), False)[box]
    return np.where(core, template, gone).astype(np.uint8)


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lines of a in the head and tail that it has in common with b."""
    out = np.zeros(len(a), np.bool_)
    most = min(len(a), len(b))
    for to, x, y in ((out, a[:most], b[:most]), (out[::-1], a[::-1][:most], b[::-1][:most])):
        to[: int(np.argmin(np.append(x == y, False)))] = True
    return out


def shared_lines(pages: DataFrame, inside_articles: bool = False) -> DataFrame:
    """url, print and shared (a byte for each line, 1 if differencing deletes it) of the pages that lose lines.

    Only hashes of lines travel; pages stay where they are.
    """
    n = shuffle_partitions(pages.sparkSession)
    read = cut(read_lines(pages).withColumn("content", F.xxhash64("line", "core", "box", "boxes")), "lines")
    names, rest = _NAMES, [x for x in _NAMES if x not in ("host", "content")]
    texts = read.groupBy("host", "content").agg(F.min(F.struct(*rest)).alias("m")).select("host", "content", "m.*").select(*names)
    rows = cut(texts.repartitionByRange(n, "host", "path", "content").withColumn("part", F.spark_partition_id()), "order")
    order = Window.orderBy("part")  # one row for each partition
    beside = rows.select("part").distinct().select("part", F.lag("part").over(order).alias("before"), F.lead("part").over(order).alias("after"))
    ways = []
    for to, by in (("before", [F.col(c).asc() for c in ("host", "path", "content")]), ("after", [F.col(c).desc() for c in ("host", "path", "content")])):
        ends = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*by))).where(F.col("nth") <= NEAR)
        ways.append(ends.join(F.broadcast(beside.select("part", F.col(to).alias("to")).where("to IS NOT NULL")), "part").select(F.col("to").alias("part"), *names, F.lit(True).alias("guest")))
    guests = ways[0].unionByName(ways[1])
    both = rows.select("part", *names, F.lit(False).alias("guest")).unionByName(guests).repartition(n, "part").sortWithinPartitions("part", "host", "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["host", "content", "shared"])

        window: deque = deque([None] * (2 * NEAR + 1), 2 * NEAR + 1)
        done: list[tuple] = []

        def step(row: tuple | None) -> None:
            window.append(row)
            mid = window[NEAR]
            if mid is not None and not mid[-1]:
                turns = sorted(range(2 * NEAR + 1), key=lambda i: abs(i - NEAR))[1:]
                near = [window[i][1:-1] for i in turns if window[i] is not None and window[i][0] == mid[0]]
                gone = _shared(mid[1:-1], near, inside_articles)
                if gone.any():
                    done.append((mid[1], mid[3], gone.tobytes()))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                step(row)
                if len(done) >= 1000:
                    yield batch(done)
                    done.clear()
        for _ in range(NEAR):
            step(None)
        if done:
            yield batch(done)

    found = both.select("part", *names, "guest").mapInArrow(run, "host string, content long, shared binary")
    return read.select("url", "print", "host", "content").join(found, ["host", "content"]).select("url", "print", "shared").distinct()


def extract(pages: DataFrame, inside_articles: bool = False) -> DataFrame:
    """Per page: page_id, url, text, n_chars and n_lines (before differencing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, column=2):
            texts, counts = [], []
            for page, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                got, _ = lines(page)
                gone = shared or bytes(len(got))
                texts.append("\n\n".join(t for (t, _, _), g in zip(got, gone, strict=True) if not g))
                counts.append(len(got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_lines"])

    found = sized_broadcast(cut(shared_lines(pages, inside_articles), "shared").select(F.col("url").alias("s_url"), F.col("print").alias("s_print"), "shared"), MOST_BROADCAST)
    rows = _keyed(pages)
    same = (rows["print"] == found["s_print"]) & rows["url"].eqNullSafe(found["s_url"])
    return rows.join(found, same, "left").select("page_id", "url", "html", "shared").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines int")
