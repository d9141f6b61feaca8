"""Main text of web pages: nearest-URL page differencing, with structure as a guard.

A page's blocks are its runs of text between block tags. Blocks in navigation,
headers, footers, asides, forms, hidden parts, adverts, notices, comments and the like
(by element, role, class or id) go. A class or id marks boilerplate only if all its words are marks or words of the
layout ("ad-box", not "tag-sponsored"), and never an <article> or <main>. <main> and <article> (or such roles) end all
boilerplate round them that isn't navigation, footer, aside, dialog, hidden or a comment list.

On all pages template lines among the rest are found by comparison: pages are ordered
by host and URL path, and each looks to both sides for the nearest page of its host that
has another path and isn't a near copy (two thirds of the bytes in shared lines), as only
lines that different pages share are template. Lines are aligned by a longest common
subsequence with the page of the longer common path (the earlier one in a tie), and
shared lines are deleted. Structure guards: lines in an <article> stay; lines in a <main> go only
if the page on the other side, where there is one, shares them too; a <main> all of whose
lines are shared stays, as does a page. Last, where a page marks content, that is the
text; articles shorter than what else is left are teasers, and both are the text.

Differencing alone can't do it: menus and footers may differ from page to page (as in
the test pages, where every block outside <article> is unique and boilerplate).

The order is by range partitions, so a host of any size is spread over tasks. Lines
are compared by length and 96-bit digest. A few rows at the edges of each partition, at
most twelve, pass through the driver without their texts; pages that find none in their own partition look there.

Defined results: null html is an empty page with empty text; a null or unparsable URL
has an empty host; rows that repeat a page get the same text; a page without a
neighbour loses nothing to differencing; near copies of a near copy are passed over with
it; a host all of whose pages are near copies loses nothing; empty table, empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BATCH_ROWS, default_parallelism, drop_scratch, map_batches, map_rows, materialize

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption select button".split())
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "audio", "video", "canvas", "label"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
#: Parts of class and id names that mark boilerplate.
_MARKS = set("ad ads adv advert adverts advertisement advertisements adbox adslot sponsor sponsored promo promos promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond replies disqus related recommended share sharing social widget widgets toolbar pagination pager skip banner copyright".split())
_OUTER_MARKS = _MARKS | {"header", "top", "bottom", "side"}
#: What no <main> or <article> inside makes content again; below the rest of the boilerplate either does.
_SHUT = {"nav", "footer", "aside", "dialog"}
_SHUT_ROLES = _ROLES - {"banner", "search", "form"}
_SHUT_MARKS = {"comment", "comments", "commentlist", "respond", "replies", "disqus"}
#: Words that may stand beside a mark in a name of boilerplate; beside any other the name is taken to speak of the content (tag-sponsored, social-history).
_LAYOUT = set("site page global primary secondary main left right top bottom inner outer box block bar area section list item items link links icon icons button buttons btn form text title wrapper container holder slot unit zone panel row col fixed sticky".split())
#: Beside these the name speaks of the layout or the content itself.
_INNOCENT = {"has", "no", "with", "without", "content", "main", "article", "post", "entry", "wrapper", "container", "layout", "page", "body"}


def _boilerplate(name: str, attrs: dict[str, str], in_content: bool) -> str:
    """"x" for boilerplate whose whole content goes, "-" for boilerplate that <main> and <article> end, "" for the rest."""
    if name in ("html", "body", "main"):
        return ""
    role = attrs.get("role", "").lower()
    is_content = name == "article" or role in ("article", "main")
    names = [set(re.split(r"[^a-z0-9]+", v)) for v in (*attrs.get("class", "").lower().split(), attrs.get("id", "").lower())]
    names = [parts for parts in ({w for w in parts if w and not w.isdigit()} for parts in names) if not is_content and not parts & _INNOCENT]
    if name in _SHUT or role in _SHUT_ROLES or any(parts & _SHUT_MARKS for parts in names):
        return "x"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return "x"
    if name in _DROPPED or (name == "header" and not in_content) or role in _ROLES:
        return "-"
    marks = _MARKS if in_content else _OUTER_MARKS
    return "-" if any(parts & marks and parts <= marks | _LAYOUT for parts in names) else ""


class _Tags:
    """Reads a page tag by tag; what is no tag is text.

    Time is linear in the page: a tag only begins where a ">" follows, and once a quote never closes, quotes no longer
    hold a ">" from there on.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash or "", name, attributes of the next tag; comments and declarations have no name."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, len(page) if end < 0 else end + 3, "", "", ""
            if i > self.last:  # only a comment may still begin
                at = page.find("<!--", i)
                if at < 0:
                    return None
            elif page[i + 1] in "!?":
                return i, page.find(">", i) + 1, "", "", ""
            elif m := _NAME.match(page, i, self.last + 1):
                end = _QUOTED.match(page, m.end()) if self.quotes else None
                self.quotes = end is not None
                at = end.end() if end else page.find(">", m.end()) + 1
                return i, at, m[1], m[2].lower(), page[m.end() : at - 1]
            else:
                at = i + 1
        return None


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, where) of the blocks in order.

    where is "main", "within" (an article in a main), "article" or "" for what no boilerplate element holds, "below" for an
    article that one does (a form round the page, an advert never closed), "-" or "x" for the rest. A <main> in there is a main.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, where its text belongs
    open_names: Counter = Counter()
    open_blocks: list[int] = []  # places of block elements in the stack
    parts: list[str] = []
    where, at = "", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, where))

    def cut(k: int) -> None:
        """Closes the elements from place ``k`` on."""
        for name, _ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    tags = _Tags(page)
    while tag := tags.next(at):
        begin, end, slash, name, inner = tag
        parts.append(page[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if slash:
            if open_names[name]:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                where = stack[-1][1] if stack else ""
            continue
        if name in _RAW:
            if not inner.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(page, at, max(at, tags.last + 1))
                at = close.end() if close else len(page)
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:  # an open paragraph ends here, an open item at the next one
            if open_blocks and (stack[open_blocks[-1]][0] == "p" or stack[open_blocks[-1]][0] == name == "li"):
                cut(open_blocks[-1])
            if stack and stack[-1][0] == "head":  # its end tag may be left out
                cut(len(stack) - 1)
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(inner)}
        outer = stack[-1][1] if stack else ""
        role = attrs.get("role", "").lower()
        now = _boilerplate(name, attrs, outer in ("main", "within", "article", "below"))
        if outer == "x":
            now = "x"
        elif not now:
            now = outer
            if name == "main" or role == "main":
                now = "main" if outer != "within" else outer
            elif outer == "main" and (name == "article" or role == "article"):
                now = "within"
            elif outer in ("", "-") and (name == "article" or role == "article"):
                now = "article" if outer == "" else "below"
        stack.append((name, now))
        open_names[name] += 1
        if name in _BLOCK:
            open_blocks.append(len(stack) - 1)
        where = now
    parts.append(page[at:])
    flush()
    return out


def content(page: str) -> tuple[list[str], str]:
    """Lines that structure leaves, and a letter for each: m in <main>, w in an article there, a in <article>, b in an article below boilerplate, o in none."""
    found = [(t, "o" if w == "" else w[0]) for t, w in blocks(page) if w not in ("-", "x")]
    return [t for t, _ in found], "".join(w for _, w in found)


def chosen(lines: list[str], marks: str) -> list[str]:
    """The text among what differencing left: marked content, with what else is longer than it and so no frame or teaser."""
    size = dict.fromkeys("mabo", 0)
    for x, m in zip(lines, marks, strict=True):
        size["m" if m == "w" else m] += len(x)
    if size["m"]:
        keep = {"m", "w", *(k for k in "ab" if size[k] > size["m"])}
    elif size["a"]:
        keep = {"a", *(k for k in "bo" if size[k] > size["a"])}
    else:
        keep = {"b" if size["b"] >= size["o"] else "o"}
    return [x for x, m in zip(lines, marks, strict=True) if m in keep]


def shared_lines(own: list, other: list) -> list[int]:
    """Places in ``own`` of the lines of a longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, x in enumerate(own):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(own)) - 1
    v, rows = full, []
    for y in other:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, row, col = [], len(other), len(own)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
            continue
        row -= 1
        if not (row and not rows[row - 1] >> (col - 1) & 1):
            col -= 1
            out.append(col)
    return out[::-1]


def template_lines(own: list, marks: str, first: list | None, second: list | None) -> list[int]:
    """Places of the lines to delete: those shared with ``first``; of a <main> only those shared with ``second``, if there is one, as well.

    Lines of an <article> stay, whoever shares them. A <main> all of whose lines would go stays, as does a page.
    """
    if not own or first is None:
        return []
    gone = [k for k in shared_lines(own, first) if marks[k] in "om"]
    if second is not None and any(marks[k] != "o" for k in gone):
        both = set(shared_lines(own, second))
        gone = [k for k in gone if marks[k] == "o" or k in both]
    if len(gone) == len(own):
        return []
    left = set(gone)
    if all(k in left for k, m in enumerate(marks) if m != "o"):
        gone = [k for k in gone if marks[k] == "o"]
    return gone


def _where(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").lower(), u.path or "/"
    except ValueError:
        return "", url or ""


def _line_key(line: str) -> bytes:
    """Length and digest: lines are compared by 16 bytes, so that texts needn't be sorted."""
    raw = line.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(4, "big") + hashlib.blake2b(raw, digest_size=12).digest()


def near_copies(own: tuple, other: tuple) -> bool:
    """Whether more than two thirds of the bytes of two line lists are in shared lines."""
    if own == other:
        return True
    size = lambda c: sum(int.from_bytes(x[:4], "big") * n for x, n in c.items())
    a, b = Counter(own), Counter(other)
    return 6 * size(a & b) > 2 * (size(a) + size(b))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class _Row(NamedTuple):
    host: str
    path: str
    lines: tuple
    marks: str
    key: bytes


def _passed_over(row: _Row, other: _Row, seen: dict) -> bool:
    """Whether ``other`` can't be the page to compare with for its text: it is empty or a near copy."""
    if not other.lines:
        return True
    pair = row.lines, other.lines
    if pair not in seen:
        if len(seen) > 10_000:
            seen.clear()
        seen[pair] = near_copies(*pair)
    return seen[pair]


def _nearest(rows: list[_Row]) -> tuple[list[int], list[int], list[int]]:
    """For each of some rows in order the place of the nearest earlier page of its host and another path that is no near copy; likewise of any path; the start of its path's rows.

    -1 where the host begins among the rows and has none, -2 where earlier rows may have one. Near copies are passed over with what
    they passed over, so long groups of copies cost a step or two a row.
    """
    other, any_path, starts, seen = [], [], [], {}
    low = start = 0
    for i, row in enumerate(rows):
        if i and row.host != rows[i - 1].host:
            low = start = i
        elif i and row.path != rows[i - 1].path:
            start = i
        for k, out in ((i - 1, any_path), (start - 1, other)):
            while k >= low and _passed_over(row, rows[k], seen):
                k = any_path[k]
            out.append(k if k >= low else -1 if low else -2)
        starts.append(start)
    return other, any_path, starts


def _edge(rows: list[_Row], any_path: list[int], starts: list[int]) -> list[int]:
    """Places of the rows at the end, nearest first, that stand for all others to whoever looks back from the next partition."""
    out = set()
    for k in (len(rows) - 1, starts[-1] - 1):
        for _ in range(3):
            if k >= 0 and rows[k].host == rows[-1].host:
                out.add(k)
                k = any_path[k]
    return sorted(out, reverse=True)


def _beyond(row: _Row, edges: list[tuple[int, list[_Row], bool]], seen: dict) -> _Row | None:
    """Looks through the edges of the partitions on one side, nearest first, for the page to compare with."""
    for _, found, whole in edges:
        for other in found:
            if other.host != row.host:
                return None
            if other.path != row.path and not _passed_over(row, other, seen):
                return other
        if not whole:
            return None
    return None


def _decide(row: _Row, before: _Row | None, after: _Row | None) -> list[int]:
    first, second = before, after
    if first is None or (second is not None and _common(row.path, second.path) > _common(row.path, first.path)):
        first, second = second, first
    return template_lines(list(row.lines), row.marks, first and list(first.lines), second and list(second.lines))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    page_id = pages.schema["page_id"].dataType.simpleString()

    def key(url: str | None, page: str | None) -> bytes:
        return hashlib.blake2b(f"{url is None}{len(url or '')} {url or ''}{page or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def slim(b: dict) -> dict:
        at = [_where(u) for u in b["url"]]
        got = [content(h or "") for h in b["html"]]
        return {"host": [a[0] for a in at], "path": [a[1] for a in at], "key": [key(u, h) for u, h in zip(b["url"], b["html"], strict=True)], "lines": [b"".join(map(_line_key, g[0])) for g in got], "marks": [g[1] for g in got]}

    def whole(b: dict) -> dict:
        got = [content(h or "") for h in b["html"]]
        return {"page_id": b["page_id"], "url": b["url"], "key": [key(u, h) for u, h in zip(b["url"], b["html"], strict=True)], "lines": [g[0] for g in got], "marks": [g[1] for g in got]}

    def choose(b: dict) -> dict:
        out = []
        for lines, marks, gone in zip(b["lines"], b["marks"], b["gone"], strict=True):
            less = set(gone or ())
            left = [k for k in range(len(lines)) if k not in less]
            out.append("\n".join(chosen([lines[k] for k in left], "".join(marks[k] for k in left))))
        return {"page_id": b["page_id"], "url": b["url"], "text": out}

    source = pages.select("page_id", "url", "html")
    gone = _difference(materialize(map_rows(source.select("url", "html"), slim, "host string, path string, key binary, lines binary, marks string")))
    # pages are read a second time rather than written: only their texts travel, once
    table = map_rows(source, whole, f"page_id {page_id}, url string, key binary, lines array<string>, marks string")
    text = map_rows(table.join(gone, "key", "left").select("page_id", "url", "lines", "marks", "gone"), choose, f"page_id {page_id}, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))


def _difference(table: DataFrame) -> DataFrame:
    """key, gone: the places of the lines that a page loses to the comparison with its neighbours; pages that lose none are left out."""
    spark = table.sparkSession
    order = ["host", "path", "key"]
    names = ["host", "path", "lines", "marks", "key"]
    row_type = "struct<host:string,path:string,lines:binary,marks:string,key:binary>"
    schema = f"key binary, gone array<int>, part int, side int, whole boolean, nth int, row {row_type}, before {row_type}, after {row_type}, open int"

    def pack(r: _Row | None) -> dict | None:
        return r and {**r._asdict(), "lines": b"".join(r.lines)}

    def unpack(r: dict | None) -> _Row | None:
        return r and _Row(r["host"], r["path"], tuple(bytes(r["lines"][k : k + 16]) for k in range(0, len(r["lines"]), 16)), r["marks"], bytes(r["key"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [unpack(r) for b in batches for r in b.to_pylist()]  # without texts: a partition's fit
        if not rows:
            return
        part, n = TaskContext.get().partitionId(), len(rows)
        before, any_before, starts = _nearest(rows)
        turned = rows[::-1]
        after, any_after, ends = _nearest(turned)
        out = []
        one_host = rows[0].host == rows[-1].host
        for side, given, found in ((0, rows, _edge(rows, any_before, starts)), (1, turned, _edge(turned, any_after, ends))):
            out += [{"part": part, "side": side, "whole": one_host, "nth": i, "row": pack(given[k])} for i, k in enumerate(found)]
        for i, row in enumerate(rows):
            if not row.lines or (i and row.key == rows[i - 1].key):  # rows that repeat a page lose the same
                continue
            p, q = before[i], after[n - 1 - i]
            x, y = rows[p] if p >= 0 else None, turned[q] if q >= 0 else None
            if -2 in (p, q):
                out.append({"part": part, "row": pack(row), "before": pack(x), "after": pack(y), "open": (p == -2) + 2 * (q == -2)})
            elif gone := _decide(row, x, y):
                out.append({"key": row.key, "gone": gone})
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    laid = table.repartitionByRange(default_parallelism(spark), *order).sortWithinPartitions(*order).select(names)
    done = materialize(map_batches(laid, compare, struct))
    drop_scratch(table)
    edges: dict = {}
    for r in done.where("side IS NOT NULL").select("side", "part", "whole", "nth", "row").orderBy("side", "part", "nth").collect():  # at most twelve rows of each partition
        edges.setdefault((r.side, r.part), ([], r.whole))[0].append(unpack(r.row.asDict()))
    sides = [sorted(((part, *e) for (s, part), e in edges.items() if s == side), reverse=side == 0) for side in (0, 1)]
    shared = spark.sparkContext.broadcast([[(part, [tuple(r) for r in rows], whole) for part, rows, whole in side] for side in sides])

    def finish(b: dict) -> dict:
        around = [[(part, [_Row(*r) for r in rows], whole) for part, rows, whole in side] for side in shared.value]
        near: dict = {}
        seen: dict = {}
        out = []
        for part, row, x, y, is_open in zip(b["part"], b["row"], b["before"], b["after"], b["open"], strict=True):
            row, x, y = unpack(row), unpack(x), unpack(y)
            if part not in near:
                near[part] = [e for e in around[0] if e[0] < part], [e for e in around[1] if e[0] > part]
            x = _beyond(row, near[part][0], seen) if is_open & 1 else x
            y = _beyond(row, near[part][1], seen) if is_open & 2 else y
            out.append((row.key, _decide(row, x, y)))
        out = [r for r in out if r[1]]
        return {"key": [r[0] for r in out], "gone": [r[1] for r in out]}

    ended = map_rows(done.where("open IS NOT NULL").select("part", "row", "before", "after", "open"), finish, "key binary, gone array<int>")
    return materialize(done.where("gone IS NOT NULL").select("key", "gone").unionByName(ended))  # equal keys are in one partition: one row each
