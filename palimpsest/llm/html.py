"""Main text of web pages: lines by markup, then differencing against the page with the nearest URL.

*Lines.*  A page is read once from left to right, as browsers do.  What stands in
menus, footers, scripts, comments and the like goes; what stands in an element
that the page marks as its article is article; all other lines are open.

*Differencing.*  Pages of a host with the same open lines are one.  Each is paired
with its neighbours in the order of URL paths, the one with the longer common
prefix first; their open lines are aligned by a longest common subsequence, and
shared lines are deleted as template.  A neighbour that shares more than half of
the page's characters is a copy of it and tells nothing, so the other neighbour
is asked; if that is a copy too, the lines stay.

*Text.*  The article's lines; or all that is left, in page order, if a page marks no
article or marks a teaser only (open lines hold more than ``TEASER`` times its
characters).  Lines in a form count only on pages that have no others.
"""

from __future__ import annotations

import hashlib
import html
import os.path
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X
from .order import successors
from .urls import host_of, path_of

# Element names of HTML by their role here.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
FOREIGN = frozenset(("svg", "math"))
DROPPED = frozenset(("nav", "footer", "aside", "button", "select", "datalist", "dialog", "menu", "head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
))
#: Elements that the start of one of the others ends.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class and id names of parts that are not the article, words that may stand beside them, and roles.
PARTS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "aside", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar",
    "header", "masthead", "footer", "foot", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "respond", "replies", "discussion", "share", "sharing",
    "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "skip",
))
BESIDE = frozenset((
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "fixed", "form", "global", "group", "heading", "icon", "icons", "inner", "item", "items", "js", "label",
    "large", "left", "link", "links", "list", "main", "media", "mobile", "outer", "page", "panel", "post", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "story", "stories", "text",
    "title", "to", "top", "unit", "user", "users", "widget", "widgets", "wrap", "wrapper",
))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
ARTICLE = frozenset(("articlebody", "article-body", "article-content", "article-text", "post-content", "post-body", "entry-content", "story-body", "main-content"))
#: How much larger the open lines are where a marked article is a teaser.
TEASER = 3
# a quote opens a value only after an equals sign
_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|[^<]+|<", re.S)
_BARE = re.compile(r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

ARTICLE_LINE, OPEN_LINE, FORM_LINE = 1, 0, 2
_NONE, _ARTICLE, _FORM, _DROP = 0, 1, 2, 3


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _is_part(names: str, within: bool) -> bool:
    for name in names.split():
        words = {w.lower() for w in _NAME_WORDS.findall(name)}
        found = words & PARTS
        if within:
            found -= {"header", "footer", "foot"}
        if found and words - found <= BESIDE:
            return True
    return False


def _role(tag: str, attributes: str, within: bool) -> int:
    """What an element is, if it says so; ``within`` an article, headers belong to it."""
    a = _attributes(attributes) if attributes.strip(" /\n\t\r\f") else {}
    role = a.get("role", "").lower()
    if tag in DROPPED or (tag == "header" and not within) or role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return _DROP
    if tag == "form":
        return _FORM
    names = f"{a.get('class', '')} {a.get('id', '')}"
    marked = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody" or not ARTICLE.isdisjoint(names.lower().split())
    if tag not in ("body", "html", "main", "h1", "h2", "h3", "h4", "h5", "h6") and _is_part(names, within) and (within or not marked or "comment" in names.lower()):
        return _DROP
    return _ARTICLE if marked else _NONE


def lines_of(page: str) -> list[tuple[str, int]]:
    """Lines in page order, each with what its markup says: ARTICLE_LINE, OPEN_LINE or FORM_LINE."""
    lines: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # (element, state around it)
    depth: dict[str, int] = defaultdict(int)  # open elements by name
    state = _NONE

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((text, ARTICLE_LINE if state == _ARTICLE else FORM_LINE if state == _FORM else OPEN_LINE))

    def close(n: int) -> None:
        nonlocal state
        while len(stack) > n:
            tag, around = stack[-1]
            if tag in BLOCKS or around != state:
                end_block()
            depth[tag] -= 1
            stack.pop()
            state = around

    def close_innermost(names: set | frozenset | tuple, within: int = 1 << 30) -> None:
        for k in range(len(stack) - 1, max(-1, len(stack) - 1 - within), -1):
            if stack[k][0] in names:
                close(k)
                return

    at, size, quotes = 0, len(page), True
    while at < size:
        m = (_TOKEN if quotes else _BARE).match(page, at)
        if quotes and m[0] == "<" and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            quotes = False  # a tag that never ends, as its quotes stand: from here on a tag ends at the next bracket
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?") and state != _DROP:
                held.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if depth[tag]:
                close_innermost((tag,))
            if tag in BLOCKS and state != _DROP:
                end_block()
            continue
        if tag in ("br", "td", "th") and state != _DROP:
            held.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            if depth["svg"] or depth["math"]:  # HTML breaks out of drawings
                close_innermost(FOREIGN)
            if depth["p"]:
                close_innermost(("p",), 4)
        if tag in IMPLIED and stack and stack[-1][0] in IMPLIED[tag]:
            close(len(stack) - 1)
        if tag in BLOCKS and state != _DROP:
            end_block()
        if tag in VOID or (m[3].endswith("/") and (depth["svg"] or depth["math"] or tag in FOREIGN)):
            continue
        role = _role(tag, m[3], state == _ARTICLE) if state != _DROP else _NONE
        if role:
            end_block()
        stack.append((tag, state))
        depth[tag] += 1
        state = role or state
    close(0)
    end_block()
    return lines


def main_lines(lines: list[tuple[str, int]], shared: frozenset | set = frozenset()) -> list[str]:
    """The text's lines; ``shared`` are positions among the open lines that differencing deletes."""
    opened = [k for k, (_, mark) in enumerate(lines) if mark == OPEN_LINE]
    left = {k for n, k in enumerate(opened) if n not in shared}
    article = sum(len(x) for x, mark in lines if mark == ARTICLE_LINE)
    if article and sum(len(lines[k][0]) for k in left) <= TEASER * article:
        left = set()
    kept = [x for k, (x, mark) in enumerate(lines) if mark == ARTICLE_LINE or k in left]
    return kept or ([] if opened else [x for x, _ in lines])


def _prefix_lengths(own: list, other: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``own`` with every prefix of ``other``, from the empty one.

    Bits of one long number stand for the lines of ``other``: a bit is clear where the
    length grows, so each line of ``own`` is a few operations on it.
    """
    at: dict = defaultdict(int)
    for j, x in enumerate(other):
        at[x] |= 1 << j
    n = len(other)
    full = (1 << n) - 1
    v = full
    for x in own:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    grows = np.unpackbits(np.frombuffer((full ^ v).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(grows)))


def shared_lines(own: list, other: list) -> list[int]:
    """Positions in ``own`` of a longest common subsequence of both, in memory that grows with their lengths alone.

    ``own`` is halved, ``other`` is cut where both halves share most, and so on.
    """
    out: list[int] = []
    todo = [(0, own, other)]
    while todo:
        start, a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            out += [start] * (a[0] in b)
            continue
        half = len(a) // 2
        cut = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(start, a[:half], b[:cut]), (start + half, a[half:], b[cut:])]
    return sorted(out)


def template_lines(own: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[int] | None:
    """Positions of shared lines, of (name, characters) lines; None if the pages are copies."""
    shared = shared_lines([x[0] for x in own], [x[0] for x in other])
    total = sum(x[1] for x in own)
    return None if 2 * sum(own[k][1] for k in shared) > total else shared


_LINE = np.dtype([("name", "<i8"), ("size", "<i4")])


def _open_blob(lines: list[tuple[str, int]]) -> bytes:
    return np.array([(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(x)) for x, mark in lines if mark == OPEN_LINE], _LINE).tobytes()


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, text, n_chars) of the pages without open lines."""
    for b in batches:
        rows = []
        for k, page in enumerate(b.column("html").to_pylist()):
            lines = lines_of(page or "")
            if all(mark != OPEN_LINE for _, mark in lines):
                text = "\n".join(main_lines(lines))
                rows.append((k, text, len(text)))
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("url").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["id", "url", "text", "n_chars"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, lines, marks, face, open) of the pages with open lines; equal open lines have equal faces."""
    for b in batches:
        rows = []
        for k, page in enumerate(b.column("html").to_pylist()):
            lines = lines_of(page or "")
            if any(mark == OPEN_LINE for _, mark in lines):
                blob = _open_blob(lines)
                rows.append((k, [x for x, _ in lines], bytes(mark for _, mark in lines), hashlib.blake2b(blob, digest_size=16).digest(), blob))
        at = pa.array([r[0] for r in rows], pa.int64())
        kinds = (pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("url").take(at), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=["id", "url", "lines", "marks", "face", "open"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for lines, marks, gone in zip(b.column("lines").to_pylist(), b.column("marks").to_pylist(), b.column("gone").to_pylist(), strict=True):
            out.append("\n".join(main_lines(list(zip(lines, marks, strict=True)), set(gone or ()))))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars): the article's blocks in page order, joined by a newline.

    Null html has an empty text.  Repeated pages are each extracted, and pages with
    null ids or URLs are kept; a page whose host is empty has no neighbours.
    Columns of other names are left out; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    X.prepare(spark)
    known = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"
    opened = known.mapInArrow(_opened, f"id {kind}, url string, lines array<string>, marks binary, face binary, open binary")
    opened = X.checkpoint(opened.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    judged = opened.drop("open").join(_template(opened), ["host", "face"], "left").select("id", "url", "lines", "marks", "gone").mapInArrow(_joined, schema)
    done = known.mapInArrow(_decided, schema).unionByName(judged)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _template(opened: DataFrame) -> DataFrame:
    """(host, face, gone): the positions of the open lines that a page shares with its neighbour."""
    faces = X.checkpoint(opened.filter("host <> ''").groupBy("host", "face").agg(F.min("path").alias("path"), F.first("open").alias("open")))
    after = successors(faces.select("host", "path", "face"), ["host", "path", "face"]).filter("host = next_host")
    one = after.select("host", "face", "path", F.col("next_face").alias("other"), F.col("next_path").alias("other_path"))
    both = one.unionByName(one.select("host", F.col("other").alias("face"), F.col("other_path").alias("path"), F.col("face").alias("other"), F.col("path").alias("other_path")))
    lines = faces.select("host", F.col("face").alias("other"), F.col("open").alias("other_open"))
    asked = both.join(lines, ["host", "other"]).groupBy("host", "face").agg(F.collect_list(F.struct("path", "other_path", "other_open")).alias("near"))  # two at most

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for own, near in zip(b.column("open").to_pylist(), b.column("near").to_pylist(), strict=True):
                mine = np.frombuffer(own, _LINE).tolist()
                near.sort(key=lambda x: (-len(os.path.commonprefix([x["path"], x["other_path"]])), x["other_path"], x["other_open"]))
                found = (template_lines(mine, np.frombuffer(x["other_open"], _LINE).tolist()) for x in near)
                gone.append(next((x for x in found if x is not None), []))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("face"), pa.array(gone, pa.list_(pa.int32()))], names=["host", "face", "gone"])

    pairs = faces.select("host", "face", "open").join(asked, ["host", "face"])
    return pairs.mapInArrow(align, "host string, face binary, gone array<int>")
