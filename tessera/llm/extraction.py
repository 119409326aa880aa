"""Main text of web pages by equivalence classes of tokens.

A token is a tag or a text node, told apart by the path of tags above it. Tokens of one host that occur equally often in
each of its pages, that is with equal occurrence vectors, form an equivalence class; a vector is kept as a sum of hashes
of (page, count), which adds up over partitions, so a host of any size is never gathered. Pages of a host with the same
tokens in the same order are copies and count once, so that no text is template for having copies. Classes with at
least two tokens in at least half of the host's pages are its template. On a page, a class is valid if its tokens
stand in the template's order and nest into the classes before it; tokens of valid classes are template, the gaps between
them are slots. What remains in the slots is the page's own; of that, the blocks that are not in menus, headers, footers,
sidebars, notices, adverts, forms or reader comments are the main text. An article or main element ranks the slots: those
inside it are the main text, unless the slots beside it hold more text; then all are. Inside it, a token is template on
LEAST_PAGES pages at least, and if template were most of the element's text, the page is one of near copies and keeps it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, read, small_batches

#: Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset(
    "nav footer aside form script style button select dialog menu iframe svg noscript template textarea title head "
    "object canvas audio video input label fieldset".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion sidebar sidebars nav "
    "navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments respond replies disqus cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social "
    "related pagination pager widget widgets toolbar copyright legal form login signup search contentinfo complementary "
    "banner skip".split())
#: Words that mark boilerplate outside an article only: articles have headers of their own.
OUTER_MARKS = frozenset("header top bottom".split())
#: Text inside an article or main element is template only if so many pages of the host, copies counted once, share it.
LEAST_PAGES = 5
#: Start tags that end an open paragraph, and elements that end an open one of their own kind.
_ENDS_P = BLOCK - frozenset("html head body li dd dt option tbody td tfoot th thead tr caption legend summary".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A text node: its place among the page's nodes, its block, its text, and where it stands."""

    __slots__ = ("block", "dropped", "kind", "path", "text")

    def __init__(self, text: str, path: str, block: int, dropped: bool, kind: str):
        self.text, self.path, self.block, self.dropped, self.kind = text, path, block, dropped, kind


def _marked(attributes: str, inside: bool) -> bool:
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _MARK.findall(value)}
            if words & MARKS or (not inside and words & OUTER_MARKS):
                return True
        elif (name == "style" and "display:none" in value.replace(" ", "").lower()) or (
                name == "aria-hidden" and value.lower() == "true"):
            return True
    return " hidden" in f" {_ATTR.sub('', attributes).lower()}"


def parsed(html: str | None) -> tuple[list[tuple[str, object]], list[Node], list[bool]]:
    """The page's tokens in order, as (path, node or None for a tag), its text nodes, and whether each token is inside an
    article or main element."""
    html = html or ""
    tokens: list[tuple[str, object]] = []
    nodes: list[Node] = []
    within: list[bool] = []
    stack: list[tuple[str, str, bool, str]] = [("", "", False, "")]  # tag, path, dropped, kind
    at, block = 0, 0

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and nodes and nodes[-1].block == block:
                nodes[-1].text += " "
            return
        _, path, dropped, kind = stack[-1]
        node = Node(entities.unescape(raw), path, block, dropped, kind)
        nodes.append(node)
        tokens.append((path, node))
        within.append(bool(kind))

    def close_to(depth: int) -> None:
        nonlocal block
        while len(stack) > depth:
            if stack.pop()[0] in BLOCK:
                block += 1

    for m in iter(lambda: _TAG.search(html, at), None):
        text(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag ends the nearest open element of its name; others are ignored
            if name in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close_to(k)
                    break
                if name == "p" and stack[k][0] in BLOCK:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if name in BLOCK:
                block += 1
            continue
        if name in _ENDS_P or name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k][0]
                if tag == "p" or tag in _SIBLINGS.get(name, ()):
                    close_to(k)
                    break
                if tag in BLOCK:
                    break
        if name in BLOCK:
            block += 1
        elif name == "br":
            text(" ")
        _, path, dropped, kind = stack[-1]
        main = name in MAIN or "articleBody" in m[3] or 'role="main"' in m[3]
        kept = kind or (name if main else "")
        gone = dropped or name in BOILERPLATE or (name == "header" and not kind) or (
            name not in ("html", "body") and bool(m[3]) and _marked(m[3], bool(kind)))
        kept = "article" if name == "article" and not gone else kept
        own = f"{path}/{name}"
        tokens.append((own, None))
        within.append(bool(kind))
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        stack.append((name, own, gone, kept if not gone else kind))
    text(html[at:].partition("<")[0] if html[at:].startswith("<") else html[at:])
    return tokens, nodes, within


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))


def keyed(tokens: list[tuple[str, object]], within: list[bool]) -> list[tuple[int, object]]:
    """Tokens with their keys: a tag by its path, a text by its path and text. Keys inside an article or main element are
    odd, others even."""
    return [((_hash(path if node is None else f"{path}\0{_SPACE.sub(' ', node.text).strip()}") >> 2) * 2 + inside, node)
            for (path, node), inside in zip(tokens, within, strict=True)]


def site(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        sites, pages, found = [], [], []
        for url, html in zip(*(batch.column(i) for i in range(2)), strict=True):
            tokens, _, within = parsed(html.as_py())
            keys = [key for key, _ in keyed(tokens, within)]
            count: dict[int, int] = {}
            first: dict[int, int] = {}
            for place, key in enumerate(keys):
                count[key] = count.get(key, 0) + 1
                first.setdefault(key, place)
            sites.append(site(url.as_py()))
            pages.append(xxhash.xxh3_128_digest(np.array(keys, np.int64).tobytes()))
            found.append([{"token": -1, "n": 1, "place": 0},  # -1 counts the pages
                          *({"token": key, "n": n, "place": first[key]} for key, n in count.items())])
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(pages, pa.binary()), pa.array(found, _FOUND)],
                                         names=["site", "page", "found"])


_FOUND = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]))


def templates(pages: DataFrame) -> DataFrame:
    """One row (site, template) for each host with a template: its classes as lists of tokens, each in the mean order of
    their first places, classes by their first token. Lengths follow the pages' and not the host's size."""
    seen = pages.select("url", "html").mapInArrow(
        _occurrences, "site string, page binary, found array<struct<token long, n int, place int>>")
    distinct = seen.groupBy("site", "page").agg(F.first("found").alias("found"))  # copies have equal tokens: any will do
    vector = F.xxhash64("page", "n")
    tokens = distinct.select("site", "page", F.inline("found")).select("site", "token", "place", vector.alias("v")).groupBy(
        "site", "token").agg(F.count("*").alias("pages"), F.sum(F.col("v").bitwiseAND(0x7FFFFFFF)).alias("low"),
                             F.sum(F.shiftrightunsigned("v", 33)).alias("high"), F.avg("place").alias("place"))
    tokens = tokens.where(f"pages > 1 and (token = -1 or token % 2 = 0 or pages >= {LEAST_PAGES})")
    of = tokens.where("token = -1").select("site", F.col("pages").alias("all"))
    classes = tokens.where("token <> -1").join(of, "site").where("pages * 2 >= all").groupBy("site", "pages", "low", "high").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members")).where(F.size("members") >= 2)
    rows = classes.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        F.col("members")[0]["place"].alias("place"), F.transform("members", lambda m: m["token"]).alias("tokens")))).alias("c"))
    return rows.select("site", F.transform("c", lambda c: c["tokens"]).alias("template"))


def fixed_nodes(tokens: list[tuple[int, object]], template: list[list[int]]) -> set[int]:
    """Places of the tokens that the template's valid classes cover on a page."""
    where: dict[int, list[int]] = {}
    for place, (key, _) in enumerate(tokens):
        where.setdefault(key, []).append(place)
    fixed: set[int] = set()
    spans: list[list[int]] = []
    for members in template:
        places = [where[t][0] for t in members if t in where]
        if len(places) < len(members) or any(a > b for a, b in zip(places, places[1:], strict=False)):
            continue  # not on this page, or out of order
        # nested: every class before either has this one in one of its gaps, or lies in one of this one's
        lo, hi = places[0], places[-1]
        if all(_in_one_gap(s, lo, hi) or _in_one_gap(places, s[0], s[-1]) for s in spans):
            spans.append(places)
            for t in members:
                fixed.update(where[t])
    return fixed


def _in_one_gap(places: list[int], lo: int, hi: int) -> bool:
    if hi < places[0] or lo > places[-1]:
        return True
    return any(a < lo and hi < b for a, b in zip(places, places[1:], strict=False))


def _length(nodes: list[Node]) -> int:
    return sum(len(n.text.strip()) for n in nodes)


def main_text(html: str | None, template: list[list[int]] | None = None) -> str:
    """The page's main text, blocks joined by line breaks."""
    tokens, nodes, within = parsed(html)
    keys = keyed(tokens, within) if template else []
    fixed = fixed_nodes(keys, template or [])
    drawn = {id(node) for place, (_, node) in enumerate(keys) if place in fixed}
    usable = [n for n in nodes if not n.dropped]
    inside = slots = [n for n in usable if id(n) not in drawn]
    for kind in ("article", "main"):
        element = [n for n in usable if n.kind == kind or (kind == "main" and n.kind)]
        if any(n.text.strip() for n in element):
            inside = [n for n in element if id(n) not in drawn]
            if 2 * _length(inside) < _length(element):
                inside = element  # near copies
            if _length([n for n in slots if not n.kind]) > _length(inside):
                chosen = {*map(id, slots), *map(id, inside)}
                inside = [n for n in usable if id(n) in chosen]
            break
    blocks: list[str] = []
    last = None
    for n in inside:
        if n.block == last:
            blocks[-1] += n.text
        else:
            blocks.append(n.text)
            last = n.block
    return "\n".join(b for b in (_SPACE.sub(" ", b).strip() for b in blocks) if b)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), t.as_py()) for h, t in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _with_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([site(u) for u in batch.column(1).to_pylist()], pa.string())],
                                         names=["page_id", "url", "html", "site"])


#: Templates of so many hosts may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_SITES = 50_000


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html). A null or empty html, and a page
    with boilerplate only, has an empty text; a null or broken url makes a host of its own. Repeated rows give repeated
    results; other columns are ignored."""
    small_batches(spark, 256)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    found = Scratch(spark, "templates").table(templates(pages), "templates")
    if found.count() <= BROADCAST_SITES:
        found = F.broadcast(found)
    rows = pages.mapInArrow(_with_site, "page_id long, url string, html string, site string").join(found, "site", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark, read(spark, sf_dir, "pages"))
