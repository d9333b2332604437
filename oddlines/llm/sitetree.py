"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same chain of tags and
classes from the root are one node of the host's style tree. Over the pages
that have a node, the entropy of its child sequences (presentation) and of its
texts (content) tells how much it varies. A node's importance is that of its
content and presentation, blended with its children's; a node that looks and
reads the same on all pages is a frame around the content. Branches of low
importance are taken out of every page of the host, if at least ``PAGES`` pages
show the node. A branch that holds more than half of a page's text stays: such
a host repeats its articles.

Markup says more where there is some: elements whose tag, role, class or id
names them as menus, headers, footers, sidebars, notices, adverts, forms or
comments are always out, and if the page has an article (or else a main
element), only that is read. Paragraphs, headings and other text elements in
an article are never taken out by themselves.

Text comes in page order, one line for each block; white space inside a block
is one space, character references are decoded. Null and empty pages and pages
without text give an empty text; a null url is a host of its own. Broken markup is read
leniently: open elements end with their parents, a tag that is not closed is
text. Pages are read whole. Repeated pages count repeatedly in the tree. An
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from oddlines.storage import materialize

PAGES = 2  # of a host must show a node before anything can be said of it
LEAST = 0.25  # importance below which a branch goes
GAMMA = 0.9  # how much the children count, a level

# Element and attribute names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
_TEXT = set("html body article main p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tr td th figure figcaption".split()) | _INLINE
_OUT = set("head nav header footer aside form menu button select option dialog template svg math canvas object audio video map".split()) | _RAW
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies"
    " respond discussion toolbar pagination pager skip".split()
)
_REMARKS = set("comment comments disqus reply replies respond discussion".split())
_PARTS = set(
    "area bar block box button content container group inner item items left links link list panel right section slot top"
    " bottom unit wrap wrapper".split()
)
_NOT = set("has is no not with without".split())  # a class that says so names something else
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main", "body", "div", "section", "td", "th"}

_SECTION = r"<!\[CDATA\[.*?\]\]>|"
_TAG, _TAG_ONLY = (re.compile(
    rf"<!--(?:.*?-->|.*\Z)|{section}<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)>",
    re.S,
) for section in (_SECTION, ""))  # the second one where no section ends any more
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


@dataclass
class Page:
    """Elements in page order (parent, style key, tag, whether markup bans it) and blocks (element, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    key: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    banned: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _names(value: str) -> Iterator[str]:
    """What the classes or the id of an element name: a single word, the last of several, or one that only says where or what part."""
    for token in value.split():
        words = _WORD.findall(token)
        if words and words[0] not in _NOT:
            yield words[-1]
            if all(w in _PARTS for w in words[1:]):
                yield words[0]


def _look(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The style of an element, and whether its markup, or only its names, ban it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, tag in _OUT, False
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")).lower())
    style = " ".join(sorted(found.get("class", "").split()))
    names = {*_names(found.get("class", "")), *_names(found.get("id", ""))}
    out = tag in _OUT or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _ROLES
    named = False
    if tag not in ("html", "body", "main"):
        out = out or not _REMARKS.isdisjoint(names)
        named = tag != "article" and not _NAMES.isdisjoint(names)
    return f"{tag}.{style}" if style else tag, out, named


def parse(page: str) -> Page:
    """One pass over a page; what an end tag or a block could close is counted, so nothing is searched for in vain."""
    out = Page()
    open_elements, holders, pending, at, end = [0], [0], [], 0, len(page)
    depth_of: Counter[str] = Counter()  # open elements of each tag
    last, last_section = page.rfind(">"), page.rfind("]]>")

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(pending)).split()) if pending else ""
        if text:
            out.blocks.append((holders[-1], text))
        pending.clear()

    def pop_to(depth: int) -> None:
        gone = open_elements[depth:]
        if any(out.tag[i] not in _INLINE for i in gone):
            close_block()
        for i in gone:
            depth_of[out.tag[i]] -= 1
            if holders[-1] >= gone[0] > 0:
                holders.pop()
        del open_elements[depth:]

    while at <= last:
        if not (m := (_TAG if at <= last_section else _TAG_ONLY).search(page, at)):
            break
        pending.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if page.startswith("<![CDATA[", m.start()):
                pending.append(entities.escape(page[m.start() + 9 : m.end() - 3]) if m.end() - 3 <= last_section else "")
            continue
        tag = m[2].lower()
        if m[1]:
            if depth_of[tag]:
                pop_to(next(d for d in range(len(open_elements) - 1, 0, -1) if out.tag[open_elements[d]] == tag))
            continue
        if tag in _ENDS_P or tag in _SAME:
            ends = {"p"} if tag in _ENDS_P else _SAME[tag]
            for d in range(len(open_elements) - 1, 0, -1) if any(depth_of[e] for e in ends) else ():
                name = out.tag[open_elements[d]]
                if name in ends:
                    pop_to(d)
                    if tag != "tr":
                        break
                elif name in _SCOPE:
                    break
        if tag == "br":
            pending.append(" ")
        if tag in _VOID:
            if tag == "hr":
                close_block()
            continue
        if tag not in _INLINE:
            close_block()
        style, banned, named = _look(tag, m[3])
        if tag == "header" and depth_of["article"]:
            banned = False  # the article's own head
        above = open_elements[-1]
        if tag in _RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        out.parent.append(above)
        out.key.append(xxhash.xxh64_intdigest(style, seed=out.key[above]) >> 1)
        out.tag.append(tag)
        out.banned.append(banned or out.banned[above])
        out.named.append(named)
        if not m[3].endswith("/"):
            open_elements.append(len(out.tag) - 1)
            depth_of[tag] += 1
            if tag not in _INLINE:
                holders.append(len(out.tag) - 1)
    pending.append(page[at:].split("<!--", 1)[0])
    close_block()
    _ban_named(out)
    return out


def _ban_named(page: Page) -> None:
    """Ban what names say, but not what holds most of the text that is left."""
    root = [-1] * len(page.tag)  # the outermost element that names ban
    for i in range(1, len(page.tag)):
        above = root[page.parent[i]]
        root[i] = above if above >= 0 else i if page.named[i] else -1
    sizes: dict[int, int] = {}
    for i, text in page.blocks:
        if not page.banned[i]:
            sizes[root[i]] = sizes.get(root[i], 0) + len(text)
    total = sum(sizes.values())
    kept = {r for r, n in sizes.items() if 2 * n > total}
    for i in range(1, len(page.tag)):
        if root[i] in kept:  # what it holds may still be named itself
            page.banned[i] = page.banned[i] or page.banned[page.parent[i]] or page.named[i] and i != root[i]
        else:
            page.banned[i] = page.banned[i] or root[i] >= 0


def styles_of(page: Page) -> Iterator[tuple[int, int, int, int]]:
    """(node, node above, presentation, content) of each style node of a page that markup does not ban."""
    children: dict[int, list[str]] = {}
    texts: dict[int, list[str]] = {}
    above: dict[int, int] = {}
    for i in range(1, len(page.tag)):
        if not page.banned[i]:
            key, over = page.key[i], page.key[page.parent[i]]
            above[key] = over
            children.setdefault(over, []).append(page.tag[i])
    for i, text in page.blocks:
        if not page.banned[i]:
            texts.setdefault(page.key[i], []).append(text)
    for key, over in above.items():
        seen = xxhash.xxh64_intdigest(" ".join(children.get(key, ()))) >> 1
        text = xxhash.xxh64_intdigest("\n".join(texts[key])) >> 1 if key in texts else 0
        yield key, over, seen, text


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, drop): the nodes of low importance of each host that has some.

    A page sends one row a node, summed up by batch; what meets by host is one row a
    node that at least ``PAGES`` pages show.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "node", "above", "seen", "text"]
        for batch in batches:
            rows = [
                (host, *row)
                for url, page in zip(batch["url"], batch["html"])
                if page
                for host in [host_of(url)]
                for row in styles_of(parse(page))
            ]
            yield pd.DataFrame(rows, columns=names).value_counts(sort=False).rename("n").reset_index()

    rows = pages.select("url", "html").mapInPandas(run, "host string, node long, above long, seen long, text long, n long")
    rows = materialize(rows.groupBy("host", "node", "above", "seen", "text").agg(F.sum("n").alias("n")), "styles")
    node = ["host", "node", "above"]
    seen = rows.groupBy(*node, "seen").agg(F.sum("n").alias("n"))
    seen = seen.groupBy(*node).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    seen = seen.filter(F.col("m") >= PAGES)
    # entropy of the child sequences to the base of the pages
    shape = seen.select(*node, "m", ((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).alias("shape"))
    text = rows.filter("text != 0").groupBy(*node, "text").agg(F.sum("n").alias("n"))
    text = text.groupBy(*node).agg(F.avg(F.log("n")).alias("logs"), F.sum("n").alias("with_text"))
    nodes = shape.join(text, node, "left").select(
        *node, "m", "shape", "with_text", (1 - F.col("logs") / F.log("m")).alias("content")
    )

    def decide(tree: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        rows = {r.node: r for r in tree.itertuples()}
        for r in rows.values():
            below.setdefault(r.above, []).append(r.node)
        order = [r for r in rows if rows[r].above not in rows]
        for n in order:
            order.extend(below.get(n, ()))
        importance: dict[int, float] = {}
        for n in reversed(order):
            r = rows[n]
            own = r.content if r.with_text == r.with_text else r.shape
            kids = below.get(n, ())
            if kids:
                weight = sum(rows[k].m for k in kids)
                inner = sum(rows[k].m * importance[k] for k in kids) / weight
                own = (1 - GAMMA) * r.shape + GAMMA * max(inner, own if r.with_text == r.with_text else 0)
            importance[n] = own
        # few pages say little: of two, only what is the same on both can go
        drop = sorted(n for n in order if importance[n] + (1 - importance[n]) / rows[n].m ** 2 <= LEAST)
        return pd.DataFrame({"host": [tree["host"].iloc[0]], "drop": [drop]})[: 1 if drop else 0]

    return nodes.groupBy("host").applyInPandas(decide, "host string, drop array<long>")


def _main_article(page: Page, inside: list[bool]) -> None:
    """Of several articles that are not inside each other keep the one with most of their text, if one has most."""
    root = [-1] * len(page.tag)
    for i in range(1, len(page.tag)):
        above = root[page.parent[i]]
        root[i] = above if above >= 0 else i if inside[i] else -1
    sizes: dict[int, int] = {}
    for i, text in page.blocks:
        if inside[i] and not page.banned[i]:
            sizes[root[i]] = sizes.get(root[i], 0) + len(text)
    first = max(sizes, key=sizes.get, default=-1)
    if len(sizes) > 1 and 2 * sizes[first] > sum(sizes.values()):
        for i in range(1, len(page.tag)):
            inside[i] = inside[i] and root[i] == first


def main_text(page: str | None, drop: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of a page without what markup bans and without the branches of these style nodes."""
    if not page:
        return ""
    found = parse(page)
    inside = [False] * len(found.tag)
    for root in ("article", "main"):
        for i in range(1, len(found.tag)):
            inside[i] = inside[found.parent[i]] or found.tag[i] == root and not found.banned[i]
        if any(inside):
            break
    article = any(inside)
    _main_article(found, inside)
    blocks = [(i, text) for i, text in found.blocks if not found.banned[i] and (inside[i] or not article)]
    if drop:
        removed = [-1] * len(found.tag)  # the outermost branch to be taken out
        for i in range(1, len(found.tag)):
            above = removed[found.parent[i]]
            low = found.key[i] in drop and not (article and found.tag[i] in _TEXT)
            removed[i] = above if above >= 0 else i if low else -1
        total, sizes = sum(len(t) for _, t in blocks), {}
        for i, text in blocks:
            sizes[removed[i]] = sizes.get(removed[i], 0) + len(text)
        blocks = [(i, t) for i, t in blocks if removed[i] < 0 or 2 * sizes[removed[i]] > total]
    return "\n".join(text for _, text in blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` to pages with ``url`` and ``html``; a column of that name is replaced."""
    pages = pages.drop("text").withColumns({c: F.col(c).cast("string") for c in ("url", "html")})
    trees = materialize(style_tree(pages), "trees").select(F.col("host").alias("_host"), F.col("drop").alias("_drop"))
    # the host as ``host_of`` reads it; the join is by size, a host's pages need not meet
    host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.withColumn("_host", F.coalesce(host, F.lit(""))).join(trees, "_host", "left").drop("_host")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drops = [frozenset() if d is None else frozenset(map(int, d)) for d in batch["_drop"]]
            texts = [main_text(page, drop) for page, drop in zip(batch["html"], drops)]
            yield batch.drop(columns="_drop").assign(text=texts)

    return joined.mapInPandas(run, schema)
