"""Main text of web pages by consensus of host paths.

A page is read once into containers and text blocks. Blocks inside menus, headers, footers, asides, adverts, forms, comments
and the like are boilerplate; the page's own choice is the deepest container that holds most of the rest, but never a plain one
inside a chosen article or main, and never one with text right next to it, which belongs to the same text. Its generalised
tag-class path is the page's vote. Votes are summed per host in Spark; pages are then read again and give the text of the
containers on the host's winning paths. A page on which no winning path holds a fair part of its text falls back to its own choice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARE = 0.6
FAIR = 0.3
# A path is a winner with this share of its host's votes, so a host has at most 1 / VOTES of them.
VOTES = 0.05
SALTS = 32

# Fixed values of HTML: elements without content, raw-text elements, elements that end a block, and implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|audio|video|select|title"
BLOCK = set("""
address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
CONTAINERS = set("html body main article section div td center".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Boilerplate by element, role, and part of a class or id.
PARTS = set("nav header footer aside form button dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set("""
ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent
disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager
pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored
subscribe subscription tags teaser toolbar topbar widget widgets
""".split())
_token = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>(?:.*?</\1\s*+>|.*\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I)
_attribute = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_blank = re.compile(r"\s+")
_number = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "parent", "boiler", "good", "own", "first", "last")

    def __init__(self, tag, path, parent, boiler, first):
        self.tag, self.path, self.parent, self.boiler, self.good, self.own, self.first, self.last = tag, path, parent, boiler, 0.0, 0.0, first, None


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _attribute.findall(text)} if text else {}


def is_boiler(tag: str, found: dict[str, str], in_article: bool) -> bool:
    if tag in PARTS and not (tag == "header" and in_article):
        return True
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    words = {w.lower() for w in _part.findall(found.get("class", "") + " " + found.get("id", ""))}
    bad = words & NAMES
    return bool(bad) and not (in_article and bad <= {"header", "tags"} and tag not in ("ul", "ol"))


def generalised(tag: str, found: dict[str, str]) -> str:
    """Tag and classes with numbers replaced; ids differ from page to page and are left out."""
    names = sorted({_number.sub("#", c.lower()) for c in found.get("class", "").split()}) if found else []
    return ".".join([tag, *names])


def read_page(source: str) -> tuple[list[Node], list[tuple[int, str, bool, int]]]:
    """Containers in page order and blocks (container, text, boilerplate, characters of links)."""
    root = Node("", "", -1, False, 0)
    nodes, blocks = [root], []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    links = linked = 0

    def end_block():
        nonlocal linked
        if pieces:
            text = _blank.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                at = stack[-1][1]
                blocks.append((at, text, nodes[at].boiler, linked))
            pieces.clear()
        linked = 0

    def close(depth: int):
        nonlocal links
        end_block()
        while len(stack) > depth:
            tag, at = stack.pop()
            if tag == "a":
                links = max(0, links - 1)
            if nodes[at].last is None and (not stack or stack[-1][1] != at):
                nodes[at].last = len(blocks)

    position = 0
    for m in _token.finditer(source):
        if m.start() > position:
            piece = source[position:m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        position = m.end()
        tag = m.group(3) or m.group(6)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2) or m.group(5):
            if tag not in BLOCK:
                if tag == "a":
                    links = max(0, links - 1)
                continue
            if tag == "p" and not any(t == "p" for t, _ in stack):
                end_block()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                end_block()
            continue
        if tag == "br" or tag == "hr":
            pieces.append(" ")
            if tag == "hr":
                end_block()
            continue
        if tag in VOID:
            continue
        if tag not in BLOCK:
            if tag == "a" and not m.group(0).endswith("/>"):
                links += 1
            if tag not in PARTS:
                continue
        end_block()
        links = 0
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        elif tag in CLOSED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SCOPES[tag]:
                    break
                if stack[depth][0] in CLOSED_BY[tag]:
                    close(depth)
                    break
        parent = stack[-1][1]
        found = attributes(m.group(4) or m.group(7) or "")
        up = nodes[parent]
        boiler = up.boiler or is_boiler(tag, found, "article" in up.path or "main" in up.path)
        if tag in CONTAINERS or boiler and not up.boiler:
            nodes.append(Node(tag, f"{up.path}>{generalised(tag, found)}", parent, boiler, len(blocks)))
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, parent))
    if position < len(source):
        pieces.append(source[position:])
    close(0)
    for node in nodes:
        if node.last is None:
            node.last = len(blocks)
    for at, text, boiler, linked_chars in blocks:
        if boiler:
            continue
        value = len(text) * max(0.0, 1.0 - linked_chars / max(1, len(text))) ** 2
        if 2 * linked_chars <= len(text):
            nodes[at].own += value
        while at >= 0:
            nodes[at].good += value
            at = nodes[at].parent
    return nodes, blocks


def inside(nodes: list[Node], node: Node, outer: Node) -> bool:
    while node.parent >= 0:
        node = nodes[node.parent]
        if node is outer:
            return True
    return False


def whole(nodes: list[Node], node: Node) -> Node:
    """The lowest container that also holds the text next to ``node`` and its ancestors: loose blocks, and further sections beside a section.

    An article or main is whole by itself, but for text beside it in an article or main around it.
    """
    best, below, found = node, node, node.tag in ("article", "main")
    while below.parent >= 0:
        up = nodes[below.parent]
        if not found or up.tag in ("article", "main"):
            beside = below.tag == "section" and any(n.parent == below.parent and n.tag == "section" and n is not below and not n.boiler and n.good > 0 for n in nodes)
            if up.own > 0 or beside or up.tag in ("article", "main") and not found:
                best = up
        found = found or up.tag in ("article", "main")
        below = up
    return best


def own_choice(nodes: list[Node]) -> Node:
    """The deepest container with most of the page's text, made whole; an article or main that holds a fair part comes first."""
    total = nodes[0].good
    best = nodes[0]
    for node in nodes[1:]:
        if not node.boiler and node.tag in CONTAINERS and node.good >= (FAIR if node.tag in ("article", "main") and best.tag not in ("article", "main") else SHARE) * total > 0:
            if node.tag in ("article", "main") or node.good >= SHARE * best.good and not (best.tag in ("article", "main") and inside(nodes, node, best)):
                best = node
    return whole(nodes, best)


def text_of_nodes(chosen: list[Node], blocks: list[tuple[int, str, bool, int]]) -> str:
    """Blocks of the containers in page order, nested containers once, boilerplate left out."""
    out, upto = [], 0
    for node in chosen:
        for at in range(max(node.first, upto), node.last):
            if not blocks[at][2]:
                out.append(blocks[at][1])
        upto = max(upto, node.last)
    return " ".join(out)


def vote(source: str) -> tuple[str, float]:
    nodes, _ = read_page(source)
    best = own_choice(nodes)
    return best.path, best.good


def extract(source: str, winners: list[str]) -> str:
    nodes, blocks = read_page(source)
    total = nodes[0].good
    for path in winners:
        chosen = [n for n in nodes if n.path == path and not n.boiler]
        if chosen and sum(n.good for n in chosen) >= FAIR * total:
            return text_of_nodes(sorted((whole(nodes, n) for n in chosen), key=lambda n: (n.first, -n.last)), blocks)
    return text_of_nodes([own_choice(nodes)], blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null html counts as empty and gives the empty text, as does a page of boilerplate only. A
    null or odd url belongs to the host of the empty name. Repeated rows vote each and get the
    same text. A page without any tag is one block.
    """
    kind = pages.select(F.col(id_col).alias("p")).schema["p"].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), "^www[.]", "").alias("host"),
    )

    def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [vote(h) for h in frame["html"]]
            yield pd.DataFrame({"host": frame["host"], "path": [g[0] for g in got], "good": [g[1] for g in got]})

    # Every page has one vote, weighted by the logarithm of its text, so that no page outvotes many.
    tallied = rows.select("host", "html").mapInPandas(votes, "host string, path string, good double").where("good > 0").groupBy("host", "path").agg(
        F.sum(F.log1p("good")).alias("weight"))
    ranked = tallied.withColumn("total", F.sum("weight").over(Window.partitionBy("host"))).where(F.col("weight") >= VOTES * F.col("total"))
    winners = ranked.groupBy("host").agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "path"))), lambda p: p["path"]).alias("winners"))
    # Hosts number far fewer than pages, yet without bound: Spark broadcasts the stored winners only if they are small; else both
    # sides shuffle, a host's pages over SALTS tasks.
    winners = materialise(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(winners, ["host", "salt"], "left")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": [
                extract(h, list(w) if w is not None else []) for h, w in zip(frame["html"], frame["winners"], strict=True)]})

    done = placed.select("page_id", "url", "html", "winners").mapInPandas(texts, "page_id string, url string, text string")
    return done.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
