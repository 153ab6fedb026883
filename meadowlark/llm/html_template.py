"""HTML extraction by deducing each host's page template from equivalence classes of tokens.

Tokens are a page's elements (told apart by their path and class) and its text blocks. Tokens that occur equally often
in every page of a host form an equivalence class; large and frequent classes whose texts lie in frequent elements
are nested into the host's template. What the template doesn't fix are slots; the main text is what stands in
the slots, inside articles and outside, without those in menus, notices and the like. Tags and class words are a check:
text in an article goes only where it is the lesser part of the page's articles, and a class word on an element that holds
the page's article, or nearly all of its text, counts for nothing.

Occurrence vectors are never gathered: a token's vector is summed up as one number over pages, so a host with a third of
all pages is just another key of a partial aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import durable

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|"""
    r"""<(?P<raw>script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|"""
    r"""<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*|[^<>]*)>""",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: HTML's void elements, its elements that stand for blocks, and those that hold no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav footer aside menu head iframe object svg canvas button select option dialog audio video search map datalist".split())
MARKS = set(
    "ad adbox ads advert adverts advertisement advertising alert alerts banner billboard breadcrumb breadcrumbs comment commentlist comments consent cookie cookies "
    "disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices popup promo promotion related remarks replies respond share sharing "
    "sidebar social sponsor sponsored subscribe widget complementary contentinfo search".split()
)
#: Marks outside articles alone; inside they may name a part of the text.
OUTSIDE_MARKS = {"discussion"}
#: A marked element that holds more than this share of a page's text is no aside, where no article says what the text is.
WHOLE_SHARE = 0.75
#: Words that may stand beside a mark in a class of an article's part; with any other word the class names content.
BESIDE = set("area articles bar block body box buttons container form item items left links list main post posts right section stories thread top wrap wrapper".split())
#: Elements that are closed by the start of one of the others.
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ARTICLE = {"article", "main"}
_WORDS = re.compile(r"[a-z0-9]+")


def _is_marked(labels: list[str], whole: bool) -> bool:
    """Whether a class, id or role names a menu, notice or the like: by any of its words, or only by all (``whole``)."""
    for label in labels:
        found = set(_WORDS.findall(label))
        if found & MARKS and (not whole or found <= MARKS | BESIDE) or (found & OUTSIDE_MARKS and not whole):
            return True
    return False


class Block(NamedTuple):
    """A run of text between block boundaries: the path's hash, the text, and where it stands."""

    path: int
    text: str
    in_article: bool
    aside: bool


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class _Place(NamedTuple):
    """Where the parser stands: the element's name and path, whether in an article, under a tag that holds no main text
    (``hard``), and under which marked elements or forms (``soft``)."""

    name: str
    path: int
    in_article: bool
    hard: bool
    soft: tuple[int, ...]


def _voided(articles: set[tuple[int, ...]], blocks: list[tuple[int, str, _Place]], sizes: list[int]) -> set[int]:
    """Marked elements whose mark says nothing about their text, as they hold the page's article or nearly all of it.

    ``articles``: the marked elements around (and at) each article. As long as every article stands in some, the largest of
    those is void, if it holds more text than stands free of marks: a mark on a wrapper. Where an article is free, all
    marks stand. Without articles, an element with more than WHOLE_SHARE of the text is void.
    """
    void: set[int] = set()
    free = sum(len(text) for _, text, place in blocks if not place.hard and not place.soft)
    while articles and all(set(chain) - void for chain in articles):
        largest = max((k for chain in articles for k in chain if k not in void), key=lambda k: (sizes[k], -k))
        if sizes[largest] <= free:
            break
        void.add(largest)
    if not articles:
        whole = sum(len(text) for _, text, place in blocks if not place.hard)
        void = {k for k, size in enumerate(sizes) if size > WHOLE_SHARE * whole}
    return void


def parse(html: str) -> tuple[list[tuple[int, int]], list[Block]]:
    """A page's elements as (path, enclosing path) and its text blocks, in page order."""
    elements: list[tuple[int, int]] = []
    blocks: list[tuple[int, str, _Place]] = []
    stack = [_Place("", 0, False, False, ())]
    parts: list[str] = []
    sizes: list[int] = []  # of text under each marked element
    articles: set[tuple[int, ...]] = set()

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            place = stack[-1]
            blocks.append((place.path, text, place))
            for k in place.soft if not place.hard else ():
                sizes[k] += len(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            inner, outer = stack[-1], stack[-2]
            if inner.name in BLOCK or (inner.hard, inner.soft) != (outer.hard, outer.soft):
                flush()
            stack.pop()

    at = 0
    for m in _TOKEN.finditer(html):
        parts.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth:
                close(depth)
            elif name in BLOCK:
                flush()
            continue
        while len(stack) > 1 and name in CLOSES.get(stack[-1].name, ()):
            close(len(stack) - 1)
        if name in BLOCK and name != "br":  # an unclosed paragraph ends with the next block, whatever stands between
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "p"), 0)
            if depth and all(s.name not in BLOCK for s in stack[depth + 1 :]):
                close(depth)
        labels = [label for found in _MARK.findall(m["attrs"]) for label in "".join(found).lower().split()]
        marks = {w for label in labels for w in _WORDS.findall(label)}
        outer = stack[-1]
        own = _hash(f"{outer.path} {name} {' '.join(sorted(marks))}")
        in_article = outer.in_article or name in ARTICLE
        hard = name in ASIDE or (name == "header" and not in_article)
        soft = name == "form" or (name not in ("html", "body", "main") and _is_marked(labels, in_article))
        if name in BLOCK or (hard and not outer.hard) or soft:
            flush()
        elements.append((own, outer.path))
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            if soft:
                sizes.append(0)
            place = _Place(name, own, in_article, outer.hard or hard, (*outer.soft, len(sizes) - 1) if soft else outer.soft)
            stack.append(place)
            if name in ARTICLE and not place.hard and not (soft and outer.in_article):
                articles.add(place.soft)
    parts.append(html[at:])
    flush()
    void = _voided(articles, blocks, sizes)
    return elements, [Block(path, text, p.in_article, p.hard or any(k not in void for k in p.soft)) for path, text, p in blocks]


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


_SIGN = (1 << 63) - 1


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def text_token(block: Block) -> int:
    return _hash(f"{block.path} text {block.text}")


def _occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, parent, is_text, page, page mark times count): each page's distinct tokens.

    A page is named by its text outside menus, notices and the like, so copies under several urls have one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, parents, texts, names, marks = [], [], [], [], [], []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                elements, blocks = parse(html.as_py() or "")
                count: dict[tuple[int, int, bool], int] = {}
                for own, path in elements:
                    count[own, path, False] = count.get((own, path, False), 0) + 1
                for block in blocks:
                    if not block.aside:  # what stands aside is no main text anyway
                        key = (text_token(block), block.path, True)
                        count[key] = count.get(key, 0) + 1
                name = _hash("\n".join(b.text for b in blocks if not b.aside))
                host = host_of(url)
                for (token, parent, is_text), n in count.items():
                    hosts.append(host)
                    tokens.append(token)
                    parents.append(parent)
                    texts.append(is_text)
                    names.append(name)
                    marks.append(((name | 1) * n) & _SIGN)
            columns = [pa.array(hosts, pa.string()), _signed(tokens), _signed(parents), pa.array(texts, pa.bool_()), _signed(names), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "token", "parent", "is_text", "page", "mark"])

    return pages.mapInArrow(run, "host string, token long, parent long, is_text boolean, page long, mark long")


#: A class counts as frequent from this share of a host's pages, and as large from so many tokens.
FREQUENT, LARGE, LEAST_PAGES = 0.5, 2, 3


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed): the hashes of the text blocks that each host's template fixes, as 8-byte values.

    Sums of page marks stand for occurrence vectors; they are taken modulo 2**63 so that they never overflow. Copies of
    a page on its host count once: they are no evidence of a template, and pages that count differ in their other text.
    """
    limit = F.lit(1 << 62).cast("decimal(38,0)")
    one = ("parent", "is_text", "mark")
    seen = _occurrences(pages).groupBy("host", "token", "page").agg(*[F.max(c).alias(c) for c in one])
    vectors = seen.groupBy("host", "token").agg(
        F.first("parent").alias("parent"),
        F.first("is_text").alias("is_text"),
        F.pmod(F.sum(F.col("mark").cast("decimal(38,0)")), limit).cast("long").alias("vector"),
        F.count(F.lit(1)).alias("pages"),
    )
    vectors = durable(vectors)
    hosts = vectors.groupBy("host").agg(F.max("pages").alias("of"))
    sizes = vectors.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size"), F.max("pages").alias("pages"))
    frequent = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= FREQUENT * F.col("of"))
    classes = sizes.join(hosts, "host").where((F.col("size") >= LARGE) & frequent)
    valid = vectors.where("is_text").join(classes.select("host", "vector"), ["host", "vector"], "left_semi")
    # nesting: a text belongs to the template if the element around it does, which may occur unequally often (paragraphs)
    around = vectors.where(~F.col("is_text")).join(hosts, "host").where(frequent).select("host", F.col("token").alias("parent"))
    nested = valid.join(around, ["host", "parent"], "left_semi")
    return nested.groupBy("host").agg(F.collect_set("token").alias("fixed"))


#: Templates are broadcast up to so many hosts and text blocks together; beyond that the pages are joined by host.
BROADCAST_BLOCKS = 500_000


def main_text(html: str | None, fixed: set[int]) -> str:
    """The text blocks in a page's slots: all that the template doesn't fix and that don't stand aside.

    What the template fixes in articles stays if it is half of their text or more: then the pages are near copies.
    """
    blocks = [b for b in parse(html or "")[1] if not b.aside]
    slot = [text_token(b) not in fixed for b in blocks]
    articles = sum(len(b.text) for b in blocks if b.in_article)
    gone = sum(len(b.text) for b, free in zip(blocks, slot) if b.in_article and not free)
    keep = 2 * gone >= articles
    return "\n".join(b.text for b, free in zip(blocks, slot) if free or (b.in_article and keep))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    A null html gives an empty text; a null url belongs to the host without a name; repeated rows are extracted each.
    Whole pages are read, nothing is capped. Hosts with fewer than LEAST_PAGES pages have no template of their own. Only
    page_id, url and html are taken, so further columns and their names don't matter.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    made = durable(templates(pages.select("url", "html")))
    load = made.agg(F.count(F.lit(1)), F.sum(F.size("fixed"))).first()
    small = load[0] + (load[1] or 0) <= BROADCAST_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, set[int]] = {}
            texts = []
            for html, fixed in zip(batch.column(2), batch.column(3).to_pylist()):
                key = tuple(fixed or ())
                if key not in known:
                    known[key] = {v & 0xFFFFFFFFFFFFFFFF for v in key}
                texts.append(main_text(html.as_py(), known[key]))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    keyed = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    joined = keyed.join(F.broadcast(made) if small else made, "host", "left").select("page_id", "url", "html", "fixed")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
