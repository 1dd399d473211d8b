"""Main text of web pages by site style trees.

The pages of a host are merged into a style tree: an element's place in it is the path of kinds and class names down
to it, and its styles are the sequences of children that it has on the host's pages. Entropy says what a place is
worth: presentation that is the same on all pages, and blocks of text that most pages repeat there, are worth nothing;
varied ones are. Branches of low importance are cut from each page. What an element is called, or what kind it is, comes
first: menus, footers, forms and the like are worth nothing at once, and a page that marks its article is taken at its
word: text outside is cut, and text inside only where nearly all pages of the host repeat it.

Pages that share their longest block count once for the tree, so that copies of an article don't pass for a template.
The tree is made of counts by (host, place, style or block), added up before they are shuffled. Only what is to be cut
comes back to the pages; pages of hot hosts are dealt over many tasks.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import packed, spread_join, stage
from scopewise.llm.url_rules import host_and_path

#: HTML's kinds of elements, as its standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
#: Elements in which an end tag finds no start tag outside.
SCOPES = frozenset("html table td th caption button object template".split())
#: What a start tag closes if it is open, and what stops the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Kinds, roles and words of class and id names of what is no part of an article.
KINDS = frozenset("head nav footer aside form dialog menu noscript template button select datalist option svg canvas audio video object applet frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond "
    "reply replies related recommended recommendations widget pagination pager skiplink search copyright disclaimer".split()
)
NAMED = NAMES | {"header"}
#: A name after one of these says what a page has, not what the element is.
HAVING = frozenset(("has", "with", "no", "without", "is"))

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<says>(?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)",
    re.S,
)
SAYS = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))|(?=[\s/]|$))""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")

#: A style tree's weight of presentation, the importance below which a branch is cut, and pages that must repeat a block.
GAMMA, LEAST, REPEATS = 0.9, 0.2, 4
#: Inside an article: so many pages at least, and the share of them that repeats a block.
SURE_PAGES, SURE_SHARE = 8, 0.9
#: Stands for all blocks that are links as a whole.
LINKED = 0
STATS = "host string, copy long, places array<struct<place:long,style:long>>, blocks array<struct<place:long,block:long,inside:boolean>>"


def _hash(text: str, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(text, seed & (2**64 - 1))
    return value - 2**64 if value >> 63 else value


class Page:
    """A page's elements and its blocks of text, in page order.

    Element 0 is the page. Per element: parent, tag, place (hash of the path of kinds and names), children (their
    labels), own (it names itself as no part of an article), and whether it is cut for that, and inside an article.
    Blocks are (element, text, whether all of it is links).
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.place, self.children, self.own = [-1], ["#page"], [0], [[]], [False]
        self.blocks: list[tuple[int, str, bool]] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, element, whether it is an inline one that is cut
        text: list[str] = []
        linked = plain = links = cut = 0

        def flush() -> None:
            nonlocal linked, plain
            if text:
                found = " ".join("".join(text).split())
                if found:
                    self.blocks.append((stack[-1][1], found, linked > 0 and not plain))
                    self.children[stack[-1][1]].append("#text")
                text.clear()
                linked = plain = 0

        def close(keep: int) -> None:
            nonlocal links, cut
            if any(tag not in INLINE for tag, *_ in stack[keep:]):
                flush()
            for tag, _, dropped in stack[keep:]:
                links -= tag == "a"
                cut -= dropped
            del stack[keep:]

        def find(tags: frozenset | set, until: frozenset | set) -> int:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in until:
                    break
            return 0

        at, size = 0, len(html)
        while at < size:
            tag = TAG.search(html, at)
            piece = html[at : tag.start()] if tag else html[at:]
            if piece and not cut:
                piece = references.unescape(piece)
                text.append(piece)
                if not piece.isspace():
                    linked, plain = (linked + 1, plain) if links else (linked, plain + 1)
            if not tag:
                break
            at = tag.end()
            name = tag["tag"]
            if name is None or (at == size and html[-1] != ">"):
                continue
            name = name.lower()
            if tag["end"]:
                if name in INLINE:
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name or stack[k][0] not in INLINE), 0)
                    if k and stack[k][0] == name:
                        close(k)
                elif name == "br":
                    flush()
                elif k := find({name}, SCOPES - {name}):
                    close(k)
                elif name == "p":
                    flush()
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            names, hidden = _names(tag["says"])
            if name in INLINE:
                dropped = hidden or not NAMES.isdisjoint(names) or name == "label"
                stack.append((name, stack[-1][1], dropped))
                links += name == "a"
                cut += dropped
                continue
            flush()
            if k := find({"p"}, SCOPES):
                close(k)
            if name in CLOSES and (k := find(*CLOSES[name])):
                close(k)
            elif name in HEADINGS and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            above = stack[-1][1]
            label = ".".join((name, *sorted(names)))
            self.children[above].append(label)
            stack.append((name, len(self.tag), False))
            self.parent.append(above)
            self.tag.append(name)
            self.place.append(_hash(label, self.place[above]))
            self.children.append([])
            self.own.append(name in KINDS or name == "header" or hidden or (name not in HEADINGS and not NAMED.isdisjoint(names)))
        close(1)
        flush()

    def _judge(self) -> None:
        count = len(self.tag)
        texts, headed, titled, region = [False] * count, [False] * count, [False] * count, [False] * count
        for element, *_ in self.blocks:
            texts[element] = True
        for k in range(count - 1, 0, -1):
            above = self.parent[k]
            headed[k] |= self.tag[k] in HEADINGS
            titled[k] |= self.tag[k] == "h1"
            # an article that calls itself a comment is none
            region[k] |= self.tag[k] in REGIONS and texts[k] and not self.own[k]
            for found in (texts, headed, titled, region):
                found[above] |= found[k]
        self.cut, self.inside = [False] * count, [False] * count
        for k in range(1, count):
            above = self.parent[k]
            tag = self.tag[k]
            own = self.own[k] and not region[k] and tag not in ("html", "body")
            if own and tag in ("header", "div", "section") and self.inside[above]:
                own = not (headed[k] and (tag == "header" or titled[k]))
            elif own and tag not in KINDS and tag != "header" or tag == "form":
                own = own and not titled[k]
            self.cut[k] = self.cut[above] or own
            self.inside[k] = self.inside[above] or (tag in REGIONS and not self.cut[k])
        self.marked = any(self.inside[e] and not self.cut[e] for e, *_ in self.blocks)
        if self.marked and not any(titled[k] and self.inside[k] for k in range(count)):
            # a title over the article belongs to it
            titles = [k for k in range(count) if self.tag[k] == "h1" and not self.cut[k]]
            if len(titles) == 1:
                self.inside[titles[0]] = True

    def candidates(self) -> Iterator[tuple[int, int, str, bool]]:
        """(element, hash, text, inside an article) of the blocks that names and kinds leave."""
        for element, text, linked in self.blocks:
            if not self.cut[element] and (self.inside[element] or not self.marked):
                inside = self.inside[element]
                yield element, LINKED if linked and not inside else _hash(DIGITS.sub("#", text)), text, inside

    def stats(self) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, bool]]]:
        """What a page adds to its host's tree: the hash of its longest block, (place, style) of elements, (place, block, inside)."""
        longest, copy, blocks, styles = -1, 0, {}, {}
        for element, block, text, inside in self.candidates():
            blocks[self.place[element], block] = inside
            if len(text) > longest:
                longest, copy = len(text), block
            styles.setdefault(self.place[element], set()).add(" ".join(self.children[element]))
        return copy, [(p, _hash("|".join(sorted(s)))) for p, s in styles.items()], [(*key, inside) for key, inside in blocks.items()]

    def text(self, noise: set[tuple[int, int]], sure: set[tuple[int, int]]) -> tuple[str, int]:
        """The text that remains, and how many blocks the host's tree cuts."""
        kept, cut = [], 0
        for element, block, text, inside in self.candidates():
            if (self.place[element], block) in (sure if inside else noise):
                cut += 1
            else:
                kept.append(text)
        return "\n".join(kept), cut


def _names(says: str) -> tuple[frozenset[str], bool]:
    """The words of an element's class, id and role names, and whether it is hidden."""
    if not says or says.isspace():
        return frozenset(), False
    words, hidden = set(), False
    for key, *values in SAYS.findall(says):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and UNSEEN.search(value)):
            hidden = True
        elif key == "role":
            words |= {"nav"} if not ROLES.isdisjoint(value.split()) else set()
        elif key in ("class", "id"):
            for name in value.split():
                parts = NAME.findall(name)
                if parts and parts[0] not in HAVING:
                    words.update(parts)
    return frozenset(words), hidden


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.host, batch.html, strict=True):
            copy, places, blocks = Page(html).stats()
            rows.append((host, copy, [{"place": p, "style": s} for p, s in places], [{"place": p, "block": b, "inside": i} for p, b, i in blocks]))
        yield pd.DataFrame(rows, columns=["host", "copy", "places", "blocks"])


def style_trees(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> what is cut: (host, place, block, sure), where sure is said of blocks inside an article.

    A place's presentation importance is the entropy of its styles over the m pages that have it, to the base m; a
    block's is 1 less the logarithm, to the same base, of how many pages repeat it there. The more styles, the more the
    former counts. Blocks that are links as a whole have none of their own.
    """
    trees = pages.mapInPandas(_stats, STATS).groupBy("host", "copy").agg(F.min(F.struct("places", "blocks")).alias("page"))
    trees = stage(trees.select("host", "page.*"), "style-trees")
    styles = trees.select("host", F.explode("places").alias("p")).groupBy("host", F.col("p.place").alias("place"), "p.style").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    places = styles.groupBy("host", "place").agg(F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum(n * F.log(n)).alias("nlogn"))
    entropy = (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")
    places = places.where(F.col("m") >= REPEATS).select("host", "place", "m", F.pow(F.lit(GAMMA), F.col("styles")).alias("rest"), entropy.alias("entropy"))
    blocks = trees.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.place").alias("place"), F.col("b.block").alias("block")).agg(F.count("*").alias("n"), F.bool_or("b.inside").alias("inside"))
    own = F.when(F.col("block") == LINKED, 0.0).otherwise(1 - F.log("n") / F.log("m"))
    low = (1 - F.col("rest")) * F.col("entropy") + F.col("rest") * own < LEAST
    sure = (F.col("m") >= SURE_PAGES) & (F.col("n") >= SURE_SHARE * F.col("m"))
    found = blocks.where(F.col("n") >= REPEATS).join(places, ["host", "place"]).where(F.when(F.col("inside"), sure).otherwise(low))
    return found.select("host", "place", "block", F.col("inside").alias("sure"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, n_cut = [], []
        for html, noise in zip(batch.html, batch.noise, strict=True):
            cut = {True: set(), False: set()}
            for x in noise if noise is not None else ():
                cut[bool(x["sure"])].add((x["place"], x["block"]))
            text, n = Page(html).text(cut[False], cut[True])
            out.append(text)
            n_cut.append(n)
        yield batch.drop(columns=["html", "noise", "host"]).assign(text=out, n_cut=n_cut)


def host_of(url: Column) -> Column:
    return host_and_path(url)[0]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, its url, text, n_chars (code points), n_cut (blocks that the host's style tree cuts).

    Text is the article's blocks in page order, joined by line ends; within a block references are decoded and white
    space becomes one space. A null page is an empty one, of empty text. Pages whose url is null or has no host are in
    no tree. Rows that repeat or share an id get a row each; an empty table gives an empty result; other columns are
    not read.
    """
    # columns under names of their own: the id's and url's may be any
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    noise = style_trees(rows.where("host <> ''").select("host", "html"))
    noise = noise.groupBy("host").agg(F.collect_list(F.struct("place", "block", "sure")).alias("noise"))
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n")).join(noise, "host", "left"), "hosts")
    kinds = {c: t for c, t in rows.dtypes}
    found = spread_join(rows, hosts, "host", ["id", "url"]).select("id", "url", "host", "html", "noise")
    found = found.mapInPandas(_texts, f"id {kinds['id']}, url {kinds['url']}, text string, n_cut int")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "n_cut")
