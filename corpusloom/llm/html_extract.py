"""Main text of web pages by site style trees.

Pages are parsed into text blocks, each with the style node that holds it and the branch
(nearest container) above. What elements say of themselves comes first: blocks of an article stay;
navigation, headers, footers, asides, forms, hidden elements and what a class, id or role
marks go, and so does what stands beside a page's article. All other blocks are neutral (pages
without an article have nothing else), and on these the site style tree decides.

The DOMs of a host are merged by counting, for each style node, on how many pages it
stands, how its presentation (the sequence of child elements) varies and on how many pages
each of its contents recurs. A block's importance falls with the pages that have the same
text at its node, with the node's other contents that recur, and with the fixed
presentation of its branch; a list of links needs more than a paragraph. Blocks of low importance are removed.

Defined results: null or empty html gives an empty text; pages without a host form one
site; a node seen on one page only has importance 1; repeated rows each have their result,
but pages of a host with equal blocks count once in its tree;
a tag that the end of the page cuts off is no text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select option button textarea audio video datalist".split())
NOISE = frozenset("nav footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("body main article section div nav footer header aside form table ul ol dl menu dialog".split())
#: In an article, classes of these (say, page-header) mark nothing.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what is no article text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments reply replies respond discussion disqus share sharing social related recommended "
    "pagination pager toolbar contentinfo complementary search form skip copyright".split()
)
#: An element that starts closes an open one of these names, within the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words before a marking one in a class that deny it, as in no-sidebar; and a marking word that says nothing within an article.
DENIES, OWN_PART = frozenset("no has with without".split()), "header"
#: MARKED: a class, id or role marks it; MARKED_ARTICLE: an article in such a wrapper.
MARKED_ARTICLE, MARKED, ARTICLE, NEUTRAL, NOISY = 4, 3, 2, 1, 0
#: Weights of a branch's contents against its presentation, of the prior against entropy, of a block's place against its branch, and of its own text against the other contents of its leaf.
GAMMA, PRIOR, LEAF, OWN = 0.5, 0.35, 0.8, 0.7
#: What a paragraph and a list of links say of themselves.
PRIORS = (0.5, -0.3)
#: Judged places and recurring texts that are sent to all executors at most; beyond that, blocks are joined with them.
SENT_PLACES = 200_000


class Element:
    """An open element. container: place in the stack of the nearest container (or the bottom); block: nearest element that isn't inline; both may be the element itself."""

    __slots__ = ("block", "branch", "container", "key", "kind", "last", "look", "name", "silent", "links")

    def __init__(self, name: str, key: int, kind: int, silent: bool, branch: int, links: bool, container: int, block: "Element | None"):
        self.name, self.key, self.kind, self.silent, self.branch, self.links = name, key, kind, silent, branch, links
        self.last, self.look = "", 0  # the last child's name, and a hash of the sequence of children
        self.container, self.block = container, block or self


class PageParser(HTMLParser):
    """Collects blocks (leaf node, branch node, kind, text, all of it links) and each container's presentation."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", 0, NEUTRAL, False, 0, False, 0, None)]
        #: places in the stack of the open elements of each name, so that no tag walks the stack
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[tuple[int, int, int, str, bool]] = []
        self.looks: list[tuple[int, int]] = []
        self.parts: list[str] = []
        self.owner = self.stack[0]
        self.linked = self.plain = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            o = self.owner
            self.blocks.append((o.key, o.branch, o.kind, text, self.plain == 0))
        self.parts.clear()
        self.linked = self.plain = 0

    def close_top(self) -> None:
        e = self.stack.pop()
        self.open[e.name].pop()
        if e.name in CONTAINERS:
            self.looks.append((e.key, e.look))

    def handle_starttag(self, name, attrs):
        if name not in INLINE:
            self.flush() if name != "br" else self.parts.append(" ")
        if name in VOID:
            return
        # Elements that end here are closed down to the nearest container.
        floor = self.stack[-1].container
        for own in CLOSES.get(name, ("p",) if name in ENDS_P else ()):
            within = bisect_right(self.open[own], floor)
            if within < len(self.open[own]):
                lowest = self.open[own][within]
                while len(self.stack) > lowest:
                    self.close_top()
        top = self.stack[-1]
        if top.last != name:
            top.last, top.look = name, xxhash.xxh3_64_intdigest(name, top.look) >> 1
        marks = [v for k, v in attrs if k in ("class", "id", "role") and v]
        classes = " ".join(sorted(next((v for k, v in attrs if k == "class" and v), "").split()))
        names = [re.split(r"[^a-z]+", token) for v in marks for token in v.lower().split()]
        words = {w for token in names if not DENIES & set(token) for w in token} & NOISE_WORDS
        if top.kind in (ARTICLE, MARKED_ARTICLE):
            words.discard(OWN_PART)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        kind = top.kind
        if name in NOISE or hidden or name == "header" and kind not in (ARTICLE, MARKED_ARTICLE):
            kind = NOISY
        elif words and name not in ("body", "html", "article", "main") and not (name in HEADINGS and kind in (ARTICLE, MARKED_ARTICLE)):
            kind = MARKED if kind != NOISY else NOISY
        elif name in ("article", "main") and kind != NOISY:
            kind = ARTICLE if kind not in (MARKED, MARKED_ARTICLE) else MARKED_ARTICLE
        key = xxhash.xxh3_64_intdigest(f"{name}.{classes}", top.key) >> 1
        place, contains = len(self.stack), name in CONTAINERS
        self.stack.append(Element(name, key, kind, top.silent or name in SILENT, key if contains else top.branch, top.links or name == "a", place if contains else top.container, top.block if name in INLINE else None))
        self.open[name].append(place)
        if name not in INLINE:
            self.owner = self.stack[-1]

    def handle_endtag(self, name):
        if name not in INLINE:
            self.flush()
        places = self.open[name]
        # A stray end tag doesn't close what stands around the container.
        if places and (name in CONTAINERS or name in ("html", "body") or places[-1] > self.stack[-1].container):
            lowest = places[-1]
            while len(self.stack) > lowest:
                self.close_top()
        if name not in INLINE:
            self.owner = self.stack[-1].block

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.silent:
            if not self.parts:
                self.owner = top.block
                # A marked inline element (say, span class="ad") speaks for its own text.
                if top.kind != self.owner.kind:
                    self.owner = top
            elif top.kind != self.owner.kind:
                self.flush()
                self.owner = top
            self.parts.append(data)
            if data.strip():
                self.linked += top.links
                self.plain += not top.links

    def finish(self, html: str):
        cut = re.search(r"<(?:[A-Za-z/!?][^<>]*)?$", html)
        self.feed(html[: cut.start()] if cut and len(cut[0]) > 1 else html)
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self.close_top()
        kinds = {b[2] for b in self.blocks}
        # An article in a marked wrapper is the page's article if there is no other; beside an article nothing stays.
        means = {MARKED: NOISY, MARKED_ARTICLE: NOISY if ARTICLE in kinds else ARTICLE}
        if kinds & {ARTICLE, MARKED_ARTICLE}:
            means[NEUTRAL] = NOISY
        self.blocks = [(a, b, means.get(k, k), t, x) for a, b, k, t, x in self.blocks]
        return self.blocks, list(dict.fromkeys(self.looks))


def parse(html: str | None):
    """Blocks (leaf, branch, kind: ARTICLE, NEUTRAL or NOISY, text, links) and containers' presentations of one page."""
    return PageParser().finish(html) if html else ([], [])


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


BLOCK = "array<struct<leaf:long,branch:long,kind:int,text:string,links:boolean>>"


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """One row a page: _row, page_id, url, host, blocks, looks; materialised, so that _row stays what it is."""
    inner = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("_html"))
    kind = inner.schema["page_id"].dataType.simpleString()
    names = ["_row", "page_id", "url", "host", "blocks", "looks"]
    block = pa.list_(pa.struct([("leaf", pa.int64()), ("branch", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("links", pa.bool_())]))
    look = pa.list_(pa.struct([("node", pa.int64()), ("look", pa.int64())]))

    def run(batch):
        texts, urls = batch.column(3).to_pylist(), batch.column(2).to_pylist()
        for a, b in C.blocks(texts):
            got = [parse(t) for t in texts[a:b]]
            blocks = [[dict(zip(("leaf", "branch", "kind", "text", "links"), x, strict=True)) for x in g[0]] for g in got]
            looks = [[{"node": n, "look": x} for n, x in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), pa.array([host(u) for u in urls[a:b]]), pa.array(blocks, block), pa.array(looks, look)], names)

    schema = f"_row long, page_id {kind}, url string, host string, blocks {BLOCK}, looks array<struct<node:long,look:long>>"
    return C.materialize(C.map_arrow(inner, run, schema), "pages-parsed")


def style_tree(rows: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content: the merged tree's nodes with their entropy-based importance.

    content is 1 less the mean, over the node's distinct contents, of log(pages with it) / log(pages);
    presentation is the entropy, to the base of the number of pages, of the forms in which it stands.
    """
    # Copies of a page say nothing about a template, so a page is what its blocks are.
    pages = rows.select(F.xxhash64("blocks").alias("_page"), "host", "blocks", "looks")
    blocks = pages.select("_page", "host", F.explode("blocks").alias("b"))
    both = blocks.select("_page", "host", F.explode(F.array_distinct(F.array("b.leaf", "b.branch"))).alias("node"), F.xxhash64("b.text").alias("feature")).distinct()
    contents = both.groupBy("host", "node", "feature").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "node").agg(F.avg(F.log("n")).alias("recurs"))
    stands = both.select("_page", "host", "node").distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))
    looks = pages.select("_page", "host", F.explode("looks").alias("x")).distinct().groupBy("host", "x.node", "x.look").agg(F.count(F.lit(1)).alias("n"))
    looks = looks.groupBy("host", "node").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.sum("n").alias("m"))
    tree = stands.join(contents, ["host", "node"]).join(looks, ["host", "node"], "left")
    scaled = lambda x, n: F.when(F.col(n) <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.log(n))))
    return tree.select("host", "node", "pages", scaled(F.coalesce(F.col("entropy"), F.lit(0.0)), "m").alias("presentation"), F.when(F.col("pages") <= 1, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("recurs") / F.log("pages"))).alias("content"))


def importance(own, leaf, presentation, content, links):
    """Importance of a neutral block: of its own text, its leaf's contents, and its branch's presentation and contents, each 0 to 1, with a prior."""
    branch = GAMMA * content + (1 - GAMMA) * presentation
    return PRIOR * links + (1 - PRIOR) * (LEAF * (OWN * own + (1 - OWN) * leaf) + (1 - LEAF) * branch)


def judged(rows: DataFrame, tree: DataFrame, threshold: float) -> DataFrame:
    """host, leaf, branch, links, feature (hash of the text) of neutral blocks whose text recurs on a host, with feature null for all others at that place; keep."""
    blocks = rows.select(F.xxhash64("blocks").alias("_page"), "host", F.explode(F.filter("blocks", lambda b: b["kind"] == NEUTRAL)).alias("b")).select("_page", "host", "b.leaf", "b.branch", "b.links", F.xxhash64("b.text").alias("feature"))
    place = ["host", "leaf", "branch", "links"]
    one = blocks.distinct()
    recurs = one.select("_page", "host", "leaf", "feature").distinct().groupBy("host", "leaf", "feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = one.select(*place, "feature").distinct().join(recurs, ["host", "leaf", "feature"]).select(*place, "feature", "n")
    asked = one.select(*place, F.lit(None).cast("long").alias("feature"), F.lit(1).cast("long").alias("n")).distinct().unionByName(several)
    leaf = tree.select("host", F.col("node").alias("leaf"), F.col("content").alias("_leaf"), F.col("pages").alias("_pages"))
    branch = tree.select("host", F.col("node").alias("branch"), F.col("content").alias("_content"), F.col("presentation").alias("_look"))
    known = asked.join(leaf, ["host", "leaf"]).join(branch, ["host", "branch"])
    own = F.when(F.col("_pages") <= 1, 1.0).otherwise(1 - F.log("n") / F.log("_pages"))
    links = F.when(F.col("links"), PRIORS[1]).otherwise(PRIORS[0])
    return known.select(*place, "feature", (importance(own, F.col("_leaf"), F.col("_look"), F.col("_content"), links) >= threshold).alias("keep"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = parsed(pages, key, url, html)
    told = C.materialize(judged(rows, style_tree(rows), threshold), "judged-places")
    if told.count() <= SENT_PLACES:
        return filtered(rows, {tuple(r)[:5]: r["keep"] for r in told.collect()})
    blocks = rows.select("_row", "page_id", "url", "host", F.posexplode_outer("blocks").alias("pos", "b")).select("_row", "page_id", "url", "host", "pos", "b.*")
    place = ["host", "leaf", "branch", "links"]
    usual = told.where("feature IS NULL").select(*place, F.col("keep").alias("_usual"))
    own = told.where("feature IS NOT NULL").select(*place, "feature", F.col("keep").alias("_own"))
    blocks = blocks.withColumn("feature", F.xxhash64("text")).join(usual, place, "left").join(own, [*place, "feature"], "left")
    keep = (F.col("kind") == ARTICLE) | ((F.col("kind") == NEUTRAL) & F.coalesce("_own", "_usual"))
    texts = blocks.groupBy("_row", "page_id", "url").agg(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "text")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def filtered(rows: DataFrame, told: dict[tuple, bool]) -> DataFrame:
    """The texts of parsed pages by what was told of neutral places, without dealing blocks out and back."""
    sent = rows.sparkSession.sparkContext.broadcast(told)
    hashed = F.transform("blocks", lambda b: F.when(b["kind"] == NEUTRAL, F.xxhash64(b["text"])))
    inner = rows.select("page_id", "url", "host", "blocks", hashed.alias("features"))

    def run(batch):
        told, texts = sent.value, []
        for site, blocks, features in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            own = []
            for b, feature in zip(blocks, features, strict=True):
                place = (site, b["leaf"], b["branch"], b["links"])
                if b["kind"] == ARTICLE or (b["kind"] == NEUTRAL and told.get((*place, feature), told.get((*place, None)))):
                    own.append(b["text"])
            texts.append(" ".join(own))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return C.map_arrow(inner, run, f"page_id {inner.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
