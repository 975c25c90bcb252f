"""Main text of web pages by a site style tree.

The DOMs of a host's pages merge into one tree: a node stands for all elements with the same path of signatures (tag and classes).
For each node two entropies over the pages are computed, each as a share of its largest possible value: P of the presentation (the
sequence of child signatures) and C of the content (the text below). A branch that looks alike everywhere has low entropy. A
content that stands on k of a node's n pages has importance of its own, -log((k - 1/2) / (n + 1)) / log(n + 1): 1 and more for
a unique one, near 0 for one on every page.

A block stays on a page if logit(prior) + WEIGHT * (E - 1/2) isn't below 0, where E is its importance in [0, 1]: the larger one of C
and its content's own, and outside of an article half of that and half P. The prior is what the presentation's names say, and the
entropies outweigh it either way:

| prior | of | goes if | without entropies |
|---|---|---|---|
| 0.9 | blocks in an article or main element | E < 0.19: one content on (nearly) all pages, as a notice or an author's box | stays |
| 0.75 | blocks of pages without such an element | E < 0.34 | stays |
| 0.15 | blocks outside of it, on pages that have one | E < 0.75: stays if layout and content differ from page to page | goes |
| 0.08 | blocks of an ambiguous name (share, tags, widget, ...) | E < 0.85 | goes |
| 0 | menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments by element or name | always | goes |

Names of the last kind decide alone: the text that is asked for is without them, and menus, adverts and comments often differ on
every page of a host, as the article does, so entropy would keep them.

Only distinct pages count: of a host's pages whose texts are equal before any entropy counts, one is taken, so copies bring no
entropy down. A block that holds an article, the page itself, html and body are never removed. Nodes on fewer than MIN_PAGES
distinct pages have no entropies.

Copies meet by host and text, then sums are made by host, path and value, both with partial results on each task, so a host with a
third of all pages stays spread out. Only the paths whose entropies can change what the prior says go back to a host's pages.

The text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, and the ones that
aren't empty are joined by a blank line. A line break (br) is white space.

Defined cases: null or empty html has an empty text; a null url is a host of its own; broken markup ends at the page's end, an
unclosed script or style with it, and any other raw element that isn't closed is taken for empty; repeated pages are extracted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Branches on fewer distinct pages have no entropy; what importance weighs in the logit.
MIN_PAGES, WEIGHT = 3, 7.0
#: Priors: in an article, on a page without one, outside of one, of an ambiguous name.
ARTICLE, NEUTRAL, OUTSIDE, AMBIGUOUS = 0.9, 0.75, 0.15, 0.08
#: What a page hands on for each value of a path.
COUNTS = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("first", pa.int64())]))
#: So many paths and contents are broadcast (some 10 MB); more of them meet the pages in a shuffled join.
BROADCAST_PATHS = 100_000
# Elements and names by what they hold.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup, and those of them that swallow the rest of the page if they aren't closed.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDLESS = frozenset(["script", "style"])
# What holds a whole page is never removed.
FRAME = frozenset(["#page", "html", "body"])
NOISE_TAGS = frozenset("head title script style nav footer aside form button input select option textarea dialog menu noscript template iframe noembed noframes".split())
NOISE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar side menu nav navbar
navigation breadcrumb breadcrumbs topbar toolbar footer masthead cookie cookies consent gdpr notice notification alert popup modal overlay paywall comment
comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup
login search searchbox form pagination pager widget skip tags tagcloud""".split())
# Of those, the ambiguous ones: noise only as a whole name ("long-form" isn't a form), and only if the entropies don't say otherwise.
AMBIGUOUS_NAMES = frozenset("form side skip search tags share widget alert overlay reply related modal".split())
MAIN_NAMES = frozenset(["main", "main-content", "article-body", "post-content", "entry-content", "article-content", "story-body"])
# What an open element's end may be left out before.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body div ul ol dl table article section nav aside main header footer form blockquote".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>?|<[!?][^>]*>?""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+|\d+")


class Node:
    __slots__ = ("children", "holds", "main", "path", "prior", "sign", "tag")

    def __init__(self, tag: str, attrs: str, above: Node | None):
        self.tag, self.children, self.holds = tag, [], False
        found = " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)).lower().split() if attrs else []
        self.sign = xxhash.xxh3_64_intdigest(" ".join([tag, *found]))
        self.path = hash((above.path, self.sign)) if above else self.sign
        # names in the singular too; of an article only whole names count
        words = {w for name in found for w in (name, name.removesuffix("s"))}
        parts = set() if tag == "article" else {w for name in found for p in _NAME.findall(name) for w in (p, p.removesuffix("s"))}
        named = ((words | parts) & NOISE_NAMES if tag not in ("html", "body", "main") else set()) - AMBIGUOUS_NAMES
        noise = tag in NOISE_TAGS or bool(named) or tag == "header" and not (above and above.main)  # of the article, or of the page
        main = tag in ("article", "main") or bool(set(found) & MAIN_NAMES)
        self.main = not noise and (main or bool(above and above.main)) and not (above and above.prior == 0)
        if noise or above and above.prior == 0:
            self.prior = 0.0
        elif tag not in FRAME and tag != "main" and words & AMBIGUOUS_NAMES:
            self.prior = AMBIGUOUS
        else:
            self.prior = ARTICLE if self.main else NEUTRAL


def parse(page: str) -> list[Node]:
    """The elements of a page in document order; text stands among the children as strings."""
    root = Node("#page", "", None)
    nodes, stack, at = [root], [root], 0
    n = len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" and tag != "body":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(tag, found["attrs"], stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if end is None and tag in ENDLESS:
                break
            if end is not None:
                if tag not in NOISE_TAGS:
                    node.children.append(page[at : end.start()])
                at = page.find(">", end.end()) + 1 or n
        elif tag not in VOID:
            stack.append(node)
    for node in reversed(nodes):  # children come after their parents
        node.holds = not node.main and any(c.main or c.holds for c in node.children if isinstance(c, Node))
    return nodes


def contents(nodes: list[Node]) -> dict[int, int]:
    """By id(): the hash of the text below every element that holds text."""
    out: dict[int, int] = {}
    for node in reversed(nodes):
        parts = [out.get(id(c), 0) if isinstance(c, Node) else xxhash.xxh3_64_intdigest(t) if (t := c.strip()) else 0 for c in node.children]
        if any(parts):
            out[id(node)] = hash(tuple(parts))
    return out


def statistics(nodes: list[Node]) -> Iterator[tuple[int, int, int]]:
    """path, kind (0: presentation, 1: content, 2: content in an article), value of every block that holds text, without the page's frame and noise."""
    content = contents(nodes)
    for node in nodes:
        if id(node) not in content or node.prior == 0 or node.tag in FRAME or node.tag not in BLOCKS:
            continue
        if not node.main:
            yield node.path, 0, hash(tuple(c.sign for c in node.children if isinstance(c, Node) and c.tag in BLOCKS))
        yield node.path, 2 if node.main else 1, content[id(node)]


def own_importance(k, n, log=math.log):  # noqa: ANN001, ANN201
    """Of a content that stands on k of n pages."""
    return -log((k - 0.5) / (n + 1)) / log(n + 1)


def stays(prior: float, importance: float) -> bool:
    return prior > 0 and math.log(prior / (1 - prior)) + WEIGHT * (importance - 0.5) >= 0


def least_importance(prior: float) -> float:
    """What stays() asks for."""
    return 0.5 - math.log(prior / (1 - prior)) / WEIGHT


class Known(NamedTuple):
    """What a path's entropies are, and the own importance of the contents that recur on it; others are unique."""

    presentation: float
    content: float
    own: dict[int, float]

    def importance(self, value: int | None, main: bool) -> float:
        content = max(self.content, min(1.0, self.own.get(value, 1.0)))
        return content if main else (self.presentation + content) / 2


def extract(page: str, known: dict[int, Known] | None = None) -> str:
    """The page's main text; known: by path, where the entropies can change what the priors say."""
    return text_of(parse(page), known or {})


def text_of(nodes: list[Node], known: dict[int, Known]) -> str:
    content = contents(nodes) if known else {}
    has_main = any(x.main for x in nodes)
    blocks: list[str] = []
    here: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(here).split()):
            blocks.append(text)
        here.clear()

    def goes(x: Node, outside: bool) -> bool:
        if x.prior == 0:
            return True
        if x.tag in FRAME or x.tag not in BLOCKS and x.prior != AMBIGUOUS:
            return False
        prior = OUTSIDE if outside and not x.main and x.prior == NEUTRAL else x.prior
        there = known.get(x.path)
        if there is None:
            return prior < 0.5
        return not stays(prior, there.importance(content.get(id(x)), x.main))

    todo: list = [(nodes[0], has_main)]
    while todo:
        x, outside = todo.pop()  # outside: of an article, and of any branch that stays beside it; loose text there goes
        if x is None:
            flush()
        elif isinstance(x, str):
            if not outside:
                here.append(_html.unescape(x) if "&" in x else x)
        else:
            if x.tag == "br":
                here.append(" ")
            block = x.tag in BLOCKS
            if not x.holds and goes(x, outside):
                if block:
                    flush()
                continue
            if block:
                flush()
                todo.append((None, False))
            below = outside and not x.main and (x.holds or x.tag in FRAME or not block)
            todo.extend((c, below) for c in reversed(x.children))
    flush()
    return "\n\n".join(blocks)


def _host(url):  # noqa: ANN001, ANN202
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, main, pages, presentation, content, own of every node of the hosts' merged trees that stands on MIN_PAGES
    distinct pages; pages: host, html.

    own: the contents that recur (value, k: the pages that hold it), as far as their own importance can matter. Pages of a host are
    copies if their texts are equal before any entropy counts; of copies one is counted.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, values = [], []
            for page in batch.column(1):
                nodes = parse(page.as_py() or "")
                copies.append(xxhash.xxh3_128_digest(text_of(nodes, {}).encode("utf-8", "surrogatepass")))
                seen = set()
                # of a path's rows one has first = 1, so that their sum over the pages is the number of pages
                values.append([{"path": path, "kind": kind, "value": value, "first": int((path, kind) not in seen and not seen.add((path, kind)))} for path, kind, value in sorted(set(statistics(nodes)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.binary()), pa.array(values, COUNTS)], names=["host", "copy", "counts"])

    found = pages.select("host", "html").mapInArrow(counted, "host string, copy binary, counts array<struct<path:bigint,kind:int,value:bigint,first:bigint>>")
    one = found.groupBy("host", "copy").agg(F.min("counts").alias("counts"))
    counts = one.select("host", F.explode("counts").alias("c")).groupBy("host", "c.path", "c.kind", "c.value").agg(F.count("*").alias("k"), F.sum("c.first").alias("pages"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("k").alias("all"), F.sum("pages").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("klogk")).where(F.col("pages") >= MIN_PAGES)
    share = F.when(F.col("all") > 1, 1 - F.col("klogk") / (F.col("all") * F.log("all"))).otherwise(1.0)
    at = lambda kind, what: F.max(F.when(F.col("kind") == kind, what))
    nodes = sums.groupBy("host", "path").agg(F.max(F.col("kind") == 2).alias("main"), F.max("pages").alias("pages"), F.coalesce(at(0, share), F.lit(0.0)).alias("presentation"), F.coalesce(at(2, share), at(1, share)).alias("content"))
    # a content's own importance matters where it can exceed the path's, and be too little to stay
    most = F.when(F.col("main"), least_importance(ARTICLE)).otherwise(2 * least_importance(NEUTRAL))
    own = own_importance(F.col("k"), F.col("pages"), F.log)
    values = counts.where("kind > 0 and k > 1").select("host", "path", "value", "k").join(nodes, ["host", "path"]).where((own < most) & (F.col("content") < most))
    values = values.groupBy("host", "path").agg(F.collect_list(F.struct("value", "k")).alias("own"))
    return nodes.join(values, ["host", "path"], "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host(F.col("url").cast("string")).alias("host"))
    # what no content of a path can make go or stay against its prior doesn't matter
    lowest = F.when(F.col("main"), F.col("content")).otherwise((F.col("presentation") + F.col("content")) / 2)
    matters = (lowest < F.when(F.col("main"), least_importance(ARTICLE)).otherwise(least_importance(NEUTRAL))) | (~F.col("main") & ((F.col("presentation") + 1) / 2 >= least_importance(OUTSIDE)))
    paths = cut(style_tree(rows).where(matters))
    size = paths.agg(F.coalesce(F.sum(1 + F.greatest(F.size("own"), F.lit(0))), F.lit(0))).first()[0]

    def known_of(found) -> dict[int, Known]:  # noqa: ANN001
        return {x["path"]: Known(x["presentation"], x["content"], {v["value"]: own_importance(v["k"], x["pages"]) for v in x["own"] or ()}) for x in found}

    if size <= BROADCAST_PATHS:
        by: dict[str, list] = {}
        for r in paths.collect():
            by.setdefault(r["host"], []).append(r)
        all_known = rows.sparkSession.sparkContext.broadcast({host: known_of(found) for host, found in by.items()})

        def near(batch: pa.RecordBatch) -> Iterator[dict[int, Known]]:
            return (all_known.value.get(h, {}) for h in batch.column(3).to_pylist())

        ready = rows.select("page_id", "url", "html", "host")
    else:
        low = paths.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "presentation", "content", "own")).alias("known"))

        def near(batch: pa.RecordBatch) -> Iterator[dict[int, Known]]:
            return (known_of(x.as_py() or ()) for x in batch.column(3))

        ready = rows.join(low, "host", "left").select("page_id", "url", "html", "known")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), known) for page, known in zip(batch.column(2), near(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return ready.mapInArrow(extracted, "page_id long, url string, text string")


def op8_site_style_tree(spark, sf_dir) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
