"""HTML extraction by wrapper induction.

Pages of one host share a template. Each page is parsed into a tree in which neighbouring siblings of the same kind are
one repeated node, and aligned by simple tree matching with the tree of one reference page of its host (the page with
the least hash, found by a grouped minimum). Aligned nodes are slots. Counting, over all pages of the host, how often each
text of a slot came gives the wrapper: the slot with the most different text holds the content, its parent is the region.

* A slot that says the same on nearly every page is template, wherever it is.
* A slot outside the region is template as well if what it says on a page is often said on other pages too (a menu or
  footer that comes in a few versions), unless the content recurs as often, as where pages are copies of each other.
* All other slots vary and are content, in page order.

What HTML itself marks as outside the article (``CHROME`` elements, hidden ones, names such as ``advert``) goes as well, as
adverts and comments vary like content. Inside <article> and <main> a name counts only if it says nothing else; words that
articles use too (``WEAK``) count only outside. Where a host has fewer than ``MIN_PAGES`` pages there is no wrapper, and
<article> or <main> is the region if it has text.

Trees have few nodes, as repeated siblings are merged; where they still are wide, as in a glossary, siblings are paired by
kind in order once a page's tables have used up ``CELLS``, so aligning is linear in the page. Counts are made of partial
counts; wrappers are joined back by host, by broadcast only if their counted bytes fit.

Blocks: text between block-level tags. Character references are decoded, white space in a block becomes one space. Tags are
read as HTML reads them: a quote begins a value only after ``=``, and a tag that the end of the page cuts off ends the text.

Defined results: null or empty html gives an empty text; pages without a host align with each other; repeated rows are
separate pages; malformed or truncated markup is read as far as it goes (an unclosed element ends with its parent, elements
below ``DEEPEST`` are siblings in the tree, in every other way elements like others); columns other than those named are
ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, read, small_batches
from .language_id import host_parts

MIN_PAGES = 5
CONSTANT = 0.9
#: Share of pages whose text in a slot outside the region is said on other pages too, from which it is template.
RECURS = 0.3
#: The tree is no deeper than this: elements nested deeper hang side by side under one of this depth. They still open, close
#: and mark furniture as they are nested.
DEEPEST = 200
#: Cells of tables for matching the tree of one page: siblings beyond them are paired in order.
CELLS = 1 << 18

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover semantics annotation".split())
CHROME = frozenset("nav footer aside form button select dialog menu head object".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words that mark page furniture in class, id and role; those that articles use as well; those that say nothing.
FURNITURE = frozenset("ad adbox ads adslot adunit advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs mainnav topnav sidebar cookie cookiebanner cookiebar cookies consent gdpr popup modal overlay newsletter comment comments disqus replies footer masthead toolbar pagination pager skip complementary contentinfo".split())
WEAK = frozenset("banner promo promotion side widget notice notices subscribe subscription signup social share sharing related recommended search alert".split())
PLAIN = frozenset("area bar block box button buttons col column container content group inner items left link links list main outer row right section slot top bottom unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!--?>|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTR = re.compile(r"([^\s\"'/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element; ``own`` are the blocks of text that lie directly in it, as (order, text).

    ``up`` is the element around it, ``base`` the one whose kids are those that it holds.
    """

    __slots__ = ("base", "depth", "kids", "kind", "main", "own", "slot", "tag", "up", "weed")

    def __init__(self, tag: str, kind: str, up: Node | None, weed: bool, main: bool):
        self.tag, self.kind, self.up, self.weed, self.main = tag, kind, up, weed, main
        self.depth: int = up.depth + 1 if up else 0
        self.base: Node = self if self.depth <= DEEPEST else up.base
        self.kids: list[Node] = []
        self.own: list[tuple[int, str]] = []
        self.slot = ""


def _kind(tag: str, attrs: str, inside_main: bool) -> tuple[str, bool]:
    """The node's kind for alignment, and whether its markup says it is page furniture."""
    kind, weed = tag, tag in CHROME or tag == "header" and not inside_main
    if attrs and attrs.strip():
        for name, a, b, c in _ATTR.findall(attrs):  # one after the other, so a value that looks like an attribute is none
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                weed = True
            elif name in ("class", "id", "role"):
                words = {w for w in _SPLIT.split(value) if w and not w.isdigit()}
                if tag in ("html", "body", "article", "main"):
                    pass
                elif inside_main:
                    weed |= bool(words & FURNITURE) and words <= FURNITURE | WEAK | PLAIN
                else:
                    weed |= bool(words & FURNITURE or words & WEAK or "header" in words)
                if name == "class":
                    kind += "." + ".".join(sorted(words))
    return kind, weed


def parse(page: str) -> Node:
    """A tree of block-level elements; inline elements are transparent."""
    root = Node("", "", None, False, False)
    at, order, buf, last = root, 0, [], 0

    def flush() -> None:
        nonlocal order
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                at.own.append((order, text))
                order += 1

    pos, n = 0, len(page)
    opened: dict[str, int] = {}  # how many elements around ``at``, itself too, have a tag
    weeds: list[str] = []  # open inline elements that are furniture
    while pos < n:
        m = _TOKEN.search(page, pos)
        if not weeds:
            buf.append(page[pos : m.start() if m else n])
        if not m:
            break
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        rest = _REST.match(page, pos)
        if not rest:
            break  # the end of the page cuts it off
        pos, attrs = rest.end(), rest[1]
        if tag in MATH:
            continue
        if tag in INLINE:
            if tag in ("br", "wbr"):
                buf.append(" " if tag == "br" else "")
            elif weeds:
                if tag == weeds[0]:
                    weeds.append(tag) if not m[1] else weeds.pop()
            elif not m[1] and attrs.strip() and _kind(tag, attrs, at.main)[1]:
                weeds.append(tag)
            continue
        if tag in RAW:  # the text around it is one block
            if not m[1] and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if not m[1]:
            weeds.clear()
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and at.tag == "p" or tag == at.tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                opened[at.tag] -= 1
                at = at.up
            kind, weed = _kind(tag, attrs, at.main)
            at.base.kids.append(node := Node(tag, kind, at, at.weed or weed, (at.main or tag in ("article", "main")) and not weed))
            if not attrs.endswith("/"):
                opened[tag] = opened.get(tag, 0) + 1
                at = node
        else:
            weeds.clear()
            if opened.get(tag):
                flush()
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.up
                opened[tag] -= 1
                at = at.up
            elif tag == "p":
                flush()
    flush()
    return root


def fold(node: Node) -> tuple:
    """(kind, [folded kids]) with neighbouring kids of one kind merged; keeps the merged nodes for slots."""
    runs: list[list[Node]] = []
    for k in node.kids:
        if runs and runs[-1][0].kind == k.kind:
            runs[-1].append(k)
        else:
            runs.append([k])
    return (node.kind, [(run[0].kind, _merge(run), run) for run in runs], [node])


def _merge(run: list[Node]) -> list[tuple]:
    if len(run) == 1:
        return fold(run[0])[1]
    kinds: dict[str, list[Node]] = {}
    for node in run:
        for k in node.kids:
            kinds.setdefault(k.kind, []).append(k)
    return [(kind, _merge(nodes), nodes) for kind, nodes in kinds.items()]


def plain(tree: tuple) -> list:
    """The folded tree without its nodes, as stored for the reference page."""
    return [tree[0], [plain(k) for k in tree[1]]]


def _in_order(xs: list, ys: list) -> list[tuple[int, int]]:
    """Pairs of siblings of one kind, each the first that is left, in order: what is matched where a table would be too large."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(xs):
        places.setdefault(x[0], []).append(i)
    pairs, after, taken = [], 0, dict.fromkeys(places, 0)
    for j, y in enumerate(ys):
        own = places.get(y[0], [])
        k = bisect_left(own, after, taken.get(y[0], 0))
        if k < len(own):
            pairs.append((own[k], j))
            after, taken[y[0]] = own[k] + 1, k + 1
    return pairs[::-1]


def match(a: list, b: tuple, seen: dict, cells: list[int] | None = None) -> int:
    """Simple tree matching: the most nodes of two ordered trees that can be paired, parents with parents.

    ``seen`` keeps the best pairing of children found for each pair of nodes. ``cells`` is what is left of the page's
    ``CELLS`` of tables: siblings whose table would not fit are paired by kind in order instead (a glossary of a thousand
    terms), so time and memory are linear in the page beyond a fixed amount.
    """
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key in seen:
        return seen[key][0]
    cells = [CELLS] if cells is None else cells
    xs, ys = a[1], b[1]
    if len(xs) * len(ys) > cells[0]:
        pairs = _in_order(xs, ys)
        seen[key] = (1 + sum(match(xs[i], ys[j], seen, cells) for i, j in pairs), pairs)
        return seen[key][0]
    cells[0] -= len(xs) * len(ys)
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(ys):
            w = match(x, y, seen, cells)
            row[j + 1] = max(above[j + 1], row[j], above[j] + w if w else 0)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    seen[key] = (best[-1][-1] + 1, pairs)
    return seen[key][0]


def align(reference: list | None, page: Node) -> None:
    """Name every node's slot: the reference node that it is paired with, or else its own path below the last pair."""
    tree, seen = fold(page), {}
    if reference:
        match(reference, tree, seen)

    def name(ref: list | None, t: tuple, slot: str) -> None:
        for node in t[2]:
            node.slot = slot
        pairs = {j: i for i, j in seen[(id(ref), id(t))][1]} if ref is not None and (id(ref), id(t)) in seen else {}
        for j, kid in enumerate(t[1]):
            if j in pairs:
                name(ref[1][pairs[j]], kid, f"{slot}/{pairs[j]}")
            else:
                name(None, kid, f"{slot}/{kid[0]}~{j}")

    name(reference, tree, "")


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for k in node.kids:
        yield from _walk(k)


def slots(page: Node) -> dict[str, list[str]]:
    """Texts of each slot."""
    out: dict[str, list[str]] = {}
    for node in _walk(page):
        if node.own:
            out.setdefault(node.slot, []).extend(t for _, t in node.own)
    return out


def extract(page: Node, constant: set[str] | None) -> str:
    """Blocks of the slots that are not ``constant`` in page order; without a wrapper (None), inside <article> or <main> if
    the page has one with text."""
    found = [(o, t, node.main) for node in _walk(page) if not node.weed and node.slot not in (constant or ()) for o, t in node.own]
    if constant is None and any(main for *_, main in found):
        found = [x for x in found if x[2]]
    return "\n".join(t for _, t, _ in sorted(found))


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(plain(fold(parse(h)))) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "tree"])




def _tree(known: dict, text: str | None) -> list | None:
    """The reference tree, read once for each run of pages of a host."""
    if text not in known:
        if len(known) > 256:
            known.clear()
        known[text] = json.loads(text) if text else None
    return known[text]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        hosts, names, hashes, sizes = [], [], [], []
        for host, page, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree")), strict=True):
            root = parse(page or "")
            align(_tree(known, tree), root)
            for slot, texts in slots(root).items():
                text = "\n".join(texts)
                hosts.append(host)
                names.append(slot)
                hashes.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.string()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], ["host", "slot", "said", "size"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = []
        for page, tree, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "tree", "constant")), strict=True):
            root = parse(page or "")
            align(_tree(known, tree), root)
            texts.append(extract(root, None if constant is None else set(constant)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def induce(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, share: float = CONSTANT, recurs: float = RECURS) -> DataFrame:
    """Wrappers: host, tree (of the reference page), constant (slots of the template; null where the host has too few pages).

    ``pages``: page_id, html, host. Nothing is template unless the slot with the most different text has at least twice as
    many texts as ``share`` would leave.
    """
    whole = pages.filter(F.col("html").isNotNull())
    first = whole.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("page_id", "html"), "page_id")).alias("html"), F.count("*").alias("pages"))
    trees = scratch.cut(first.select("host", "html").mapInArrow(_references, "host string, tree string"), "trees")
    told = whole.join(bounded(trees), "host").select("host", "html", "tree").mapInArrow(_aligned, "host string, slot string, said long, size long")
    counts = told.groupBy("host", "slot", "said").agg(F.count("*").alias("count"), F.max("size").alias("size"))
    again = F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0))
    per = counts.groupBy("host", "slot").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.count("*").alias("texts"), again.alias("again"), F.sum("size").alias("mass"))
    per = scratch.cut(per, "slots")
    main = per.groupBy("host").agg(F.max_by(F.struct("slot", "n", "texts", "again"), F.struct("mass", "slot")).alias("main"))
    main = main.select("host", F.regexp_replace("main.slot", "/[^/]*$", "").alias("region"), F.col("main.texts").alias("varied"), (F.col("main.again") / F.col("main.n")).alias("as_usual"))
    inside = (F.col("slot") == F.col("region")) | F.startswith("slot", F.concat("region", F.lit("/")))
    often = F.col("again") / F.col("n")
    template = (F.col("most") >= share * F.col("n")) | ~inside & (often >= recurs) & (often >= 2 * F.col("as_usual"))
    constant = per.filter(F.col("n") >= min_pages).join(main, "host").filter((F.col("varied") >= F.greatest(F.lit(2), 2 * (1 - share) * F.col("n"))) & template)
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("constant"))
    many = first.filter(F.col("pages") >= min_pages).select("host").join(constant, "host", "left").select("host", F.coalesce("constant", F.array().cast("array<string>")).alias("constant"))
    return scratch.cut(trees.join(many, "host", "left"), "wrappers")


def extract_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Main text of every page: page_id, url, text. ``pages``: page_id, url, html."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_parts(F.col("url"))[0].alias("host"))
    wrappers = induce(rows, scratch)
    return rows.join(bounded(wrappers), "host", "left").select("page_id", "url", "html", "tree", "constant").mapInArrow(_extracted, "page_id long, url string, text string")


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read(spark, sf_dir, "pages"), Scratch(spark, "wrapper"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
