"""Main text of web pages by wrapper induction over the pages of a host.

Method. A page's block elements make a tree of labels (tag, class or id) in which equal
siblings are one node. The commonest tree of a host is its wrapper; each page's tree is
aligned with it by simple tree matching (the largest order-preserving match of equal
tags), so that every text block falls into a slot of the wrapper. Over all pages of the
host, what stands constant in a slot is template and what varies is content:

- A text is constant if it stands in a slot on CONSTANT of the pages that have the slot (and
  on LEAST pages at least), on pages of more than one content.
- A slot is linked if LINKS of its text is inside links; blocks of it that are so too are menus.
- The content region is found from the varying text outside links that each slot holds: from
  the root down, into the child that holds DOMINANT of it, as long as that child is no
  mere paragraph and no heading stands before it (a heading belongs to what follows).

Content is what varies inside the region. Names only help where structure doesn't tell: blocks in elements
and classes that never hold an article (nav, footer, aside, form, advert, comments, ...) have
no weight in finding the region, unless there is nothing else, and are left out inside it;
an article or main element is entered where no child dominates. A page without
the host's region (another layout) has its region found from its own text.

Rows: a null or empty page has an empty text; so has one without content. A null url
belongs to a host of its own. Repeated rows return as often as they come. Truncated and
broken markup is read as far as it goes; a tag that is cut off at the end is dropped.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, small_batches

CONSTANT, LEAST = 0.6, 3
LINKS, DOMINANT = 0.6, 0.6

BLOCKS = frozenset(
    "html head title body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article header footer main aside nav form fieldset "
    "figure figcaption address hr details summary dialog menu hgroup search center noscript template iframe object select textarea button".split()
)
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp svg math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"html", "head", "title", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "noscript", "template", "iframe", "object", "select", "textarea", "button"}
#: An open element of the key ends where one of these begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NEVER = frozenset("head title nav footer aside form script style noscript template iframe object select textarea button menu dialog search svg math canvas noembed noframes xmp".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|responses|discussion|disqus|footer|masthead|topbar|toolbar|popup|modal|overlay|widget|pagination|pager|toc|tags|skip)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Node:
    label: str
    bad: bool
    main: bool
    children: dict[str, Node] = field(default_factory=dict)
    number: int = 0

    def written(self) -> str:
        """The tree as text, e.g. `body(div.ad;article(h1;p;))`; trees may be deeper than Python's stack."""
        out: list[str] = []
        todo: list[Node | None] = [self]
        while todo:
            node = todo.pop()
            if node is None:
                out.append(")")
            elif node.children:
                out.append(f"{node.label}(")
                todo += [None, *reversed(node.children.values())]
            else:
                out.append(f"{node.label};")
        return "".join(out)


@dataclass
class Page:
    tree: Node
    nodes: list[Node]
    blocks: list[tuple[int, str, int]]  # node, text, characters inside links


def _described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label, whether it never holds an article, whether it holds the article."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    label = tag + ("." + re.sub(r"[^a-z-]+", "", names.split()[0].lower()) if names else "")
    bad = tag in NEVER or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES or bool(names and tag not in MAIN and tag not in ("body", "html") and _BAD.search(names))
    return label, bad, tag in MAIN or found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower()


def parse(source: str) -> Page:
    root = Node("", False, False)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = [("", root)]  # block elements that are open, and inline ones that are bad
    text: list[str] = []
    links = anchors = 0

    def flush() -> None:
        nonlocal links
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                blocks.append((stack[-1][1].number, said, links))
            text.clear()
        links = 0

    def close(until: int) -> None:
        flush()
        del stack[until:]

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        piece = source[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if anchors:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            text.append(" ")
        elif closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in ("td", "th", "table") and tag not in BLOCKS:
                        break
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            after = source.find(">", stop.end()) if stop else -1
            at = after + 1 if after >= 0 else end
        elif tag == "a":
            anchors = 1 if "href" in attributes.lower() else anchors
        elif tag in BLOCKS:
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in ("td", "th", "button", "object"):
                        break
            for i in range(len(stack) - 1, 0, -1):
                if tag in SIBLINGS.get(stack[i][0], ()):
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
            flush()
            if tag != "hr":
                label, bad, main = _described(tag, attributes)
                above = stack[-1][1]
                if tag == "header" and not above.main:
                    bad = True
                child = above.children.get(label)
                if child is None:
                    child = above.children[label] = Node(label, bad or above.bad, main or above.main, number=len(nodes))
                    nodes.append(child)
                if not attributes.rstrip().endswith("/") or tag in ("p", "div"):
                    stack.append((tag, child))
        elif tag not in VOID and attributes and _described(tag, attributes)[1]:
            flush()
            label = _described(tag, attributes)[0]
            above = stack[-1][1]
            child = above.children.get(label)
            if child is None:
                child = above.children[label] = Node(label, True, above.main, number=len(nodes))
                nodes.append(child)
            stack.append((tag, child))
    flush()
    return Page(root, nodes, blocks)


_LABEL = re.compile(r"[^();]*")


def _read_tree(written: str) -> list[tuple[str, list[int]]]:
    """(label, children) of each node of a written tree, in the order in which it is written."""
    out: list[tuple[str, list[int]]] = []
    open_nodes: list[int] = []
    at = 0
    while at < len(written):
        if written[at] == ")":
            open_nodes.pop()
            at += 1
            continue
        label = _LABEL.match(written, at)[0]
        at += len(label)
        if open_nodes:
            out[open_nodes[-1]][1].append(len(out))
        out.append((label, []))
        if written[at : at + 1] == "(":
            open_nodes.append(len(out) - 1)
        at += 1
    return out


@lru_cache(maxsize=4096)
def match_trees(one: str, other: str) -> tuple[int, ...]:
    """Simple tree matching: the node of `other` for each node of `one`, both as written; -1 for none."""
    a, b = _read_tree(one), _read_tree(other)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(a)))
    kept: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(i: int, j: int) -> int:
        if a[i][0].partition(".")[0] != b[j][0].partition(".")[0]:
            return 0
        if (i, j) not in kept:
            x, y = a[i][1], b[j][1]
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p in range(1, len(x) + 1):
                for q in range(1, len(y) + 1):
                    best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + match(x[p - 1], y[q - 1]))
            pairs, p, q = [], len(x), len(y)
            while p and q:
                if best[p][q] == best[p - 1][q]:
                    p -= 1
                elif best[p][q] == best[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    pairs.append((x[p], y[q]))
            kept[i, j] = best[-1][-1] + (2 if a[i][0] == b[j][0] else 1), pairs
        return kept[i, j][0]

    out = [-1] * len(a)
    if a and b and match(0, 0):
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            out[i] = j
            todo += kept[i, j][1]
    return tuple(out)


@dataclass
class Block:
    place: int  # of its node in the written tree
    said: str
    links: int
    bad: bool


def read_page(source: str, names: bool = True) -> tuple[str, list[Block]]:
    """A page's written tree and its text blocks; without `names` no block counts as bad for its element or class."""
    page = parse(source)
    place, todo = {}, [page.tree]
    while todo:
        node = todo.pop()
        place[node.number] = len(place)
        todo += reversed(node.children.values())
    return page.tree.written(), [Block(place[n], said, min(links, len(said)), names and page.nodes[n].bad) for n, said, links in page.blocks]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=4096)
def _paths(written: str) -> tuple[int, ...]:
    """Below 0: a number for the path of labels to each node."""
    tree = _read_tree(written)
    out = [0] * len(tree)
    if tree:
        out[0] = _key(tree[0][0])
    for i, (_, children) in enumerate(tree):
        for c in children:
            out[c] = _key(f"{out[i]}/{tree[c][0]}")
    return tuple(-1 - (x & (1 << 62) - 1) for x in out)


def _slots(written: str, wrapper: str | None) -> tuple[int, ...]:
    """The wrapper's slot of each node; nodes that it doesn't have count as slots of their own path."""
    aligned = match_trees(written, wrapper) if wrapper else ()
    return tuple(a if a >= 0 else p for a, p in zip(aligned, _paths(written))) if aligned else _paths(written)


def find_region(written: str, good: dict[int, int], every: dict[int, int]) -> int:
    """The node that holds the content, from the varying characters of each node: of good blocks if there are any, else of all."""
    tree = _read_tree(written)
    own = [max(0, (good if any(good.values()) else every).get(i, 0)) for i in range(len(tree))]
    total = own.copy()
    above = [0] * len(tree)
    for i, (_, children) in enumerate(tree):
        for c in children:
            above[c] = i
    for i in range(len(tree) - 1, 0, -1):
        total[above[i]] += total[i]
    at = 0
    while at < len(tree) and total[at]:
        children = [c for c in tree[at][1] if total[c]]
        if not children:
            break
        tag = lambda c: tree[c][0].partition(".")[0]
        best = max(children, key=lambda c: total[c])
        if total[best] < DOMINANT * total[at]:
            best = next((c for c in children if tag(c) in MAIN), -1)
        heads = any(c < best and tag(c) in HEADINGS for c in children)
        if best < 0 or heads or own[best] * 2 >= total[best] and tag(best) not in MAIN:
            break
        at = best
    return at


def _inside(written: str, region: int, aligned: tuple[int, ...], wrapper: str | None) -> tuple[int, int] | None:
    """The page's nodes that the wrapper's region holds, as a range of places; None if the page hasn't got it."""
    if not wrapper or region not in aligned:
        return None
    at = aligned.index(region)
    tree = _read_tree(written)
    if tree[at][0] != _read_tree(wrapper)[region][0]:
        return None
    end = at
    while tree[end][1]:
        end = tree[end][1][-1]
    return at, end


def main_text(written: str, blocks: list[Block], wrapper: str | None, region: int, constant: set[tuple[int, int]], linked: set[int]) -> str:
    slots = _slots(written, wrapper)
    varying = [(slots[b.place], _key(b.said)) not in constant for b in blocks]
    bounds = _inside(written, region, match_trees(written, wrapper) if wrapper else (), wrapper)
    if bounds is None:
        good, every = Counter(), Counter()
        for b, new in zip(blocks, varying):
            if new:
                every[b.place] += len(b.said) - b.links
                good[b.place] += (len(b.said) - b.links) * (not b.bad)
        at = find_region(written, good, every)
        bounds = _inside(written, at, tuple(range(len(slots))), written)
    low, high = bounds or (0, -1)
    menu = lambda b: slots[b.place] in linked and b.links >= LINKS * len(b.said)
    return "\n\n".join(b.said for b, new in zip(blocks, varying) if new and low <= b.place <= high and not b.bad and not menu(b))


_PARSED = "host string, tree string, places array<int>, keys array<long>, chars array<int>, links array<int>, bad array<boolean>"


def _parsed(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    """Each page's tree and what its blocks are like, without their texts."""
    types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    for batch in batches:
        some = batch.filter(batch.column("html").is_valid())
        out = []
        for source in some.column("html"):
            tree, blocks = read_page(source.as_py(), names)
            out.append((tree, [b.place for b in blocks], [_key(b.said) for b in blocks], [len(b.said) for b in blocks], [b.links for b in blocks], [b.bad for b in blocks]))
        if out:
            yield pa.RecordBatch.from_arrays([some.column("host"), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], [x.split()[0] for x in _PARSED.split(", ")])


_SEEN = "host string, slot long, text_key long, page_key long, chars long, links long, good long"
#: Stands for a page that has a slot, whatever its text.
_ANY = (1 << 63) - 1


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a page and slot, and each slot once a page."""
    types = [pa.string(), *[pa.int64()] * 6]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            slots = _slots(r["tree"], r["wrapper"])
            page_key = _key(repr(r["keys"]))
            found: dict[tuple[int, int], list[int]] = {}
            for place, key, chars, links, bad in zip(r["places"], r["keys"], r["chars"], r["links"], r["bad"]):
                found.setdefault((slots[place], _ANY), [0, 0, 0])
                sums = found.setdefault((slots[place], key), [0, 0, 0])
                sums[0] += chars
                sums[1] += links
                sums[2] += 0 if bad else chars - links
            out += [(r["host"], slot, key, page_key, *sums) for (slot, key), sums in found.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _SEEN.split(", ")])


_RULES = "host string, wrapper string, region int, constant array<struct<slot:long,text_key:long>>, linked array<long>"


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each host's wrapper."""
    for batch in batches:
        found = []
        for wrapper, sums in zip(batch.column("wrapper").to_pylist(), batch.column("sums").to_pylist()):
            slots = [x for x in sums or () if x["slot"] >= 0]
            found.append(find_region(wrapper, {x["slot"]: x["good"] for x in slots}, {x["slot"]: x["plain"] for x in slots}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("wrapper"), pa.array(found, pa.int32()), batch.column("constant"), batch.column("linked")], ["host", "wrapper", "region", "constant", "linked"])


def _extracted(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        rows = zip(batch.column("html"), *[batch.column(c).to_pylist() for c in ("wrapper", "region", "constant", "linked")])
        for source, wrapper, region, constant, linked in rows:
            page = read_page(source.as_py() or "", names)
            texts.append(main_text(*page, wrapper, -1 if region is None else region, {(x["slot"], x["text_key"]) for x in constant or ()}, set(linked or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, names: bool = True, wrapper: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    For comparisons: without `names` no element's or class's name counts against a block; without `wrapper`
    pages are read each for itself.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    plain = small_batches(pages).select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    parsed = saved(plain.select("host", "html").mapInArrow(partial(_parsed, names=names), _PARSED))
    counted = parsed.groupBy("host", "tree").agg(F.count("*").alias("n"))
    wrappers = saved(counted.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("wrapper")).where(F.lit(wrapper)))

    # one row a host: Spark broadcasts them where they are few and shuffles by host (splitting a hot one) where they aren't
    seen = parsed.join(wrappers, "host").mapInArrow(_seen, _SEEN)
    texts = saved(seen.groupBy("host", "slot", "text_key").agg(F.count("*").alias("n"), F.min("page_key").alias("a"), F.max("page_key").alias("b"), *[F.sum(c).alias(c) for c in ("chars", "links", "good")]))
    having = texts.where(F.col("text_key") == _ANY).select("host", "slot", F.col("n").alias("pages"))
    often = texts.where((F.col("text_key") != _ANY) & (F.col("n") >= LEAST) & (F.col("a") != F.col("b"))).join(having, ["host", "slot"])
    often = saved(often.where(F.col("n") >= CONSTANT * F.col("pages")).select("host", "slot", "text_key", "chars", "links", "good"))
    constant = often.groupBy("host").agg(F.collect_list(F.struct("slot", "text_key")).alias("constant"))
    sums = texts.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("chars", "links", "good")])
    linked = sums.where((F.col("links") >= LINKS * F.col("chars")) & (F.col("chars") > 0)).groupBy("host").agg(F.collect_list("slot").alias("linked"))
    gone = often.select("host", "slot", *[(-F.col(c)).alias(c) for c in ("chars", "links", "good")])
    varying = sums.unionByName(gone).where("slot >= 0").groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("chars", "links", "good")])  # as many a host as its wrapper has nodes
    varying = varying.groupBy("host").agg(F.collect_list(F.struct("slot", (F.col("chars") - F.col("links")).alias("plain"), "good")).alias("sums"))
    rules = wrappers.join(varying, "host", "left").join(constant, "host", "left").join(linked, "host", "left")
    rules = saved(rules.select("host", "wrapper", "sums", "constant", "linked").mapInArrow(_regions, _RULES))
    kind = f"page_id {plain.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return plain.join(rules, "host", "left").select("page_id", "url", "html", "wrapper", "region", "constant", "linked").mapInArrow(partial(_extracted, names=names), kind)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
