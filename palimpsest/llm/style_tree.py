"""Main text of web pages with site style trees.

The pages of a host are merged into one tree whose nodes are paths of tags with their class and id names. A
node's presentation importance is the normalised entropy of its sequences of children over the pages, its
content importance that of each page's whole sequence of texts there, both by the number of pages: what looks and reads
the same on every page scores near 0, what differs near 1. Branches whose combined importance is low are removed from each page, with what marks
itself as something other than the article (menus, footers, adverts, forms, ...); a mere name does so only if the branch
holds neither the only article nor most of the page. If a page has an article or main element,
text outside it is left out. A branch goes only while the whole (article or main element, else the page) isn't low, and
what differs more than the whole does stays. Equal pages of a host have one vote. So hosts full of copies keep their text.

Pages are parsed once, in tasks; equal pages are found by host and hash, and the tree is counted per (host, path, text) with partial sums, so a host with a
third of all pages is spread like any other. Verdicts are broadcast when counted to be few, else joined.

Defined results: null and empty pages give an empty text; equal rows are separate pages; pages without a usable address
form the host ''; other columns stay, those named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import own_names, written

#: A branch is low below this importance, seen on at least this many pages of the host.
LOW, PAGES = 0.2, 5
#: Share of the texts below a node in its importance; the rest is its own presentation.
BELOW = 0.7
BROADCAST = 200_000

# Tags by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style head title noscript iframe noembed noframes xmp template svg canvas object audio video map math select textarea button "
    "option datalist nav footer aside form menu dialog".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img td th".split()
)
#: A new tag of the key closes an open tag of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names (class, id, role) of what is no article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer footnav masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager "
    "copyright search searchbox hidden contentinfo complementary dialog form".split()
)
#: Names that say nothing as a part of a longer one, unless the rest of it is such a thing ("share-box", not "share-price").
WEAK = frozenset("hidden form search share related".split())
THINGS = frozenset("articles bar box button buttons content field icons input items links list panel posts section stories tools widget wrap wrapper".split())
#: Names of the article; beside them only whole names count as noise.
CONTENT = frozenset("article body content entry main post story text".split())
#: What is never the article, however long.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus gdpr promo recommended reply replies respond sponsor sponsored".split()
)
#: What makes an article element something else than the article, and words that take a name's noise away ("no-sidebar").
ASIDE_ARTICLES = frozenset("ad ads advert comment comments promo recommended related reply sponsored teaser".split())
MODIFIERS = frozenset("no has with without is layout".split())
HEADERS = frozenset(("header", "siteheader", "pageheader", "banner"))
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)>|[!?/][^>]*>)""", re.S
)
#: Tags of the rest of a page, once one has been found that never closes outside its quotes.
PLAIN_TOKEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
#: Elements further down than this share the node of their ancestor there; their texts stay blocks of their own.
DEPTH = 100
LISTS = ("ul", "ol", "dl", "table", "select")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[^a-zA-Z]+")


class _Node:
    __slots__ = ("tag", "path", "drop", "named", "held", "main", "children", "block")

    def __init__(self, tag: str, sign: str, parent: _Node | None, drop: bool, named: int = 0, number: int = 0) -> None:
        self.tag = tag
        if parent is None:
            self.path: tuple[int, ...] = (0,)
        elif len(parent.path) < DEPTH:
            self.path = (*parent.path, xxhash.xxh64_intdigest(f"{parent.path[-1]}>{sign}") - 2**63)
        else:
            self.path = parent.path
        self.drop = drop or bool(parent and parent.drop)
        self.main = len(self.path) if tag in MAIN and not (parent and parent.main) else parent.main if parent else 0
        # the outermost element that a name calls noise, (number of it, how sure); of an article the one it lies in is ``held``
        own, above = ((number, named) if named else None), parent.named if parent else None
        begins = bool(self.main and parent and not parent.main)
        self.held = above if begins else parent.held if parent else None
        self.named = own if begins or above is None else (above[0], max(above[1], named))
        self.children: list[str] = []
        self.block = parent.block if parent and tag in INLINE else self  # the innermost element that isn't inline


def _tokens(page: str) -> Iterator[re.Match | None]:
    """The page's tags and comments, each asked for with the place to go on from; None once there are no more.

    A tag that closes nowhere outside its quotes is text, and so that no later one looks as far for its end again, quotes count for nothing
    behind it. Behind the last > there is no tag.
    """
    token, last, at = TOKEN, page.rfind(">"), 0
    while True:
        at = page.find("<", at)
        if at < 0 or (at > last and not page.startswith("<!--", at)):
            return
        match = token.match(page, at)
        if match is None:
            if token is TOKEN and re.match("<[a-zA-Z/]", page[at : at + 2]):
                token = PLAIN_TOKEN  # the same place once more
                continue
            at += 1
            continue
        at = (yield match) or match.end()


class Block:
    """A block of text, the path to it and place of its article or main element in it (0: outside any)."""

    __slots__ = ("text", "path", "main", "named", "held")

    def __init__(self, text: str, node: _Node) -> None:
        self.text, self.path, self.main, self.named, self.held = text, node.path, node.main, node.named, node.held


def _noise(names: list[str], words: frozenset[str]) -> set[str]:
    """The ``words`` that are a whole name, or the first or last part of one."""
    found = {*words} & {*names}
    article = bool(CONTENT & set(names))
    for name in names:
        parts = [p for p in NAMES.split(name) if p]
        if len(parts) == 1 and not article:
            found |= words & set(parts)
        if len(parts) < 2 or article or MODIFIERS & set(parts):
            continue
        for word, rest in ((parts[0], parts[1:]), (parts[-1], parts[:-1])):
            if word in words and (word not in WEAK or (THINGS | WEAK) & set(rest)):
                found.add(word)
    return found


def _sign(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, int]:
    """Tag with class and id names, whether it is no article, and whether names say so: 0, 1 or 2 (for sure)."""
    if not attributes.strip():
        return tag, tag in DROPPED or (tag == "header" and not in_main), 0
    names, hidden = [], False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            names += value.split()
        hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
    if "main" in names and "role" in attributes.lower():
        tag = "main" if tag in ("div", "section") else tag
    noise = _noise(names, ASIDE_ARTICLES if tag == "article" else NOISE if in_main else NOISE | HEADERS)
    shape = sorted({re.sub(r"\d+", "0", name) for name in names})
    named = 0 if not noise or tag in ("html", "body", "main") else 2 if noise & SURE or tag == "article" else 1
    drop = tag in DROPPED or hidden or (tag == "header" and not in_main) or (named > 0 and tag in INLINE)
    return ".".join([tag, *shape]), drop, named


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks that may be the page's text: of the article if there is one, without branches that names call noise.

    Such a branch counts for all that if it holds the only article, or more text than the rest of a page without one
    (the tree still removes what is the same on every page), unless its name is sure.
    """
    plain = [b for b in blocks if not b.named and not b.held]
    article = [b for b in plain if b.main] or [b for b in blocks if b.main and not b.named and b.held and b.held[1] == 1]
    if article:
        return article
    sizes: dict[int, int] = {}
    for b in blocks:
        if b.named and b.named[1] == 1 and not b.held:
            sizes[b.named[0]] = sizes.get(b.named[0], 0) + len(b.text)
    largest = max(sizes, key=sizes.__getitem__, default=None)
    if largest is None or sizes[largest] <= sum(len(b.text) for b in plain):
        return plain
    return [b for b in blocks if not b.held and (not b.named or b.named == (largest, 1))]


def parse(page: str) -> tuple[list[Block], list[tuple[tuple[int, ...], int]]]:
    """Blocks of text in page order, without what marks itself as noise, and the children of each element.

    Time and memory are linear in the page, whatever its form: what is open is looked up by tag, not searched for.
    """
    root = _Node("", "", None, False)
    stack, blocks, shapes, pieces = [root], [], [], []
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag

    def push(node: _Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def pop() -> None:
        node = stack.pop()
        if stack:
            opened[node.tag].pop()
        if node.children:
            shapes.append((node.path, xxhash.xxh64_intdigest(" ".join(node.children)) - 2**63))

    def innermost(tag: str) -> int:
        places = opened.get(tag)
        return places[-1] if places else 0

    def close(tag: str) -> None:
        """Close the innermost open ``tag`` and all inside it; without one, nothing."""
        k = innermost(tag)
        if k:
            if any(n.tag not in INLINE for n in stack[k:]):
                flush()
            while len(stack) > k:
                pop()

    def flush() -> None:
        # text belongs to the innermost open block, not to open inline tags such as an unclosed <b>
        if not pieces:
            return
        inner = stack[-1].block
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text and not inner.drop:
            blocks.append(Block(text, inner))

    def said(text: str) -> None:
        if text and not stack[-1].drop:
            pieces.append(html.unescape(text) if "&" in text else text)

    tokens, at, go_on = _tokens(page), 0, None
    while True:
        try:
            match = tokens.send(go_on)
        except StopIteration:
            said(page[at:])
            break
        go_on = None
        said(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "p" and not innermost("p"):
                flush()
            elif tag == "br":
                pieces.append(" ")
            else:
                if tag in ("td", "th"):
                    pieces.append(" ")
                close(tag)
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
            while stack[-1].tag in INLINE and stack[-1].tag not in ("td", "th"):  # open inline tags don't carry over into the next block
                pop()
            if stack[-1].tag == "p":
                pop()
        for other in CLOSES.get(tag, ()):
            if innermost(other) > max(map(innermost, LISTS)):
                close(other)
        if tag in ("td", "th", "img"):
            pieces.append(" ")
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        sign, drop, named = _sign(tag, match[3], bool(stack[-1].main))
        stack[-1].children.append(sign)
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = go_on = ending.end() if ending else len(page)
            continue
        node = _Node(sign.split(".")[0] if sign.startswith("main") else tag, sign, stack[-1], drop, named, at)
        if node.tag not in MAIN:
            node.tag = tag
        if not match[3].endswith("/") or tag not in ("path", "svg", "use"):
            push(node)
    flush()
    while stack:
        pop()
    return chosen(blocks), shapes


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("text", pa.string()), ("node", pa.int64())])
    told = pa.struct([("path", pa.list_(pa.int64())), ("main", pa.int32()), ("feature", pa.int64()), ("size", pa.int64())])
    shape = pa.struct([("node", pa.int64()), ("feature", pa.int64())])
    for batch in batches:
        hosts, found, texts, shapes, same = [], [], [], [], []
        n = batch.num_columns
        for url, page in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1), strict=True):
            blocks, children = parse(page.as_py() or "")
            hosts.append(host_of(url))
            found.append([(b.text, b.path[-1]) for b in blocks])
            texts.append(_texts(blocks))
            shapes.append(_shapes(children))
            same.append(_hash(repr(([(b.path[-1], b.text) for b in blocks], shapes[-1]))))
        columns = [*batch.columns[: n - 2], pa.array(hosts), _structs(found, block), _structs(texts, told), _structs(shapes, shape), pa.array(same, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: n - 2], "__host", "__blocks", "__texts", "__shapes", "__same"])


def _texts(blocks: list[Block]) -> list[tuple]:
    """What the tree learns from a page: for each path the place of the article in it, the hash of all texts there in order, and their length."""
    found: dict[tuple[int, ...], tuple[int, list[str]]] = {}
    for b in blocks:
        found.setdefault(b.path, (b.main, []))[1].append(b.text)
    return [(path, main, _hash("\n".join(texts)), sum(map(len, texts))) for path, (main, texts) in found.items()]


def _shapes(children: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int]]:
    """For each node the hash of the children of all its elements on the page."""
    found: dict[int, list[int]] = {}
    for path, feature in children:
        found.setdefault(path[-1], []).append(feature)
    return [(node, features[0] if len(features) == 1 else _hash(repr(features))) for node, features in found.items()]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in rows], pa.list_(kind))


def importances(leaves: DataFrame, shapes: DataFrame) -> DataFrame:
    """For each host and node: ``pages``, ``content`` and ``importance``."""
    look = shapes.groupBy("__host", "node", "feature").agg(F.count("*").alias("n")).groupBy("__host", "node").agg(_entropy().alias("look"), F.sum("n").alias("shaped"))
    below = leaves.select("__host", F.explode("path").alias("node"), "content", "size", "pages").groupBy("__host", "node").agg(
        (F.sum(F.col("content") * F.col("size")) / F.sum("size")).alias("content"), F.max("pages").alias("pages")
    )
    both = below.join(look, ["__host", "node"], "left")
    importance = F.col("content") * BELOW + F.coalesce("look", "content") * (1 - BELOW)
    return both.select("__host", "node", F.coalesce("shaped", "pages").alias("pages"), "content", importance.alias("importance"))


def _entropy() -> Column:
    """Entropy of the counts ``n``, 1 if all are 1."""
    return F.when(F.sum("n") > 1, (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.sum("n"))).otherwise(F.lit(1.0))


def low_leaves(parsed: DataFrame, low: float, least_pages: int) -> DataFrame:
    """For each host the nodes whose own text is removed.

    Such a node lies in a low branch, below an article or main element or else the page, whose content isn't low as a
    whole, and differs less than that content does. Equal pages of a host have one vote.
    """
    votes = parsed.select("__host", "__same", "__texts", "__shapes").dropDuplicates(["__host", "__same"])
    texts = votes.select("__host", F.explode("__texts").alias("t")).select("__host", "t.*")
    leaves = texts.groupBy("__host", "path", "main", "feature").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    leaves = written(leaves.groupBy("__host", "path", "main").agg(_entropy().alias("content"), F.sum("size").alias("size"), F.sum("n").alias("pages")), "leaves")
    shapes = votes.select("__host", F.explode("__shapes").alias("s")).select("__host", "s.*")
    nodes = written(importances(leaves, shapes), "nodes")
    top = F.greatest("main", F.lit(1))  # place of the article or of the page in the path
    may = leaves.select(
        "__host", F.element_at("path", -1).alias("leaf"), "content", F.element_at("path", top).alias("whole"), F.explode(F.slice("path", top + 1, F.size("path"))).alias("node")
    )
    lows = nodes.where((F.col("importance") < low) & (F.col("pages") >= least_pages)).select("__host", "node")
    wholes = nodes.where(F.col("content") * BELOW >= low).select("__host", F.col("node").alias("whole"), F.col("content").alias("all"))
    return may.join(lows, ["__host", "node"]).join(wholes, ["__host", "whole"]).where("content < all").select("__host", "leaf").distinct()


@own_names()
def main_text(pages: DataFrame, low: float = LOW, least_pages: int = PAGES, page: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without ``page``, with ``text`` and ``n_chars``."""
    columns = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    schema = ", ".join([kept] * bool(columns) + [
        "__host string", "__blocks array<struct<text string, node bigint>>", "__texts array<struct<path array<bigint>, main int, feature bigint, size bigint>>",
        "__shapes array<struct<node bigint, feature bigint>>", "__same bigint",
    ])
    parsed = pages.select(*columns, F.col(url).alias("__url"), F.col(page).alias("__page")).mapInArrow(_parsed, schema)
    parsed = written(parsed, "pages")
    lows = written(low_leaves(parsed, low, least_pages), "low")
    none = F.array().cast("array<bigint>")
    many = lows.count()
    if not many:
        judged = parsed.withColumn("__low", none)
    else:
        by_host = lows.groupBy("__host").agg(F.collect_set("leaf").alias("__low"))  # nodes of a host's template
        by_host = F.broadcast(by_host) if many <= BROADCAST else by_host
        judged = parsed.join(by_host, "__host", "left").withColumn("__low", F.coalesce("__low", none))
    text = F.array_join(F.transform(F.filter("__blocks", lambda b: ~F.array_contains("__low", b["node"])), lambda b: b["text"]), "\n\n")
    return judged.select(*columns, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
