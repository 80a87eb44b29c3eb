"""Main text of web pages with a site style tree.

All pages of a host are merged into one tree of style nodes: a node is the path of elements (tag with
class and id) from the body down. Over the pages that have a node, the entropy of the child sequences
shown there, with the number and length of the blocks below (presentation), and of the texts shown there (content) gives its
importance: what looks or reads the same on every page of a site is furniture. The importance of a branch is composed of its own presentation and of what
stands below it, by length of text; branches of low importance go. Few pages say little, so entropies are
drawn towards 1 by as much as a few pages more would. On pages without an article element the tree names the main branch, the
innermost one of most of the text whose presentation surely varies, and what stands beside it in a constant presentation goes. Elements that are furniture by definition (menus, forms, scripts) go. Names of containers are a prior: outside an
article they decide, inside one the tree has to confirm that the container stands on many pages of the site. The
plain flow of an article, elements without class or id, is never cut by statistics.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import join_heavy, saved, slices, strings

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key ends an open element of the value, up to the nearest container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}
CONTAINERS = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())
#: Elements that are never main text.
FURNITURE = frozenset("head nav menu footer aside form fieldset button select option input textarea script style noscript iframe template dialog svg canvas object embed audio video map noembed noframes title search".split())
#: Parts of class and id names, or roles, that name furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations "
    "footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies "
    "pagination pager toolbar skip contentinfo complementary dialog search".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr br section div header details summary address hgroup center".split()) | INLINE
#: Elements that names can mark as furniture; headings, paragraphs, list items and inline elements are never judged by name.
NAMED = frozenset("div section aside ul ol dl table header article main details center figure".split())
#: Branches of lower importance go; pages of full entropy that every node is given on top of its own; weight left to what stands below a node for each way in which it is laid out.
LEAST, EXTRA, BELOW = 0.3, 4.0, 0.9
#: Presentation of a main branch, with as many pages of no entropy on top; presentation below which a branch beside it is constant.
VARIED, FLAT = 0.5, 0.45
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

Node = tuple[str, bool, bool, bool]  # element key, furniture by definition, named as furniture, is an article's container
#: Markup that may end without a mark of its own.
OPEN_ENDED = ("<!--", "<![CDATA[")


def element(tag: str, attributes: str, inside: bool) -> Node:
    """The style key of an element, whether it is furniture by definition or by name, whether it starts an article."""
    main = tag in ("article", "main")
    given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    parts = {x for x in SPLIT.split(" ".join(given.get(k, "") for k in ("class", "id", "role"))) if x}
    bad = tag in FURNITURE or tag == "header" and not inside or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    named = tag in NAMED and (not main or inside) and (not parts.isdisjoint(HINTS) or "header" in parts and not inside and tag in ("div", "section"))
    key = tag + "".join(f".{x}" for x in sorted(parts) if not x.isdigit())
    return key, bad, named, main or given.get("role") in ("main", "article")


class Place:
    """An open element: its node, the element around it, and what follows from both. A block's path is its place and all places around it."""

    __slots__ = ("around", "node", "id", "depth", "inside", "flow", "shown")

    def __init__(self, around: Place | None, node: Node):
        self.around, self.node = around, node
        key, _, _, main = node
        #: The style node: one 64-bit id for each path of keys.
        self.id = xxhash.xxh3_64_intdigest(f"{around.id if around else ''}/{key}") - (1 << 63)
        self.depth = around.depth + 1 if around else 0
        #: Whether an article or main element is on the path, and whether nothing but unnamed flow elements stands below the innermost one.
        self.inside = main or around is not None and around.inside
        self.flow = main or around is not None and around.flow and key in FLOW
        self.shown = False


def path_of(place: Place | None) -> list[Place]:
    out = []
    while place:
        out.append(place)
        place = place.around
    return out[::-1]


def blocks(page: str) -> Iterator[tuple[Place | None, str]]:
    """The text blocks of a page in order, each with the innermost open element (none at the top); repairs bad nesting.

    The work is in proportion to the page: an element is opened and closed once, and open elements are counted by tag, between containers too, so that none is
    looked for in vain.
    """
    stack: list[tuple[str, Place]] = []
    open_tags: dict[str, int] = defaultdict(int)
    # Open elements since each open container, by tag.
    scopes: list[dict[str, int]] = [defaultdict(int)]
    text: list[str] = []
    at, n = 0, len(page)
    last = page.rfind(">")

    def flush():
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if whole:
                yield stack[-1][1] if stack else None, whole

    def close() -> str:
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        if tag in CONTAINERS:
            scopes.pop()
        scopes[-1][tag] -= 1
        return tag

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        # Behind the last bracket no tag ends.
        m = (TOKEN.match(page, lt) or LOOSE.match(page, lt)) if lt < last or page.startswith(OPEN_ENDED, lt) else None
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[lt + 1] == "/":
            if tag not in INLINE:
                yield from flush()
            if open_tags[tag]:
                while close() != tag:
                    pass
            continue
        if tag not in INLINE:
            yield from flush()
            ends = ENDS.get(tag, ())
            while True:
                left = sum(scopes[-1][t] for t in ends)
                while left:
                    left -= close() in ends
                # The container around these elements may end too, and what is around that.
                if len(scopes) == 1 or not any(scopes[-2][t] for t in ends if t in CONTAINERS):
                    break
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CONTAINERS)
                if stack[k][0] not in ends:
                    break
                while len(stack) > k:
                    close()
        elif tag == "br":
            text.append(" ")
        if tag in VOID or m[2].endswith("/") and tag not in INLINE and tag not in FLOW:
            continue
        around = stack[-1][1] if stack else None
        node = element(tag, m[2], around is not None and around.inside)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if at <= last else None
            at = end.end() if end else n
            continue
        if tag not in INLINE or node[1]:
            if tag in INLINE:
                yield from flush()
            stack.append((tag, Place(around, node)))
            open_tags[tag] += 1
            scopes[-1][tag] += 1
            if tag in CONTAINERS:
                scopes.append(defaultdict(int))
    yield from flush()


def node_ids(place: Place | None) -> list[int]:
    """The style nodes of a path, from the outermost one."""
    return [x.id for x in path_of(place)]


def gathered(found: list[tuple[Place | None, str]]) -> tuple[dict[int, tuple[int, int | None]], dict[int, int], dict[int, int], dict[int, list[int]], set[int]]:
    """Of the blocks of a page: (depth, parent) of each style node, number and length of the blocks below it, its sequence of children, and the nodes under a name of furniture.

    An element is walked once, when a block is first shown in it; sums are carried up by depth.
    """
    up: dict[int, tuple[int, int | None]] = {}
    number: dict[int, int] = defaultdict(int)
    length: dict[int, int] = defaultdict(int)
    children: dict[int, list[int]] = defaultdict(list)
    named: set[int] = set()
    for place, text in found:
        if place is None:
            continue
        number[place.id] += 1
        length[place.id] += len(text)
        x: Place | None = place
        while x and not x.shown:
            x.shown = True
            around = x.around
            if x.id not in up:
                up[x.id] = x.depth, around.id if around else None
            if x.node[2]:
                named.add(x.id)
            if around and children[around.id][-1:] != [x.id]:
                children[around.id].append(x.id)
            x = around
    for k in sorted(up, key=lambda k: -up[k][0]):
        if (parent := up[k][1]) is not None:
            number[parent] += number[k]
            length[parent] += length[k]
    return up, number, length, children, named


def style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, node, named, look, firm, read, ways, share): every style node of every host.

    ``look`` and ``read`` are the entropies of presentation and content (null: no text of its own), ``ways`` the number of
    presentations, ``share`` the share of the host's pages that have the node, all drawn towards 1 by EXTRA pages; ``firm`` is the
    entropy of presentation drawn towards 0 by as many. Counts are summed
    inside each task before they are dealt out by host, node and feature, so a host with
    a third of all pages is no heavy group; entropies are sums over features.
    """
    def count(batches):
        # Summed over a few batches at most, so that a worker's memory stays bounded.
        seen: dict[tuple[str, int, int, int], int] = defaultdict(int)
        for b in slices(batches):
            for h, page in zip(strings(b, "host"), strings(b, "html"), strict=True):
                found = list(blocks(page))
                up, number, length, children, named = gathered(found)
                texts: dict[int, list[str]] = defaultdict(list)
                for place, text in found:
                    if place:
                        texts[place.id].append(text)
                for node in up:
                    seen[h, node, LOOK, xxhash.xxh3_64_intdigest(np.array(shape(children.get(node, []), number[node], length[node]), np.int64).tobytes()) - (1 << 63)] += 1
                    seen[h, node, NAMED_ON if node in named else THERE, 0] += 1
                for node, shown in texts.items():
                    seen[h, node, READ, xxhash.xxh3_64_intdigest("\n".join(shown)) - (1 << 63)] += 1
            if len(seen) > 200_000:
                yield counted(seen)
                seen.clear()
        if seen:
            yield counted(seen)

    raw = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(count, "host string, node long, kind int, feature long, n long")
    per = raw.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    sums = per.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.count("*").alias("ways"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    # H = -sum p log_m p with p = n/m, which is 1 - sum(n log n) / (m log m); one page has H = 1.
    m = F.col("m")
    bare = m * F.when(m > 1, 1 - F.col("nlogn") / (m * F.log("m"))).otherwise(1.0)
    entropy, firm = (bare + EXTRA) / (m + EXTRA), bare / (m + EXTRA)
    pick = lambda kind, of, fn=F.max: fn(F.when(F.col("kind") == kind, of))
    there = F.col("kind").isin(THERE, NAMED_ON)
    both = sums.groupBy("host", "node").agg(pick(LOOK, entropy).alias("look"), pick(LOOK, firm).alias("firm"), pick(READ, entropy).alias("read"), pick(LOOK, F.col("ways")).alias("ways"), F.sum(F.when(there, m)).alias("on"), F.coalesce(F.bool_or(F.col("kind") == NAMED_ON), F.lit(False)).alias("named"))
    number = pages.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count("*").alias("of"))
    return both.join(number, "host").select("host", "node", "named", "look", "firm", "read", "ways", ((F.col("on") + EXTRA) / (F.col("of") + EXTRA)).alias("share"))


def shape(children: list[int], blocks: int, length: int) -> list[int]:
    """The presentation of a node: its child sequence, the number of blocks below it, and their length by powers of two."""
    return [*children, blocks, length.bit_length()]


#: Kinds of counted features: presentations, texts, pages with the node, pages with it under a name of furniture.
LOOK, READ, THERE, NAMED_ON = range(4)


def counted(seen: dict) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), *(pa.array([k[i] for k in keys], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()))), pa.array(list(seen.values()), pa.int64())], ["host", "node", "kind", "feature", "n"])


Site = dict[int, tuple[float, float, int, bool, float]]  # look, read, ways, rare, firm: of the nodes of a host of which something is known


def importance(up: dict[int, tuple[int, int | None]], own: dict[int, int], length: dict[int, int], site: Site) -> dict[int, float]:
    """Composite importance of every node on a page, from (depth, parent) of each, the length of its own blocks and that of all below it.

    1 - BELOW^ways of it is the node's own presentation, the rest the mean of its texts and branches by their length. Nodes
    that the site's tree does not hold are of full importance.
    """
    full = (1.0, 1.0, 1, False, 0.0)
    total: dict[int, float] = defaultdict(float)
    for k, n in own.items():
        total[k] += n * site.get(k, full)[1]
    out: dict[int, float] = {}
    inner = {parent for _, parent in up.values()}
    for k in sorted(up, key=lambda k: -up[k][0]):
        look, _, ways, *_ = site.get(k, full)
        below = BELOW**ways if k in inner else 1.0
        out[k] = (1 - below) * look + below * total[k] / max(1, length[k])
        if up[k][1] is not None:
            total[up[k][1]] += length[k] * out[k]
    return out


class Dropped(dict):
    """Whether an element, or one around it, is furniture by definition or by name; inside an article names of containers that few pages of the site have do not count."""

    def __init__(self, site: Site):
        super().__init__({None: False})
        self.site = site

    def of(self, place: Place | None) -> bool:
        todo = []
        while place not in self:
            todo.append(place)
            place = place.around
        out = self[place]
        for x in reversed(todo):
            _, bad, named, _ = x.node
            inside = x.around is not None and x.around.inside
            out = self[x] = out or bad or named and not (inside and x.id in self.site and self.site[x.id][3])
        return out


def main_branch(up: dict[int, tuple[int, int | None]], length: dict[int, int], total: int, site: Site) -> list[int]:
    """The path to the innermost node of at least half of the page's text whose presentation surely varies on the site; empty if there is none."""
    best: int | None = None
    for k, (depth, _) in up.items():
        if k in site and site[k][4] >= VARIED and 2 * length[k] >= total and (best is None or depth > up[best][0]):
            best = k
    out = []
    while best is not None:
        out.append(best)
        best = up[best][1]
    return out[::-1]


def main_text(page: str, site: Site) -> str:
    """The blocks that stay, joined by an empty line; ``site`` holds nodes of the page's host, empty if nothing is known."""
    found, dropped = list(blocks(page)), Dropped(site)
    kept = [(place, t) for place, t in found if not dropped.of(place)]
    has_article = any(place and place.inside for place, _ in kept)
    if not site:
        return "\n\n".join(t for place, t in kept if not has_article or place and place.inside)
    up, _, length, _, _ = gathered(kept)
    own: dict[int, int] = defaultdict(int)
    for place, t in kept:
        if place:
            own[place.id] += len(t)
    value = importance(up, own, length, site)
    total = sum(len(t) for _, t in kept)
    main = [] if has_article else main_branch(up, length, total, site)
    # By falling breadth: whether a node or one around it is of low importance, and the node that leads away from the main branch. A branch of low
    # importance that holds most of the page's text is a site of copies, not furniture.
    low: dict[int | None, bool] = {None: False}
    away: dict[int | None, int | None] = {None: None}
    on = set(main)
    for k in sorted(up, key=lambda k: up[k][0]):
        parent = up[k][1]
        low[k] = low[parent] or value[k] < LEAST and 2 * length[k] <= total
        away[k] = None if k in on or main and parent == main[-1] else away[parent] if parent is not None and parent not in on else k
        if main and parent is not None and parent not in on and away[parent] is None:
            away[k] = None
    out = []
    for place, t in kept:
        if has_article and not (place and place.inside):
            continue
        # Beside the main branch, no heading, in a branch of constant presentation.
        if main and place and (k := away[place.id]) is not None and place.node[0].split(".")[0] not in HEADINGS and k in site and site[k][0] < FLAT:
            continue
        if place and not place.flow and low[place.id]:
            continue
        out.append(t)
    return "\n\n".join(out)


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", out_col: str = "main_text", max_broadcast_nodes: int = 200_000) -> DataFrame:
    """``pages`` with a column ``main_text``; raises if there is one already.

    A null or empty html gives an empty text; a null url is a host of its own name, the empty string;
    repeated rows are pages of their own; other columns stay, whatever their names; a very long page is one row; an empty table gives an
    empty one. The nodes of which something is known are broadcast while they number at most ``max_broadcast_nodes`` (counted first); beyond,
    they are joined by host.
    """
    if out_col in pages.columns:
        raise ValueError(f"pages already has a column {out_col}")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # The page's row is one column, so that no name of it can clash.
    hosted = pages.select(host.alias("host"), F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    tree = style_tree(hosted.select("host", F.col(f"row.`{html_col}`").alias("html")))
    rare = F.col("named") & (F.col("share") < LEAST)
    known = tree.where((F.col("look") < 0.95) | (F.col("firm") >= VARIED) | (F.coalesce("read", F.lit(1.0)) < 0.95) | rare)
    node = F.struct("node", "look", F.coalesce("read", F.lit(1.0)).alias("read"), F.col("ways").cast("int").alias("ways"), rare.alias("rare"), "firm")
    sites = saved(known.groupBy("host").agg(F.collect_list(node).alias("nodes")))
    nodes = sites.agg(F.sum(F.size("nodes"))).first()[0] or 0
    if nodes <= max_broadcast_nodes:
        joined = hosted.join(F.broadcast(sites), "host", "left")
    else:
        joined = join_heavy(hosted, sites, "host", hosted.groupBy("host").agg(F.count("*").alias("n")), "left")
    names, schema = pages.columns, T.StructType([*pages.schema.fields, T.StructField(out_col, T.StringType())])
    at = names.index(html_col)

    def run(batches):
        held: dict[str, Site] = {}
        for b in slices(batches):
            rows, found = b.column(1), b.column(2)
            pages, texts = rows.field(at).to_pylist(), []
            for k, (h, page) in enumerate(zip(b.column(0).to_pylist(), pages, strict=True)):
                if h not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[h] = {x["node"]: (x["look"], x["read"], x["ways"], x["rare"], x["firm"]) for x in found[k].as_py() or ()}
                texts.append(main_text(page or "", held[h]))
            yield pa.RecordBatch.from_arrays([*(rows.field(j) for j in range(len(names))), pa.array(texts, pa.string())], [*names, out_col])

    return joined.select("host", "row", "nodes").mapInArrow(run, schema)
