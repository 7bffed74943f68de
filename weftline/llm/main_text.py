"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree. A node is an element at a place: the children of an element, runs of alike ones taken together, are one of
its styles, and each of them is a node below that style. Presentation importance is the entropy of an element's styles over the host's
pages, content importance 1 less the entropy of what it says; both join into a composite importance from the leaves up. Branches of low
importance are removed from each page, as are those that their tag calls a menu, footer, form and the like. A role or class that does so is
evidence only: it is taken as an importance of 0 for a branch that neither holds the main text nor half of what the page says.
"""

from __future__ import annotations

import html
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, enter, free_names, join_sized, ship, small_batches, table

ship(__name__)

#: Branches of less importance are noise.
IMPORTANCE = 0.3
#: How fast an element's own presentation comes to outweigh its children as it has more styles (the published value).
GAMMA = 0.9
#: Counts that a task holds before it puts them out.
HELD = 100_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
NEVER = RAW | frozenset("head nav footer aside form button select option datalist dialog menu svg math object canvas audio video map".split())
#: Words of class, id and role that name what is not main text.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus "
    "widget widgets skip hidden contentinfo complementary dialog form".split()
)
MAIN = frozenset("article main content post entry story body".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table thead tbody tfoot tr td th caption hgroup".split()) | INLINE
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select", "datalist"), "tbody": ("table",), "tfoot": ("table",)}
WHOLE = frozenset("main body html".split())
#: Names that say how something is laid out, or that it is there, not what it is.
_state = re.compile(r"^(?:has|no|with|without|is|not|js|can|show|hide)[-_]|[-_](?:open|opened|closed|enabled|disabled|on|off|page|left|right)$", re.IGNORECASE)
_token = re.compile(r"<!--(?:[^-]|-(?!->))*+(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
_attr = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_space = re.compile(r"\s+")
_digits = re.compile(r"[0-9]+")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("children", "key", "kids", "look", "low", "marks", "named", "noise", "parent", "said", "style", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.noise, self.named, self.marks, style = tag in NEVER, False, frozenset(), ""
        if attrs and attrs.strip(" /"):
            known = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _attr.finditer(attrs)}
            style = " ".join(filter(None, (known.get("class"), known.get("id"), known.get("role"))))
            words = [w for w in style.split() if not _state.search(w)]
            self.marks = frozenset(part.lower() for w in words for part in _part.findall(w))
            shown = known.get("style", "").replace(" ", "").lower()
            # a paragraph or item is noise if a whole name says so; main and body are what they are, as is an article that is named as one
            self.named = tag not in WHOLE and not (tag == "article" and self.marks & MAIN) and not NOISE.isdisjoint(map(str.lower, words) if tag in PROSE else self.marks)
            self.noise |= "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in shown or "visibility:hidden" in shown
        # numbers in names are those of one page
        self.look, self.low = f"{tag}.{_digits.sub('0', style)}", False


def parse(page: str) -> Node:
    """A tree of Nodes and strings; end tags that are left out are put in as browsers do for paragraphs, items and cells."""
    root = Node("#root", None)
    node, at, end = root, 0, page.rfind(">") + 1
    while at < len(page):
        m = _token.search(page, at, end) if at < end else None
        if text := page[at : m.start() if m else len(page)]:
            node.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in CLOSES_P:
            up = node
            while up.parent and up.tag != "p" and (up.tag in INLINE):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in SIBLINGS:
            up = node
            while up.parent and up.tag not in SCOPES[tag]:
                if up.tag in SIBLINGS[tag]:
                    node = up.parent
                up = up.parent
        new = Node(tag, node, m[3] or m[6] or "")
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else len(page)
            gt = page.find(">", at)
            at = gt + 1 if close and gt >= 0 else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").rstrip().endswith("/"):
            node = new
    return root


def noisy(node: Node) -> bool:
    if node.tag == "header":  # an article's own header holds its title
        up = node.parent
        while up:
            if up.tag == "article":
                return False
            up = up.parent
        return True
    return node.noise


def name_noise(tree: Node) -> None:
    """Make noise of the branches that are named so, but for those that hold an article or main element, or at least half of the page's text."""
    order, size, holds, todo = [], {}, {}, [tree]
    while todo:
        node = todo.pop()
        if node.tag in RAW:
            continue
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        size[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(size.get(id(c), 0) for c in inner)
        holds[id(node)] = node.tag in ("article", "main") and not node.named or any(holds.get(id(c)) for c in inner)
    for node in order:
        node.noise |= node.named and not holds[id(node)] and 2 * size[id(node)] < size[id(tree)]


def roots(tree: Node) -> list[Node]:
    """The elements that hold the main text: articles, else main elements, else elements named so, else all; of nested ones the outermost."""
    found: dict[int, list[Node]] = {0: [], 1: [], 2: []}
    todo: list[tuple[Node, int]] = [(tree, 0)]
    while todo:
        node, inside = todo.pop()  # inside: bits of the ranks that an element above has
        if node.parent and noisy(node):
            continue
        rank = 0 if node.tag == "article" else 1 if node.tag == "main" or "main" in node.marks else 2 if node.marks & MAIN and node.tag in ("div", "section", "td") else None
        if rank is not None:
            if not inside & 1 << rank:
                found[rank].append(node)
            inside |= 1 << rank
        if rank != 0:
            todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    return found[0] or found[1] or found[2] or [tree]


def blocks(root: Node, prune: bool = True) -> list[str]:
    """Texts of the blocks under root in page order, without noise and, with prune, without branches of low importance."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := _space.sub(" ", "".join(held)).strip():
            out.append(text)
        held.clear()

    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, k = todo.pop()
        block = node.tag not in INLINE and node.tag not in ("td", "th")
        if k == 0 and block:
            flush()
        if k == len(node.children):
            if block:
                flush()
            elif node.tag in ("td", "th"):
                held.append(" ")
            continue
        todo.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            held.append(child)
        elif child.tag in ("br", "hr"):
            held.append(" ")
        elif not noisy(child) and not (prune and child.low):
            todo.append((child, 0))
    flush()
    return out


def hashed(data: bytes) -> int:
    return struct.unpack("<q", xxhash.xxh3_64_digest(data))[0]


def alike(a: Node, b: Node) -> bool:
    """Whether b goes on with a run that a is in: paragraphs, items and the like, and elements of one class. Plain sections each have their own place."""
    return a.look == b.look and (a.tag in PROSE or not a.look.endswith("."))


def styled(tree: Node, host: str) -> list[Node]:
    """The elements of a page that are nodes of its host's tree, parents first: blocks with text in them, each with its key, its style (0 for leaves), its kids and what it says itself."""
    tree.kids, tree.said, order, todo = [], [], [tree], [(c, tree) for c in reversed(tree.children)]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, str):
            owner.said.append(node)
            continue
        if node.tag in RAW or node.tag == "head":
            continue
        if node.tag in INLINE:
            owner.said.append(" " if node.tag == "br" else "")
        else:
            node.kids, node.said, owner = [], [], node
            order.append(node)
        todo += [(c, owner) for c in reversed(node.children)]
    for node in reversed(order):
        node.said = _space.sub(" ", "".join(node.said)).strip()
        node.kids.reverse()
        if node is not tree and (node.said or node.kids):
            up = node.parent
            while up.tag in INLINE:
                up = up.parent
            up.kids.append(node)
    tree.key, out = hashed(host.encode("utf-8", "surrogatepass")), [tree]
    for node in out:  # grows as it goes
        if node.kids:
            runs, at = [], []
            for k, kid in enumerate(node.kids):
                if not k or not alike(node.kids[k - 1], kid):
                    runs.append(kid.look)
                at.append(len(runs))
            node.style = hashed("\n".join(runs).encode("utf-8", "surrogatepass"))
            for k, kid in zip(at, node.kids, strict=True):
                kid.key = hashed(struct.pack("<qqq", node.key, node.style, k))
        else:
            node.style = 0
        out += node.kids
    return out


def shape_of(nodes: list[Node]) -> list[tuple[int, int, int, float, bool]]:
    """(key, style, parent's place, share of the key's elements on the page, whether they say something) of a page's nodes, parents first; alike elements of a run are one."""
    place: dict[tuple[int, int], int] = {}
    out: list[list] = []
    total: dict[int, int] = {}
    up = {id(kid): node for node in nodes for kid in node.kids}
    for node in nodes:
        total[node.key] = total.get(node.key, 0) + 1
        if (node.key, node.style) not in place:
            above = up.get(id(node))
            place[node.key, node.style] = len(out)
            out.append([node.key, node.style, place[above.key, above.style] if above else -1, 0, False])
        entry = out[place[node.key, node.style]]
        entry[3] += 1
        entry[4] |= bool(node.said)
    return [(key, style, parent, n / total[key], said) for key, style, parent, n, said in out]


SHAPE = "array<struct<key: long, style: long, parent: int, share: double, said: boolean>>"
STYLE, CONTENT, PAGE = 0, 1, 2


def style_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, node, value, share, n, shape): styles and contents of the nodes of each page, and each page's shape, counted within the task."""
    enter("pages")
    counts: dict[tuple[int, int, int], list] = {}
    shape_type = pa.list_(pa.struct([("key", pa.int64()), ("style", pa.int64()), ("parent", pa.int32()), ("share", pa.float64()), ("said", pa.bool_())]))

    def drain() -> pa.RecordBatch:
        keys, held = list(counts), list(counts.values())
        shapes = [None if h[2] is None else [dict(zip(("key", "style", "parent", "share", "said"), e, strict=True)) for e in h[2]] for h in held]
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([h[0] for h in held], pa.float64()), pa.array([h[1] for h in held], pa.int64()), pa.array(shapes, shape_type)]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["kind", "node", "value", "share", "n", "shape"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes = styled(parse(page or ""), host)
            shape = shape_of(nodes)
            here = {(STYLE, key, style): share for key, style, _, share, _ in shape}
            saying: dict[int, list[int]] = {}
            for node in nodes:
                if node.said:
                    saying.setdefault(node.key, []).append(hashed(node.said.encode("utf-8", "surrogatepass")))
            for key, said in saying.items():
                for value in said:
                    here[CONTENT, key, value] = here.get((CONTENT, key, value), 0.0) + 1 / len(said)
            for k, share in here.items():
                held = counts.setdefault(k, [0.0, 0, None])
                held[0] += share
                held[1] += 1
            held = counts.setdefault((PAGE, nodes[0].key, hashed(repr(shape).encode())), [1.0, 0, shape])
            held[1] += 1
        if len(counts) > HELD:
            yield drain()
    yield drain()


def composite(shape: list[dict], known: dict[int, tuple[float, int, float]], gamma: float) -> dict[int, float]:
    """The composite importance of each node on a page of this shape; known: a node's presentation importance, its styles and its content importance, (1, 1, 1) for nodes of one page."""
    total, n = [0.0] * len(shape), [0] * len(shape)
    joined: dict[int, float] = {}
    first = {e["key"]: i for i, e in reversed(list(enumerate(shape)))}
    out: dict[int, float] = {}
    for i in range(len(shape) - 1, -1, -1):
        e = shape[i]
        presentation, styles, content = known.get(e["key"], (1.0, 1, 1.0))
        if e["said"]:
            total[i] += content
            n[i] += 1
        below = total[i] / n[i] if n[i] else 1.0
        # an element without children is worth what it says; with children its own presentation counts the more, the more styles it has
        weight = gamma**styles if e["style"] else 1.0
        joined[e["key"]] = joined.get(e["key"], 0.0) + e["share"] * ((1 - weight) * presentation + weight * below)
        if first[e["key"]] == i:
            out[e["key"]] = joined[e["key"]]
            if e["parent"] >= 0:
                total[e["parent"]] += joined[e["key"]]
                n[e["parent"]] += 1
    return out


def importances(rows: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(node, importance, m): composite importance of every node that stands on m > 1 pages of its host, as a table; a node of one page has 1. rows: host, html.

    All counts are sums by node and value, and pages of one shape are looked at once, so a host of any size is no task of its own.
    """
    found = cut(rows.mapInArrow(style_features, f"kind int, node long, value long, share double, n long, shape {SHAPE}"), "style-features")
    of = lambda kind: found.where(F.col("kind") == kind).groupBy("node", "value").agg(F.sum("share").alias("w"), F.sum("n").alias("n"))
    styles = of(STYLE).groupBy("node").agg(F.round(F.sum("w")).alias("m"), F.count("*").alias("styles"), F.sum(F.col("w") * F.log("w")).alias("h")).where("m > 1")
    contents = of(CONTENT).groupBy("node").agg(F.sum("w").alias("cw"), F.sum(F.col("w") * F.log("n")).alias("ch"))
    presentation = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("h") / F.col("m") / F.log("m")))
    content = F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("ch") / F.col("cw"), F.lit(0.0)) / F.log("m"))
    stats = cut(styles.join(contents, "node", "left").select(F.col("node").alias("key"), F.col("m").cast("long").alias("m"), presentation.alias("presentation"), "styles", content.alias("content")), "style-stats")
    shapes = cut(found.where(F.col("kind") == PAGE).groupBy("value").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "page-shapes")
    at = shapes.select("value", F.explode(F.array_distinct(F.transform("shape", lambda e: e["key"]))).alias("key"))
    known = join_sized(at, stats, ["key"], "inner").groupBy("value").agg(F.collect_list(F.struct("key", "presentation", "styles", "content")).alias("known"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shape, n, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = composite(shape, {k["key"]: (k["presentation"], k["styles"], k["content"]) for k in held}, gamma)
                out += [(k["key"], values[k["key"]] * n, n) for k in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int64())], ["node", "v", "n"])

    per_shape = shapes.join(known, "value").select("shape", "n", "known").mapInArrow(joined, "node long, v double, n long")
    return cut(per_shape.groupBy("node").agg((F.sum("v") / F.sum("n")).alias("importance"), F.sum("n").alias("m")), "importances")


def prunable(node: Node, in_article: bool) -> bool:
    """The tree decides on every element but those that hold the main text, and on plain prose only outside articles: what an article says stays, if others say it too."""
    return bool(node.parent) and node.tag not in ("article", "main", "body", "html") and not (in_article and node.tag in PROSE and not node.marks)


def main_text(page: str | None, host: str = "", low: np.ndarray | None = None) -> str:
    """The page's text; low: sorted keys of nodes of low importance. A page that these would leave empty is read without them, and one that names would leave empty without names."""
    tree = parse(page or "")
    if low is not None and len(low):
        nodes = styled(tree, host)
        keys = np.array([n.key for n in nodes], dtype=np.int64)
        at = np.minimum(np.searchsorted(low, keys), len(low) - 1)
        inside = {id(tree): False}
        for node, hit in zip(nodes, low[at] == keys, strict=True):
            here = inside[id(node)] or node.tag == "article"
            node.low = bool(hit) and prunable(node, here)
            inside.update((id(k), here) for k in node.kids)
    plain = [t for r in roots(tree) for t in blocks(r, prune=False)]
    name_noise(tree)
    top = roots(tree)
    found = [t for r in top for t in blocks(r)]
    return "\n\n".join(found or [t for r in top for t in blocks(r, prune=False)] or plain)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", importance: float = IMPORTANCE, text_col: str = "main_text") -> DataFrame:
    """Every column of pages but html_col, with text_col.

    Null and empty pages give an empty text, as do pages without text; pages of any length and depth are read whole. A page with a null or odd url is of no host, so names alone
    decide on it. Rows that repeat are pages of their own, ties of importance go to keeping. A column named text_col is replaced, others stay
    whatever their names. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop(text_col)
    m_host, m_html, m_low = free_names(pages, "mt_host", "mt_html", "mt_low")
    df = pages.withColumns({m_host: F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit("")), m_html: F.col(html_col).cast("string")})
    nodes = importances(df.where(F.col(m_host) != "").select(F.col(m_host).alias("host"), F.col(m_html).alias("html")))
    low = cut(nodes.where(F.col("importance") < importance).select("node"), "low-nodes")
    rest = [c for c in pages.columns if c != html_col]
    few = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        held = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r["node"] for r in low.toLocalIterator()], dtype=np.int64)))
        df = df.select(*rest, m_host, m_html)
    else:  # pages meet the low nodes of their hosts; the roots' keys name the hosts
        of_hosts = nodes_of_hosts(df.select(F.col(m_host).alias("host"), F.col(m_html).alias("html")).where("host <> ''"), low)
        df = df.join(of_hosts.select(F.col("host").alias(m_host), F.col("low").alias(m_low)), m_host, "left").select(*rest, m_host, m_html, m_low)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pages")
        for batch in batches:
            n = len(rest)
            hosts, bodies = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            lows = [held.value] * len(hosts) if few else [None if x is None else np.sort(np.array(x, dtype=np.int64)) for x in batch.column(n + 2).to_pylist()]
            text = [main_text(b, h, x if h else None) for b, h, x in zip(bodies, hosts, lows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(text, pa.string())], [*rest, text_col])

    return df.mapInArrow(extracted, df.select(*rest, F.lit("").alias(text_col)).schema)


def nodes_of_hosts(rows: DataFrame, low: DataFrame) -> DataFrame:
    """(host, low): the low nodes of each host. rows: host, html."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pages")
        for batch in batches:
            out = {(host, node.key) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for node in styled(parse(page or ""), host)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["host", "node"])

    of = rows.mapInArrow(keyed, "host string, node long").distinct().join(low, "node", "left_semi")
    return of.groupBy("host").agg(F.collect_set("node").alias("low"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
