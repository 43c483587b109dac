"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. DOM trees of all pages of a host are aligned by simple tree
matching; nodes whose text stays the same become template, nodes whose text varies are
slots, and slots made of links are menus. Every page is then aligned with the wrapper of its
host: slots inside its main part are its text, template and menus are not.

For the alignment a tree is compact: children of one parent that share tag and class are one
node with all their texts, so a list of a thousand paragraphs is one node. Trees are merged in
rounds, a bounded number at a time, and what stands in the nodes is counted by joins and groups, so
no task sees all pages of a host. Nodes of fewer than TEMPLATE_PAGES pages can never be template:
they are left out of the merged trees, and links make them a menu of their own page.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import discard, slices, stored
from wafermill.llm.urlfilter import url_host

# Elements by their role in a page, and words of classes, ids and roles that name parts beside the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr br img".split()
)
BESIDE_TAGS = frozenset(
    "head script style noscript template iframe object svg canvas audio video nav footer aside form button select textarea "
    "input dialog menu title".split()
)
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup comment comments disqus social share sharing related recommended widget login search toolbar "
    "copyright legal skip pagination contentinfo complementary dialog alert".split()
)
MAIN_TAGS = frozenset(["article", "main"])
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
        "nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: An end tag only closes elements up to the next of these.
FENCES = frozenset(["table", "td", "th", "body", "html"])
WORD_CUT = re.compile(r"[^a-z]+")

#: A tag or comment that the end of the page cuts off is markup, not text.
CUT_OFF = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--(?:(?!-->)[\s\S])*)\Z")

#: Trees of a host that one step merges.
MERGED = 64
#: Distinct pages, and share of them, in which a text must stand for a template node.
TEMPLATE_PAGES, TEMPLATE_SHARE, MENU_SHARE = 3, 0.9, 0.6


#: Levels of a compact tree; text nested deeper belongs to the node at this level.
DEEPEST = 60


class Node:
    """A compact node: children by signature in order of appearance, and where its texts stand."""

    __slots__ = ("sig", "children", "beside", "main", "own", "size", "linked")

    def __init__(self, sig: str, beside: bool, main: bool):
        self.sig, self.beside, self.main = sig, beside, main
        self.children: dict[str, Node] = {}
        self.own: list[str] = []
        self.size = self.linked = 0

    def text(self) -> str:
        return " ".join("".join(self.own).split())


@lru_cache(maxsize=10_000)
def _signature(tag: str, names: str) -> tuple[str, bool]:
    """Tag and words of class, id and role as one string, and whether a word names a part beside the text."""
    words = set(WORD_CUT.split(names.lower()))
    return ".".join([tag, *sorted(words - {""})]), bool(words & BESIDE_WORDS)


class Page(HTMLParser):
    """Parses a page to a compact tree and its text pieces (block number, node, text) in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", False, False)
        self.open: list[tuple[str, Node]] = [("", self.root)]
        self.pieces: list[tuple[int, Node, str]] = []
        self.block = self.links = 0
        self.feed(CUT_OFF.sub("", html))
        self.close()
        # Letters of a node are its own and those below it.
        self.nodes = _nodes(self.root)
        for node in reversed(self.nodes):
            for child in node.children.values():
                node.size += child.size
                node.linked += child.linked

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not kept."""
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1:
            # Inline elements left open inside do not keep their block from ending.
            k = len(self.open) - 1
            while k and self.open[k][0] in INLINE and tag not in INLINE:
                k -= 1
            if tag in CLOSED_BY.get(self.open[k][0], ()):
                self._close_to(k)
            else:
                break
        if tag not in INLINE:
            self.block += 1
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        named = {k: (v or "") for k, v in attrs}
        sig, marked = _signature(tag, " ".join([named.get("class", ""), named.get("id", ""), named.get("role", "")]) if named else "")
        parent = self.open[-1][1]
        beside = (
            parent.beside or tag in BESIDE_TAGS or marked or "hidden" in named or named.get("aria-hidden") == "true"
            or "display:none" in named.get("style", "").replace(" ", "").lower() or (tag == "header" and not parent.main)
        )
        if tag in ("html", "body"):
            beside = False
        # Parts beside the text need no tree, and very deep nesting adds no more levels.
        if parent.beside or (len(self.open) > DEEPEST and not beside):
            node = parent
        else:
            node = parent.children.get(sig)
        if node is None:
            node = parent.children[sig] = Node(sig, beside, parent.main or tag in MAIN_TAGS)
        self.open.append((tag, node))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path", "iframe"):
            self.handle_endtag(tag)

    def _close_to(self, k: int) -> None:
        self.links -= sum(tag == "a" for tag, _ in self.open[k:])
        if any(tag not in INLINE for tag, _ in self.open[k:]):
            self.block += 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close_to(k)
                return
            if self.open[k][0] in FENCES and tag not in ("html", "body", "table", "tr", "tbody"):
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1][1]
        if node.beside or not data:
            return
        node.own.append(data)
        self.pieces.append((self.block, node, data))
        size = len("".join(data.split()))
        node.size += size
        node.linked += size * (self.links > 0)


class Tree:
    """A node without its texts; ``at`` counts the nodes of the whole tree from its root down."""

    __slots__ = ("sig", "kids", "at")

    def __init__(self, sig: str, kids: list[Tree]):
        self.sig, self.kids, self.at = sig, kids, 0

    def nodes(self) -> list[Tree]:
        """All nodes from the root down, numbered in this order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            node.at = len(out)
            out.append(node)
            todo.extend(reversed(node.kids))
        return out

    def plain(self) -> list:
        return [self.sig, [k.plain() for k in self.kids]]


def _tree(plain: list) -> Tree:
    return Tree(plain[0], [_tree(k) for k in plain[1]])


_encode = json.JSONEncoder(check_circular=False, separators=(",", ":")).encode


def _written(tree: Tree) -> str:
    return _encode(tree.plain())


def _nodes(root: Node) -> list[Node]:
    """All nodes of a page in the order of :meth:`Tree.nodes`."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo.extend(reversed(out[-1].children.values()))
    return out


def _shape(root: Node) -> Tree:
    return Tree(root.sig, [_shape(c) for c in root.children.values()])


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _paths(tree: Tree) -> list[int]:
    """A digest of the signatures from the root to every node."""
    out, todo = [], [(tree, "")]
    while todo:
        node, above = todo.pop()
        path = f"{above}/{node.sig}"
        out.append(_digest(path))
        todo.extend((k, path) for k in reversed(node.kids))
    return out


@lru_cache(maxsize=4096)
def _paths_of(shape: str) -> list[int]:
    return _paths(_tree(json.loads(shape)))


def aligned(left: Tree, right: Tree) -> list[tuple[Tree, Tree]]:
    """Matched pairs of nodes of two trees with equal roots, by simple tree matching."""
    return _match(left, right)[1]


def _match(left: Tree, right: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    # What the other side lacks cannot match and would only fill the table.
    shared = {k.sig for k in left.kids} & {k.sig for k in right.kids}
    rows, columns = ([k for k in t.kids if k.sig in shared] for t in (left, right))
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    inner = {}
    for i, a in enumerate(rows, 1):
        for j, b in enumerate(columns, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if a.sig == b.sig:
                inner[i, j] = _match(a, b)
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + inner[i, j][0])
    pairs, score, i, j = [(left, right)], best[-1][-1] + 1, len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner.pop((i, j))[1]
            i, j = i - 1, j - 1
    # Siblings differ in their signatures, so those that changed places are the same nodes still. With these a merged
    # tree does not depend on the order of its pages.
    matched = {id(a) for a, _ in pairs}
    for (i, _), (more, found) in sorted(inner.items()):
        if id(rows[i - 1]) not in matched:
            pairs += found
            score += more
    return score, pairs


def merged(trees: Iterable[Tree]) -> Tree | None:
    """One tree with the nodes of all, each at its place among its matched siblings."""
    wrapper = None
    for tree in trees:
        if wrapper is None:
            wrapper = tree
        else:
            _grow(wrapper, tree, {id(b): a for a, b in aligned(wrapper, tree)})
    return wrapper


def _grow(wrapper: Tree, tree: Tree, matched: dict[int, Tree]) -> None:
    at = 0
    for child in tree.kids:
        own = matched.get(id(child))
        if own is None:
            wrapper.kids.insert(at, child)
            at += 1
        else:
            at = next(i for i, k in enumerate(wrapper.kids) if k is own) + 1
            _grow(own, child, matched)


def pruned(tree: Tree, common: set[int]) -> Tree:
    """The tree without the nodes whose numbers are not ``common``, and what is below them."""
    tree.nodes()

    def cut(node: Tree) -> Tree:
        return Tree(node.sig, [cut(k) for k in node.kids if k.at in common])

    return cut(tree)


@lru_cache(maxsize=4096)
def _slots(wrapper: str, shape: str) -> list[int]:
    """The number of the wrapper's node for every node of a page's tree, or -1."""
    left, right = _tree(json.loads(wrapper)), _tree(json.loads(shape))
    left.nodes()
    out = [-1] * len(right.nodes())
    if left.sig == right.sig:
        for a, b in aligned(left, right):
            out[b.at] = a.at
    return out


def page_record(html: str) -> tuple[str, list[int], int, list[int], list[int], list[int]]:
    """What a wrapper needs of a page: its tree, the paths of its nodes, a digest of its text, and of every node
    a digest of its own text, its letters, and those in links."""
    page = Page(html)
    tree, nodes = _shape(page.root), page.nodes
    # Copies of one text must not look like template.
    body = _digest(page_text(page, None))
    shape = _written(tree)
    return shape, _paths_of(shape), body, [_digest(n.text()) for n in nodes], [n.size for n in nodes], [n.linked for n in nodes]


def judged(pages: int, times: int, size: int, linked: int) -> tuple[bool, bool]:
    """(template?, menu?) for a node that stands on ``pages`` pages, ``times`` of them with one and the same text."""
    return pages >= TEMPLATE_PAGES and times >= TEMPLATE_SHARE * pages, size > 0 and linked >= MENU_SHARE * size


def learn_wrapper(pages: list[str]) -> str:
    """The wrapper of some pages as JSON, [tree, [[node, text digest or null, menu?]]]: :func:`learn_wrappers` for
    a list of pages of one host."""
    distinct = {r[2]: r for r in sorted(map(page_record, pages), reverse=True)}.values()
    paths = Counter(p for r in distinct for p in r[1])
    trees = {pruned(_tree(json.loads(r[0])), {i for i, p in enumerate(r[1]) if paths[p] >= TEMPLATE_PAGES}) for r in distinct if paths[r[1][0]] >= TEMPLATE_PAGES}
    wrapper = merged(_tree(json.loads(t)) for t in sorted({_written(t) for t in trees}))
    if wrapper is None:
        return "null"
    shape = _written(wrapper)
    texts, sums = defaultdict(Counter), defaultdict(lambda: [0, 0])
    for tree, _, _, digests, sizes, linked in distinct:
        for slot, digest, size, link in zip(_slots(shape, tree), digests, sizes, linked, strict=True):
            texts[slot][digest] += 1
            sums[slot] = [sums[slot][0] + size, sums[slot][1] + link]
    marks = []
    for slot in sorted(set(texts) - {-1}):
        digest, times = max(texts[slot].items(), key=lambda t: (t[1], t[0]))
        fixed, menu = judged(texts[slot].total(), times, *sums[slot])
        if fixed or menu:
            marks.append([slot, digest if fixed else None, menu])
    return json.dumps([wrapper.plain(), marks])


@lru_cache(maxsize=1024)
def _read_wrapper(wrapper: str) -> tuple[str, dict[int, tuple[int | None, bool]]]:
    tree, marks = json.loads(wrapper)
    return json.dumps(tree, separators=(",", ":")), {slot: (digest, menu) for slot, digest, menu in marks}


def _dropped(page: Page, wrapper: str | None) -> set[int]:
    """Nodes of the page that its host's wrapper shows to be template or menu."""
    if wrapper is None:
        return set()
    nodes = page.nodes
    if wrapper == "null":
        slots, marks = [-1] * len(nodes), {}
    else:
        shape, marks = _read_wrapper(wrapper)
        slots = _slots(shape, _written(_shape(page.root)))
    out = set()
    for slot, node in zip(slots, nodes, strict=True):
        # A node that few pages have is judged by its own page.
        digest, menu = marks.get(slot, (None, False)) if slot >= 0 else (None, judged(1, 1, node.size, node.linked)[1])
        if digest is not None and _digest(node.text()) == digest:
            out.add(id(node))
        if menu and not node.main and node.sig.split(".")[0] not in ("", "html", "body"):
            out.update(id(n) for n in _nodes(node))
    return out


def page_text(page: Page, wrapper: str | None) -> str:
    """Text of the page's main part: blocks in page order, white space as one space."""
    gone = _dropped(page, wrapper)
    pieces = [(b, n, t) for b, n, t in page.pieces if id(n) not in gone]
    if any(n.main and t.strip() for _, n, t in pieces):
        pieces = [p for p in pieces if p[1].main]
    blocks: dict[int, list[str]] = {}
    for block, _, text in pieces:
        blocks.setdefault(block, []).append(text)
    return " ".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def learn_wrappers(rows: DataFrame) -> DataFrame:
    """``host`` and ``_wrapper`` from all pages (``host``, ``_html``) of every host with TEMPLATE_PAGES or more."""

    def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        for whole in batches:
            for part in slices(whole, "_html"):
                out = []
                for host, html in zip(part.column("host").to_pylist(), part.column("_html").to_pylist(), strict=True):
                    tree, paths, *rest = page_record(html)
                    shape = _digest(tree)
                    # Trees are much alike, so a task tells each once.
                    new = (host, shape) not in told
                    if len(told) >= 50_000:
                        told.clear()
                    told.add((host, shape))
                    out.append((shape, tree if new else None, paths if new else None, *rest))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("host"), *columns], names=["host", "shape", "tree", "paths", "body", "texts", "sizes", "linked"])

    schema = "host string, shape bigint, tree string, paths array<bigint>, body bigint, texts array<bigint>, sizes array<bigint>, linked array<bigint>"
    told = stored(rows.where("host <> ''").select("host", "_html").mapInArrow(recorded, schema), "page-nodes")
    distinct = stored(
        told.groupBy("host", "body").agg(F.min(F.struct("shape", "texts", "sizes", "linked")).alias("p")).select("host", "p.*"), "distinct-pages"
    )
    key = ["host", "shape"]
    shapes = told.where("tree IS NOT NULL").groupBy(*key).agg(F.min("tree").alias("tree"), F.min("paths").alias("paths"))
    shapes = stored(shapes.join(distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key), "page-shapes")

    # Nodes that enough pages have, then the trees of these nodes.
    nodes = shapes.select(*key, "n", F.posexplode("paths").alias("at", "path"))
    common = nodes.groupBy("host", "path").agg(F.sum("n").alias("_pages")).where(F.col("_pages") >= TEMPLATE_PAGES).select("host", "path")
    kept = nodes.join(common, ["host", "path"]).groupBy(*key).agg(F.collect_list("at").alias("common"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("tree").to_pylist(), batch.column("common").to_pylist(), strict=True)
            trees = [_written(pruned(_tree(json.loads(t)), set(c))) for t, c in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], names=["host", "_tree"])

    trees = stored(shapes.join(kept, key).select("host", "tree", "common").mapInArrow(cut, "host string, _tree string").distinct(), "page-trees")

    def joined(group: pa.Table) -> pa.Table:
        one = merged(_tree(json.loads(t)) for t in sorted(group.column("_tree").to_pylist()))
        return pa.table({"host": group.column("host").slice(0, 1), "_tree": pa.array([_written(one)], pa.string())})

    while True:
        counted = trees.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        if (counted.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
        part = F.pmod(F.xxhash64("_tree"), F.ceil(F.col("_n") / MERGED)).alias("_part")
        trees = stored(trees.join(counted, "host").select("host", "_tree", part).groupBy("host", "_part").applyInArrow(joined, "host string, _tree string"), "page-trees")

    # What stands in the nodes of the wrapper, over all distinct pages.
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [_slots(w, t) for w, t in zip(batch.column("_tree").to_pylist(), batch.column("tree").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(slots, pa.list_(pa.int64()))], names=["host", "shape", "slots"])

    slots = shapes.select(*key, "tree").join(trees, "host").select(*key, "tree", "_tree").mapInArrow(matched, "host string, shape bigint, slots array<bigint>")
    seen = distinct.join(slots, key).select("host", F.explode(F.arrays_zip("slots", "texts", "sizes", "linked")).alias("s")).select("host", "s.*").where("slots >= 0")
    texts = seen.groupBy("host", "slots", "texts").agg(F.count(F.lit(1)).alias("n"), F.sum("sizes").alias("size"), F.sum("linked").alias("link"))
    sums = texts.groupBy("host", "slots").agg(
        F.sum("n").alias("pages"), F.max(F.struct("n", "texts")).alias("most"), F.sum("size").alias("size"), F.sum("link").alias("link")
    )
    fixed = (F.col("pages") >= TEMPLATE_PAGES) & (F.col("most.n") >= TEMPLATE_SHARE * F.col("pages"))
    menu = (F.col("size") > 0) & (F.col("link") >= MENU_SHARE * F.col("size"))
    marks = sums.select("host", F.struct(F.col("slots").alias("slot"), F.when(fixed, F.col("most.texts")).alias("digest"), menu.alias("menu")).alias("m")).where("m.menu OR m.digest IS NOT NULL")
    marks = marks.groupBy("host").agg(F.sort_array(F.collect_list("m")).alias("m"))
    entry = F.transform("m", lambda m: F.concat(F.lit("["), m["slot"].cast("string"), F.lit(","), F.coalesce(m["digest"].cast("string"), F.lit("null")), F.lit(","), m["menu"].cast("string"), F.lit("]")))
    wrapper = F.concat(F.lit("["), "_tree", F.lit(",["), F.coalesce(F.array_join(entry, ","), F.lit("")), F.lit("]]"))
    wrappers = stored(trees.join(marks, "host", "left").select("host", wrapper.alias("_wrapper")), "wrappers")
    discard(told, distinct, shapes)
    return wrappers


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, ``host`` and ``text`` for every row of ``pages``.

    A wrapper is learned for each host from all its pages; pages without a host are read by their
    elements alone, those of hosts with fewer than TEMPLATE_PAGES pages by elements and links. A null or
    empty page has the empty text. Repeated rows stay repeated; equal pages of a host are equal in its
    wrapper. Other columns are not read. An empty table gives an empty result.

    Wrappers are joined to the pages by host; their table is written first, so that the adaptive
    skew join can split a host that holds most pages.
    """
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*own, url_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    joined = rows.join(learn_wrappers(rows), "host", "left").select(
        *[f"_k{i}" for i in range(len(keep))], "host", F.when(F.col("host") != "", F.coalesce("_wrapper", F.lit("null"))).alias("_wrapper"), "_html"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_html"):
                texts = [page_text(Page(h), w) for h, w in zip(part.column("_html").to_pylist(), part.column("_wrapper").to_pylist(), strict=True)]
                names = [c for c in part.schema.names if c not in ("_wrapper", "_html")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    kinds = dict(joined.dtypes)
    schema = ", ".join(f"_k{i} {kinds[f'_k{i}']}" for i in range(len(keep))) + ", host string, text string"
    return joined.mapInArrow(read, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "host", "text")
