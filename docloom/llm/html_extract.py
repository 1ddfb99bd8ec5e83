"""Main text of web pages by wrapper induction.

1. Alignment: the DOM tree of a page is folded (items such as paragraphs, list
   entries and inline elements that stand between two containers and look alike
   are one node; containers stand for themselves) and aligned with a reference
   page of its group by simple tree matching: the heaviest top-down match that
   keeps the order of siblings.  Containers match by element, items by element,
   class and id words; equal words weigh more.  A group is a layout of a host (the places
   below the top of the page) with MIN_PAGES different pages or more; the other
   pages of a host are one group.  The reference is the group's largest tree.
2. Induction: over all different pages of a group it is counted how many pages
   match a node of the reference, which texts they bear there, and how much of
   that is prose (text outside links and controls).  A text that stands in at
   least CONSTANT_SHARE of the pages that match its node, MIN_PAGES or more, is
   template; all other nodes are slots.  From the top the content is where
   container after container holds CONTENT_SHARE of the prose that varies, while
   what stands beside it is small, without a varying heading, and no article.
3. Extraction: a page is aligned with its group's wrapper; the template's texts
   go, and the node matched with the content place is the page's content.  Names
   of elements and class words only break ties: they choose the content where
   the wrapper names no place (or a page does not match it), and take page
   furniture out of the content.

Text: character references decoded, white space inside a block turned into one
space, blocks joined in page order by one newline.

Defined results: a null or empty page has the text ""; a page without a URL or
host is extracted without a wrapper, as is the only different page of its group;
with fewer than MIN_PAGES different pages there is a content place but no template; markup that ends
in mid-tag is cut there; nesting may be of any depth and pages of any size; repeated rows give repeated
results and count as one page; an empty table gives an empty table; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_broadcast, cut, map_arrow, map_texts, slices

MIN_PAGES = 5
CONSTANT_SHARE = 0.8
#: Share of the varying prose of a place that its content holds; of one that bears a name of furniture.
CONTENT_SHARE, NAMED_SHARE = 0.75, 0.9
#: Nodes of one level beyond which equal containers of a parent are folded too, so that a match stays near linear.
WIDE = 64
#: Bytes of references or wrappers up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
#: Wrappers that a task keeps ready.
HELD_WRAPPERS = 2_000

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form script style noscript template head title button select option textarea iframe svg canvas object embed audio video map dialog menu datalist noembed noframes xmp".split())
# Elements that hold parts of a page, and those whose text is no prose.
CONTAINERS = frozenset("article aside body center details dialog dir div dl fieldset figure footer form head header hgroup html main menu nav ol section table tbody td tfoot thead ul".split())
SILENT = frozenset("a audio button canvas datalist embed head iframe map noembed noframes noscript object option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip status".split())
# Words in class and id that name page furniture.
WORDS = frozenset(
    "nav navbar navigation navi menu menus submenu sidebar sidebars side aside footer foot bottombar topbar masthead ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr privacy notice notices notification notifications alert alerts disclaimer popup modal overlay lightbox newsletter subscribe subscription signup login signin register share sharing shares social follow comment comments commentlist discussion disqus respond reply replies feedback related recommended recommendations breadcrumb breadcrumbs crumbs pagination pager paging widget widgets toolbar search searchbox skip copyright colophon outbrain taboola teaser teasers trending toc hidden".split()
)
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select", "datalist"}, "p": {"td", "th", "button", "table"}}
# An end tag doesn't reach out of the table or cell it stands in, but for those of tables and of the page.
CELLS = ("table", "td", "th")
ACROSS_CELLS = frozenset("table tr tbody thead tfoot body html".split())

_TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?][^>]*(?:>|\Z))|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?P<close>>|\Z)|/[^>]*>)", re.S)
_LOOSE = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)(?P<close>>|\Z)")
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "frame")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.frame = False  # holds an article or main part

    def words(self) -> set[str]:
        named = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"
        return {w.lower() for w in _NAMES.findall(named)} if len(named) > 1 else set()


def parse(source: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    last: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    pos, size = 0, len(source)

    def top(names: Iterable[str]) -> int:
        return max((last[n][-1] for n in names if last.get(n)), default=0)

    def close(until: int) -> None:
        for n in stack[until:]:
            last[n.tag].pop()
        del stack[until:]

    def text(until: int) -> None:
        if until > pos:
            stack[-1].children.append(html.unescape(source[pos:until]))

    while pos < size:
        start = source.find("<", pos)
        if start < 0:
            text(size)
            break
        m = _TOKEN.match(source, start) or _LOOSE.match(source, start)
        if m is None:  # a plain "<"
            if source.startswith("</", start) and start + 2 == size:
                text(start)
                break
            text(start + 1)
            pos = start + 1
            continue
        text(start)
        pos = m.end()
        name = m["name"].lower() if m["name"] else None
        if name is None or not m["close"]:
            continue
        if m["end"]:
            i = top((name,))
            if i and (name in ACROSS_CELLS or i >= top(CELLS)):
                close(i)
            continue
        for open_tag, closers in CLOSED_BY.items():
            if name in closers:
                i = top((open_tag,))
                if i and i > top(SCOPES.get(open_tag, ())):
                    close(i)
        attrs = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTR.findall(m["attrs"])} if m["attrs"].strip(" /") else {}
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in ("article", "main") and not node.words() & WORDS:
            for n in reversed(stack):
                if n.frame:
                    break
                n.frame = True
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, pos)
            if end.start() > pos:
                node.children.append(source[pos : end.start()])
            pos = end.end()
        else:
            last.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


def elements(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


# --- folded trees ---


class Tree:
    """A folded page as parallel lists, parents before children; node 0 is the root."""

    __slots__ = ("label", "words", "parent", "kids", "digest", "prose", "nodes", "_where")

    def __init__(self) -> None:
        self.label: list[str] = []
        self.words: list[str] = []
        self.parent: list[int] = []
        self.kids: list[list[int]] = []
        self.digest: list[int] = []  # of a node's own text, 0 for none
        self.prose: list[int] = []  # its characters, 0 within links and controls
        self.nodes: list[list[Node]] = []
        self._where: dict[int, dict[str, list[int]]] = {}

    def add(self, label: str, words: str, parent: int, digest: int = 0, prose: int = 0) -> int:
        at = len(self.label)
        self.label.append(label)
        self.words.append(words)
        self.parent.append(parent)
        self.kids.append([])
        self.digest.append(digest)
        self.prose.append(prose)
        if parent >= 0:
            self.kids[parent].append(at)
        return at

    def where(self, y: int) -> dict[str, list[int]]:
        """The places of each label among the children of y."""
        found = self._where.get(y)
        if found is None:
            found = self._where[y] = {}
            for j, k in enumerate(self.kids[y]):
                found.setdefault(self.label[k], []).append(j)
        return found

    def pack(self) -> bytes:
        return zlib.compress(json.dumps([self.label, self.words, self.parent, self.digest, self.prose], separators=(",", ":")).encode(), 1)

    @staticmethod
    def unpack(data: bytes) -> Tree:
        t = Tree()
        for row in zip(*json.loads(zlib.decompress(data)), strict=True):
            t.add(*row)
        return t


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _named(n: Node) -> str:
    return ".".join(sorted(n.words())) if n.attrs else ""


def fold(root: Node) -> Tree:
    """The folded tree of a page, level by level."""
    t = Tree()
    t.nodes.append([root])
    t.add("#root", "", -1)
    silent, level = [False], [0]
    while level:
        # The groups of siblings below each node of the level.
        found: list[tuple[int, dict[tuple[int, str], list[Node]]]] = []
        for wide in (False, True):
            found = [(x, _grouped(t.nodes[x], wide)) for x in level]
            if sum(len(groups) for _, groups in found) <= WIDE:
                break
        level = []
        for x, groups in found:
            for (_, label), nodes in groups.items():
                quiet = silent[x] or nodes[0].tag in SILENT
                text = " ".join(" ".join([c for n in nodes for c in n.children if isinstance(c, str)]).split())
                digest = _number(_hash(text.encode("utf-8", "replace"))) or 1 if text else 0
                level.append(t.add(label, _named(nodes[0]), x, digest, 0 if quiet else len(text)))
                t.nodes.append(nodes)
                silent.append(quiet)
    return t


def _grouped(nodes: list[Node], wide: bool) -> dict[tuple[int, str], list[Node]]:
    """The element children of nodes, those that are one folded node together; in order of their first."""
    merged = wide or len(nodes) > 1
    groups: dict[tuple[int, str], list[Node]] = {}
    part = 0
    for n in nodes:
        for c in n.children:
            if isinstance(c, str) or c.tag == "br":
                continue
            if c.tag in CONTAINERS:
                label, part = c.tag, part + 1
            else:
                label = f"{c.tag}.{_named(c)}" if c.attrs else c.tag
            groups.setdefault((0 if merged else part, label), []).append(c)
    return groups


def layout(t: Tree) -> int:
    """A hash of the places in the first two levels below the frames that hold the whole page."""
    paths: list[bytes] = []
    depth: list[int] = []
    levels: list[set[bytes]] = []
    first = None  # the first of the two levels
    for label, words, parent in zip(t.label, t.words, t.parent, strict=True):
        d, path = (0, b"") if parent < 0 else (depth[parent] + 1, paths[parent])
        if d == len(levels):
            if first is None and d and len(levels[-1]) > 1:
                first = d - 1
            if first is not None and d > first + 1:
                break
            levels.append(set())
        depth.append(d)
        paths.append(_hash(path, label.encode("utf-8", "replace"), words.encode("utf-8", "replace")))
        if label != "head":
            levels[d].add(paths[-1])
    return _number(_hash(b"layout", *sorted(set().union(*levels[len(levels) - 1 if first is None else first :]))))


# --- simple tree matching ---


def _chain(inner: list[tuple[int, int, int]], weight: list[int]) -> tuple[int, list[int]]:
    """The heaviest of the pairs (i, j, number) in which both i and j rise: its weight and its numbers."""
    if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(inner, inner[1:], strict=False)):
        return sum(weight[k] for _, _, k in inner), [k for _, _, k in inner]
    size = max(j for _, j, _ in inner) + 2
    best, back = [(0, -1)] * size, {}  # a Fenwick tree over j
    for _, j, k in sorted(inner, key=lambda p: (p[0], -p[1])):
        top, at = (0, -1), j
        while at:
            top = max(top, best[at], key=lambda b: b[0])
            at -= at & -at
        back[k] = top[1]
        mine, at = (top[0] + weight[k], k), j + 1
        while at < size:
            best[at] = max(best[at], mine, key=lambda b: b[0])
            at += at & -at
    top, at = (0, -1), size - 1
    while at:
        top = max(top, best[at], key=lambda b: b[0])
        at -= at & -at
    total, k, out = top[0], top[1], []
    while k >= 0:
        out.append(k)
        k = back[k]
    return total, out


def align(a: Tree, b: Tree) -> list[int]:
    """For each node of a its partner in b, or -1: the heaviest match that keeps parents and the order of siblings."""
    pairs: list[tuple[int, int]] = [(0, 0)]
    below: list[list[tuple[int, int, int]]] = []
    for x, y in pairs:  # grows while it is read
        inner: list[tuple[int, int, int]] = []
        if a.kids[x] and b.kids[y]:
            where, ys = b.where(y), b.kids[y]
            for i, u in enumerate(a.kids[x]):
                for j in where.get(a.label[u], ()):
                    inner.append((i, j, len(pairs)))
                    pairs.append((u, ys[j]))
        below.append(inner)
    weight: list[int] = [0] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k]
        weight[k] = 2 + (a.words[x] == b.words[y])
        if below[k]:
            more, picked = _chain(below[k], weight)
            weight[k] += more
            below[k] = picked  # numbers of pairs from here on
    out, todo = [-1] * len(a.label), [0]
    while todo:
        k = todo.pop()
        x, y = pairs[k]
        out[x] = y
        todo.extend(below[k])
    return out


class Wrapper:
    """A reference tree, the template's texts at its nodes, and the place of the content (or none)."""

    __slots__ = ("tree", "template", "content")

    def __init__(self, tree: Tree, template: Iterable[tuple[int, int]], content: int | None):
        self.tree, self.template, self.content = tree, frozenset(map(tuple, template)), content

    @staticmethod
    def induce(tree: Tree, pages: int, nodes: Iterable[dict]) -> Wrapper:
        """nodes: the pages that match a node and their prose, and its template text with that text's prose, if it has one."""
        size = len(tree.label)
        support, prose, template = [0] * size, [0] * size, []
        for x in nodes:
            support[x["node"]], prose[x["node"]] = x["n"], x["prose"]
            if x["text"] is not None:
                template.append((x["node"], x["text"]))
                prose[x["node"]] -= x["constant"]
        return Wrapper(tree, template, _content(tree, pages, support, prose))

    def pack(self) -> bytes:
        t = self.tree
        return zlib.compress(json.dumps([t.label, t.words, t.parent, sorted(self.template), self.content], separators=(",", ":")).encode(), 1)

    @staticmethod
    def unpack(data: bytes) -> Wrapper:
        *rows, template, content = json.loads(zlib.decompress(data))
        t = Tree()
        for row in zip(*rows, strict=True):
            t.add(*row)
        return Wrapper(t, template, content)


def _content(t: Tree, pages: int, support: list[int], prose: list[int]) -> int | None:
    """The node under which the prose that varies stands, if there is one below the body."""
    tag = [x.partition(".")[0] for x in t.label]
    whole, heading, semantic = list(prose), [False] * len(prose), [False] * len(prose)
    for x in range(len(whole) - 1, 0, -1):
        heading[x] |= tag[x] in HEADINGS and whole[x] > 0
        semantic[x] |= tag[x] in ("article", "main")
        p = t.parent[x]
        whole[p] += whole[x]
        heading[p] |= heading[x]
        semantic[p] |= semantic[x]
    c = 0
    while tag[c] not in ("article", "main"):
        kids = [k for k in t.kids[c] if whole[k] > 0]
        if not kids:
            break
        big = max(kids, key=whole.__getitem__)
        named = tag[big] in FURNITURE or bool(WORDS.intersection(t.words[big].split(".")))
        rest = [k for k in kids if k != big]
        if tag[big] not in CONTAINERS or support[big] < CONSTANT_SHARE * pages or whole[big] < (NAMED_SHARE if named else CONTENT_SHARE) * whole[c]:
            break
        if any(tag[k] not in CONTAINERS or heading[k] or semantic[k] and not semantic[big] for k in rest):
            break
        c = big
    return None if tag[c] in ("#root", "html", "body") else c


# --- slots to text ---


def _furniture(n: Node, inside: bool) -> bool:
    if n.tag in FURNITURE:
        return not (inside and n.tag == "header")
    if n.attrs:
        a = n.attrs
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        named = n.words()
        if named & WORDS or "header" in named and not inside:
            # A frame around the article may bear such a word; the article itself may not be a comment.
            return n.tag not in ("html", "body", "main") and (n.tag != "article" or bool(named & {"comment", "comments", "related", "teaser", "ad", "ads", "promo", "sponsored"})) and not n.frame
    return False


def _parts(root: Node) -> list[Node]:
    """The main part, or the articles, or the body: what text is taken from."""
    mains: list[Node] = []
    articles: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "main" or n.attrs.get("role") == "main":
            mains.append(n)
            continue
        if n.tag == "article":
            if not _furniture(n, False):
                articles.append(n)
            continue
        if n is root or not _furniture(n, False):
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    if mains:
        inner = [p for m in mains for p in _articles(m)]
        return inner or mains
    if articles:
        return articles
    named = [n for n in elements(root) if n.tag in ("div", "section", "td") and n.words() & {"content", "article", "post", "entry", "story"} and not _furniture(n, False)]
    # Of named frames the outermost that is not a frame of another one.
    return [named[0]] if named and sum(map(_size, named[:1])) * 2 > _size(root) else [root]


def _articles(main: Node) -> list[Node]:
    out, todo = [], [main]
    while todo:
        n = todo.pop()
        if n.tag == "article" and not _furniture(n, True):
            out.append(n)
        elif n is main or not _furniture(n, True):
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def _size(node: Node) -> int:
    return sum(len(c) for n in elements(node) if not (n.tag in FURNITURE) for c in n.children if isinstance(c, str))


def _within(place: Node) -> list[Node]:
    """What of a content place is taken: its articles if they hold most of it, else all of it."""
    inner = [] if place.tag == "article" else _articles(place)
    return inner if 2 * sum(map(_size, inner)) > _size(place) else [place]


def blocks(root: Node, parts: list[Node] | None = None) -> Iterator[str]:
    """The blocks of the parts, or of those that names choose."""
    held: list[str] = []

    def flush() -> str:
        out = " ".join("".join(held).split())
        held.clear()
        return out

    for part in _parts(root) if parts is None else parts:
        inside = part.tag != "#root"
        todo: list = [(part, True)]
        while todo:
            item, opening = todo.pop()
            if isinstance(item, str):
                held.append(item)
            elif not opening:
                if out := flush():
                    yield out
            elif item is not part and _furniture(item, inside):
                continue
            elif item.tag == "br":
                held.append(" ")
            else:
                if item.tag in BLOCKS or item is part:
                    if out := flush():
                        yield out
                    todo.append((item, False))
                todo.extend((c, True) for c in reversed(item.children))
    if out := flush():
        yield out


def extract(source: str | None, wrapper: Callable[[Tree], Wrapper | None] | None = None) -> str:
    """The text of a page; wrapper gives that of its group."""
    if not source:
        return ""
    root = parse(source)
    parts = None
    if wrapper is not None:
        t = fold(root)
        if (w := wrapper(t)) is not None:
            found: list[Node] = []
            for x, y in enumerate(align(t, w.tree)):
                if y >= 0 and y == w.content:
                    found = t.nodes[x]
                if y >= 0 and (y, t.digest[x]) in w.template:
                    for n in t.nodes[x]:
                        n.children = [c for c in n.children if isinstance(c, Node)]
            if any(map(_size, found)):
                parts = [p for n in found for p in _within(n)]
    return "\n".join(blocks(root, parts))


# --- induction over a table ---


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, h, layout, size, tree) of each page, the same page once a slice."""
    for part in slices(batches, "html"):
        rows = {}
        for host, h, source in zip(*(part.column(c).to_pylist() for c in ("host", "h", "html")), strict=True):
            if (host, h) not in rows:
                t = fold(parse(source))
                rows[host, h] = (host, h, layout(t), len(t.label), t.pack())
        cols = zip(*rows.values(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["host", "h", "layout", "size", "tree"])


def _matched(references: Callable[[pa.RecordBatch], list[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (group, node, text, n, prose): pages that match a node of their reference (text null), and that bear a text there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int | None], list[int]] = {}
        known: dict[int, Tree] = {}

        def made() -> pa.RecordBatch:
            cols = zip(*((*k, *v) for k, v in counts.items()), strict=True) if counts else ((),) * 5
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["group", "node", "text", "n", "prose"])
            counts.clear()
            known.clear()
            return out

        def add(key: tuple[int, int, int | None], n: int, prose: int) -> None:
            held = counts.setdefault(key, [0, 0])
            held[0] += n
            held[1] += prose

        for batch in batches:
            for group, tree, reference in zip(batch.column("group").to_pylist(), batch.column("tree").to_pylist(), references(batch), strict=True):
                if group not in known:
                    known[group] = Tree.unpack(reference)
                t = Tree.unpack(tree)
                owner = align(t, known[group])
                for x, y in enumerate(owner):
                    if y < 0:  # prose without a place counts where its parent stands
                        owner[x] = owner[t.parent[x]]
                        if t.prose[x]:
                            add((group, owner[x], None), 0, t.prose[x])
                    else:
                        add((group, y, None), 1, t.prose[x])
                        if t.digest[x]:
                            add((group, y, t.digest[x]), 1, t.prose[x])
                if len(counts) >= HELD_COUNTS:
                    yield made()
        yield made()

    return run


def _small(df: DataFrame, column: str, most: int) -> bool:
    """Whether a binary column may be held on the driver and by every executor."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 200), F.lit(0))).first()[0] <= most


def _induced(pages: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(host, layout) that are groups of their own, and (host, layout, wrapper) of each group; layout 0 is the rest of a host."""
    rows = pages.where((F.col("host") != "") & (F.col("html") != "")).select("host", F.xxhash64(F.lit("page"), "html").alias("h"), "html")
    trees = cut(map_arrow(rows, _folded, "host string, h long, layout long, size int, tree binary").dropDuplicates(["host", "h"]))
    own = cut(trees.groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "layout", F.lit(True).alias("own")))
    marked = trees.join(bounded_broadcast(own, own.count()), ["host", "layout"], "left").withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.lit(0)))
    marked = marked.select("host", "layout", F.xxhash64("host", "layout").alias("group"), "h", "size", "tree")
    groups = cut(marked.groupBy("group", "host", "layout").agg(F.count("*").alias("pages"), F.max_by("tree", F.struct("size", "h")).alias("reference")).where("pages > 1"))
    if _small(groups, "reference", broadcast_bytes):
        shared = pages.sparkSession.sparkContext.broadcast({r["group"]: bytes(r["reference"]) for r in groups.select("group", "reference").collect()})
        live = marked.join(F.broadcast(groups.select("group")), "group", "left_semi").select("group", "tree")
        run = _matched(lambda batch: [shared.value[g] for g in batch.column("group").to_pylist()])
    else:
        live = marked.select("group", "tree").join(groups.select("group", "reference"), "group")
        run = _matched(lambda batch: batch.column("reference").to_pylist())
    counts = map_arrow(live, run, "group long, node int, text long, n long, prose long").groupBy("group", "node", "text").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"))
    # Texts too rare to be template anywhere are not kept.
    counts = cut(counts.where(F.col("text").isNull() | (F.col("n") >= CONSTANT_SHARE * MIN_PAGES)))
    total = counts.where("text is null").select("group", "node", F.col("n").alias("pages"), F.col("prose").alias("chars"))
    found = total.join(counts.where("text is not null"), ["group", "node"], "left")
    constant = (F.col("pages") >= MIN_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    # A node has one such text at most, so an array holds no more than the reference has nodes.
    one = found.groupBy("group", "node").agg(F.first("pages").alias("n"), F.first("chars").alias("prose"), F.max(F.when(constant, F.struct("text", F.col("prose").alias("prose")))).alias("constant"))
    stats = one.groupBy("group").agg(F.collect_list(F.struct("node", "n", "prose", F.col("constant.text").alias("text"), F.col("constant.prose").alias("constant"))).alias("nodes"))
    made = map_arrow(groups.join(stats, "group").select("host", "layout", "pages", "reference", "nodes"), _wrapped, "host string, layout long, wrapper binary")
    return own.select("host", "layout"), cut(made)


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Wrapper.induce(Tree.unpack(r), n, x).pack() for r, n, x in zip(*(batch.column(c).to_pylist() for c in ("reference", "pages", "nodes")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(found, pa.binary())], names=["host", "layout", "wrapper"])


def main_text(df: DataFrame, url: str = "url", page: str = "html", keys: tuple[str, ...] = ("page_id", "url"), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The key columns and the text of each row."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select(F.struct(*keys).alias("key"), host.alias("host"), F.col(page).alias("html"))
    own, wrappers = _induced(pages.select("host", "html"), broadcast_bytes)
    schema = pages.select("key", F.lit("").alias("text")).schema

    def extracted(part: pa.RecordBatch, wrappers: Iterable[Callable[[Tree], Wrapper | None] | None]) -> pa.RecordBatch:
        texts = [extract(source, w) for source, w in zip(part.column("html").to_pylist(), wrappers, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    if _small(wrappers, "wrapper", broadcast_bytes):
        packed: dict[str, dict[int, bytes]] = {}
        for r in wrappers.collect():
            packed.setdefault(r["host"], {})[r["layout"]] = bytes(r["wrapper"])
        shared = df.sparkSession.sparkContext.broadcast(packed)
        ready: dict[tuple[str, int], Wrapper] = {}

        def of(host: str, layouts: dict[int, bytes], t: Tree) -> Wrapper | None:
            at = layout(t)
            at = at if at in layouts else 0
            if (host, at) not in ready and at in layouts:
                if len(ready) >= HELD_WRAPPERS:
                    ready.clear()
                ready[host, at] = Wrapper.unpack(layouts[at])
            return ready.get((host, at))

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            known = ((h, shared.value.get(h)) for h in part.column("host").to_pylist())
            yield extracted(part, (partial(of, h, x) if x else None for h, x in known))

        return map_texts(pages, schema, work, "html").select("key.*", "text")

    def placed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [layout(fold(parse(x))) if x else 0 for x in part.column("html").to_pylist()]
        yield part.append_column("layout", pa.array(found, pa.int64()))

    def apart(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield extracted(part, (w and (lambda _, w=w: Wrapper.unpack(w)) for w in part.column("wrapper").to_pylist()))

    laid = map_texts(pages, pages.withColumn("layout", F.lit(0).cast("long")).schema, placed, "html")
    laid = laid.join(own.withColumn("own", F.lit(True)), ["host", "layout"], "left").withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.lit(0)))
    return map_texts(laid.join(wrappers, ["host", "layout"], "left").select("key", "html", "wrapper"), schema, apart, "html").select("key.*", "text")


def digests(df: DataFrame) -> DataFrame:
    return main_text(df).withColumn("n_chars", F.length("text").cast("long"))
