"""Main text of web pages by wrappers learned from the pages of a host.

The trees of a host's pages are aligned by simple tree matching and folded into one wrapper. A node of it
that stands in nearly all pages with the same text is template, one with varying text is a slot. Slots are held
against each other by the text that all pages have in them: from the root, as long as one slot holds most of
what isn't links, it is followed, down to the one whose paragraphs are the article (``region``). Headings that
vary on the way belong to it; other slots beside it (menus, adverts, footers) don't, whatever they are named.
Below it, slots that are mostly links and template lines go. Elements that say that they are the article
stand for the region. Names in a class, id or role only tell asides below the region, and only names without
another word: ``comments`` or ``ad-box``, not ``notice-period``.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, pick
from sentrylake.session import materialize

BLOCKS = frozenset(
    "html body main article section div header footer nav aside form fieldset menu dialog details summary figure figcaption address blockquote "
    "center p h1 h2 h3 h4 h5 h6 hgroup pre ul ol li dl dt dd table caption thead tbody tfoot tr td th".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: what stands in them is passed over up to their end tag.
RAW = frozenset("script style template textarea title noscript iframe object svg math select button audio video canvas".split())
#: Elements that are never the article, and words in a class, id or role that say so.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended share sharing social comment comments "
    "reply replies respond disqus footer pagination pager toolbar search masthead complementary contentinfo".split()
)
#: Words that change nothing in such a name.
NEUTRAL = frozenset("site page list box area wrapper wrap container section block bar top bottom left right inner outer item group panel header title text link links button buttons".split())
#: Elements of which a class says nothing, and those that are lines of a text, not regions of a page.
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6 p figure figcaption blockquote pre td th tr tbody thead table".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre li dt dd ul ol dl tr td th table caption thead tbody tfoot blockquote figure figcaption address".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: A slot is followed if it has this share of the text, and lines beside it at most that; above this share of links it is a menu.
MOST, BESIDE, MENU = 0.6, 0.05, 0.5
#: Blocks nested deeper are lines of the block that holds them; a longer table of two lists of children is cut by anchors.
DEEPEST, TABLE = 120, 1 << 14
#: A wrapper of more nodes than this forgets those that one page has.
LARGEST = 20_000
ENDS_P = BLOCKS - {"html", "body"}
#: Neighbours of one label are one node of a wrapper if they are of these elements, or at least so many.
REPEATED, MANY = frozenset("p li dt dd tr td th blockquote pre h1 h2 h3 h4 h5 h6".split()), 4
#: Fewer pages teach nothing; a node is in nearly all pages from this share on; rarer nodes than this are forgotten.
FEWEST, NEARLY_ALL, RARE = 8, 0.9, 0.02

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def says_aside(name: str) -> bool:
    """Whether one class, id or role names something beside the article, and nothing else."""
    words = [w.lower() for w in _WORD.findall(name)]
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in NEUTRAL for w in words if not w.isdigit())


class Block:
    """A block element: its label (tag and class), children, own text in pieces around the children, characters of it in links."""

    __slots__ = ("tag", "label", "aside", "main", "items", "linked")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.aside, self.main, self.items, self.linked = tag, tag, tag in ASIDE, tag in ("article", "main"), [], 0
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            named = [x for k in ("class", "id", "role") for x in found.get(k, "").split()]
            if named:
                self.label = f"{tag}.{found.get('class', '').strip()}"
                self.aside |= tag not in UNNAMED and any(map(says_aside, named))
            self.aside |= "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
            self.main |= found.get("role") == "main" or found.get("itemprop") == "articleBody"

    def blocks(self):
        return [x for x in self.items if isinstance(x, Block)]


def parse(page: str) -> Block:
    """The tree of block elements of a page; inline elements leave only their text, open ends are closed."""
    root, at = Block("#page"), 0
    stack, deep, link = [root], [], False  # deep: open blocks that are lines of the deepest one

    def add(text: str) -> None:
        stack[-1].items.append(text)
        if link:
            stack[-1].linked += len("".join(text.split()))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = not m[1] and "href" in m[3].lower()
        if m[1]:
            if tag in deep:
                while deep.pop() != tag:
                    pass
                stack[-1].items.append("\n")
            elif tag in BLOCKS and any(b.tag == tag for b in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW:
            if not m[4]:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br" or tag == "hr":
            stack[-1].items.append("\n")
        elif tag == "head":
            continue
        elif tag in BLOCKS and len(stack) >= DEEPEST:
            stack[-1].items.append("\n")
            if not m[4]:
                deep.append(tag)
        elif tag in BLOCKS:
            if tag in ENDS_P and stack[-1].tag == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag == tag:
                stack.pop()
            block = Block(tag, m[3])
            stack[-1].items.append(block)
            if not m[4]:
                stack.append(block)
    if at < len(page):
        add(page[at:])
    return root


def own_text(block: Block) -> str:
    return " ".join(html.unescape("".join(x if isinstance(x, str) else "\0" for x in block.items)).replace("\0", " ").split())


# ---- wrappers: [label, pages, text mark (0: varies), children, characters of own text, of them in links]


def runs(block: Block) -> list[list[Block]]:
    """Child blocks; neighbours that a wrapper has as one node stand together."""
    found: list[list[Block]] = []
    for child in block.blocks():
        if found and found[-1][0].label == child.label:
            found[-1].append(child)
        else:
            found.append([child])
    return [part for run in found for part in ([run] if run[0].tag in REPEATED or len(run) >= MANY else [[x] for x in run])]


def fold(block: Block) -> list:
    """A page as a wrapper of its own; a node for several blocks counts as one, whose text varies."""
    children: list = []
    for run in runs(block):
        node = fold(run[0])
        for more in run[1:]:
            node = merged(node, fold(more))
        children.append([node[0], 1, node[2] if len(run) == 1 else 0, *node[3:]])
    text = own_text(block)
    size = len(text) - text.count(" ")
    return [block.label, 1, zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1, children, size, min(size, block.linked)]


def _weights(a: list, b: list) -> list[list[int]]:
    """Simple tree matching of two lists of children: how many nodes match, at most, of the first so many of both."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            both = table[i - 1][j - 1] + matching(x, y) if x[0] == y[0] else 0
            table[i][j] = max(table[i - 1][j], table[i][j - 1], both)
    return table


def _pieces(a: list, b: list) -> list[tuple[list, list]]:
    """Both lists cut alike into pieces of which tables are small, at labels that both have once, in the same order."""
    if len(a) * len(b) <= TABLE:
        return [(a, b)]
    once = [{x: n for x, n in Counter(y[0] for y in c).items() if n == 1} for c in (a, b)]
    place = {y[0]: j for j, y in enumerate(b) if y[0] in once[1]}
    ends, chains = [], []  # longest rising run of places: for each length its lowest end, and a chain that ends there
    for i, x in enumerate(a):
        if x[0] in once[0] and x[0] in place:
            j = place[x[0]]
            k = bisect_left(ends, j)
            chains[k : k + 1] = [(i, j, chains[k - 1] if k else None)]
            ends[k : k + 1] = [j]
    anchors, chain = [], chains[-1] if chains else None
    while chain:
        anchors.append(chain[:2])
        chain = chain[2]
    out, p, q = [], 0, 0
    for i, j in [*anchors[::-1], (len(a), len(b))]:
        if (i - p) * (j - q) <= TABLE:
            out.append((a[p:i], b[q:j]))
        else:  # without anchors: the first of a label with the first of that label, as far as order allows
            later = defaultdict(deque)
            for y in range(q, j):
                later[b[y][0]].append(y)
            for x in range(p, i):
                own = later[a[x][0]]
                while own and own[0] < q:
                    own.popleft()
                if own:
                    out.append(([], b[q : own[0]]))
                    out.append((a[x : x + 1], b[own[0] : own[0] + 1]))
                    q = own[0] + 1
                else:
                    out.append((a[x : x + 1], []))
            out.append(([], b[q:j]))
        if i < len(a):
            out.append((a[i : i + 1], b[j : j + 1]))
        p, q = i + 1, j + 1
    return out


def matching(a: list, b: list) -> int:
    """Size of the largest match of two trees that keeps order and descent; 0 if their roots differ."""
    return 1 + sum(_weights(x, y)[-1][-1] for x, y in _pieces(a[3], b[3])) if a[0] == b[0] else 0


def aligned(a: list, b: list) -> list[tuple[list | None, list | None]]:
    """Children of two trees side by side, each matched, or alone."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return list(zip(a, b, strict=True))
    return [pair for x, y in _pieces(a, b) for pair in _traced(x, y)]


def _traced(a: list, b: list) -> list[tuple[list | None, list | None]]:
    if not a or not b:
        return [(x, None) for x in a] + [(None, y) for y in b]
    table, i, j, out = _weights(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1][0] == b[j - 1][0] and table[i][j] == table[i - 1][j - 1] + matching(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or table[i][j] == table[i - 1][j]):
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def merged(a: list, b: list) -> list:
    """One wrapper for the pages of both."""
    children = [merged(x, y) if x and y else x or y for x, y in aligned(a[3], b[3])]
    return [a[0], a[1] + b[1], a[2] if a[2] == b[2] else 0, children, a[4] + b[4], a[5] + b[5]]


def size(wrapper: list) -> int:
    return 1 + sum(map(size, wrapper[3]))


def trimmed(wrapper: list, least: float) -> list:
    """Without nodes that too few pages have to be template or region: this bounds a wrapper's size."""
    wrapper[3] = [trimmed(x, least) for x in wrapper[3] if x[1] >= least]
    return wrapper


def bounded(wrapper: list) -> list:
    if wrapper[1] % 256 == 0:
        trimmed(wrapper, RARE * wrapper[1])
    if wrapper[1] > 1 and size(wrapper) > LARGEST:
        trimmed(wrapper, 2)
    return wrapper


# ---- extraction


def _plain(node: list) -> int:
    """Characters below a node that aren't links, without those of elements that are never the article."""
    return 0 if node[0].split(".")[0] in ASIDE else node[4] - node[5] + sum(map(_plain, node[3]))


def _all(node: list, at: int) -> int:
    return node[at] + sum(_all(x, at) for x in node[3])


def region(wrapper: list) -> tuple[list, list[int]]:
    """The node whose lines are the article, and the ids of headings on the way to it that vary, or that one page has."""
    node, headings = wrapper, []
    while True:
        total = _plain(node)
        places = [x for x in node[3] if x[0].split(".")[0] not in LINES]
        best = max(places, key=_plain, default=None)
        heads = [x for x in node[3] if x[0].split(".")[0] in HEADINGS]
        lines = sum(_plain(x) for x in node[3] if x not in places and x not in heads) + node[4] - node[5]
        if best is None or not total or _plain(best) < MOST * total or lines > BESIDE * total:
            return node, headings
        headings += [id(x) for x in heads if wrapper[1] == 1 or not _constant(x, wrapper[1])]
        node = best


def _constant(node: list, pages: int) -> bool:
    return pages >= FEWEST and node[1] >= NEARLY_ALL * pages and node[2] != 0


def main_text(page: str | None, wrapper: list | None) -> str:
    """The article of a page, white space as single blanks; empty for a null page or one without text.

    Of a host with few pages, or where a page lacks the region of its host, the region is the page's own.
    """
    root = parse(page or "")

    def articles(block: Block) -> bool:
        return any((x.main and x.tag not in ("body", "html") and not x.aside) or (x.tag not in ASIDE and articles(x)) for x in block.blocks())

    named = articles(root)
    if wrapper and wrapper[1] >= FEWEST:
        found = _extracted(root, wrapper, named)
        if found or named:
            return found
    return _extracted(root, fold(root), named)


def _extracted(root: Block, wrapper: list, named: bool) -> str:
    pages, out = wrapper[1], []
    center, headings = (None, []) if named else region(wrapper)

    def walk(block: Block, node: list | None, inside: bool, slots: bool) -> None:
        if block.tag in ASIDE or (block.aside and inside):
            return
        heading = node is not None and id(node) in headings
        if inside and not named and node is not None and block.tag not in LINES:
            whole = _all(node, 4)
            if whole and _all(node, 5) > MENU * whole:
                return
        inside = inside or heading or (block.main and named and not block.aside and block.tag not in ("body", "html")) or (center is not None and node is center)
        slots = slots or (inside and node is not None and (pages == 1 or _varies(node)))
        constant = node is not None and _constant(node, pages)
        keep = inside and not (constant and (slots or not named))
        below = dict(_matched(block, node))
        pieces: list[str] = []
        for x in block.items:
            if isinstance(x, str):
                if keep:
                    pieces.append(x)
                continue
            if pieces:
                out.append("".join(pieces))
                pieces = []
            walk(x, below.get(id(x)), inside, slots)
        if pieces:
            out.append("".join(pieces))

    walk(root, wrapper, False, False)
    return " ".join(" ".join(html.unescape(x) for x in out).split())


def _varies(node: list) -> bool:
    return node[2] == 0 or any(map(_varies, node[3]))


def _matched(block: Block, node: list | None) -> list[tuple[int, list | None]]:
    """Each child block with the wrapper's node for it."""
    if node is None or not node[3]:
        return []
    own = runs(block)
    if [r[0].label for r in own] == [x[0] for x in node[3]]:
        found = node[3]
    else:
        shapes = [fold(r[0]) for r in own]
        of = {id(shape): x for x, shape in aligned(node[3], shapes) if x and shape}
        found = [of.get(id(shape)) for shape in shapes]
    return [(id(x), n) for run, n in zip(own, found, strict=True) for x in run]


def host_of(url):
    """Host of an absolute URL in lower case; empty for others and null."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: of all pages ``host, html``; tasks fold their own pages first, so a host of very many pages is no hot group."""

    def run(batches):
        own: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = fold(parse(page.as_py() or ""))
                own[host] = bounded(merged(own[host], tree) if host in own else tree)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([json.dumps(x) for x in own.values()], pa.string())], ["host", "wrapper"])

    def whole(pdf):
        total = None
        for x in sorted(pdf["wrapper"]):
            total = bounded(merged(total, json.loads(x)) if total else json.loads(x))
        return pdf.iloc[:1][["host"]].assign(wrapper=[json.dumps(trimmed(total, RARE * total[1]))])

    parts = pages.select("host", "html").mapInArrow(frugal(run), "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(whole, "host string, wrapper string")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page, from the wrapper of its host's pages.

    A null page has an empty text; every row is a page, also repeated ones and those with a null id. Pages
    without a host (null or relative URLs) are treated as those of one host without a name.
    """
    rows = pick(pages, page_id=page_id, url=url, html=page).withColumn("host", host_of("url"))
    learned = materialize(wrappers(rows), "wrappers")  # of known size: sent to all tasks below the planner's limit, else joined
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        known: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for page, wrapper in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if wrapper is not None and wrapper not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[wrapper] = json.loads(wrapper)
                    texts.append(main_text(page, known.get(wrapper)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(learned, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(frugal(run), f"page_id {kind}, url string, text string")
