"""Main text of web pages by wrapper induction: trees of a host's pages are aligned, what stays the same is template, and
the template's varying slots are content where most of the host's varying text is."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, written
from .urls import host_of

#: Pages of a host that its template needs; pages of smaller hosts are judged by a template of their own.
LEAST_PAGES = 8
#: Share of the pages that a constant text is on. Within an element that holds the article and little else it is higher, as
#: passages may be shared by many articles.
CONSTANT, CONSTANT_INSIDE = 0.8, 0.95
#: Share of the content's text that constants may make up; a host of near copies isn't a template.
MOST_CONSTANT = 0.6
#: Share of an element's varying text that one below it has to hold to be the place of the content, and the share that is
#: enough for an article or main element.
BULK, BULK_MAIN = 0.8, 0.5
#: Share of varying text from which on an element counts as content whatever its names say, where nothing else is named so.
MOSTLY = 0.5
#: A template node is given up while fewer than a page in so many has it, and counts texts at a precision of this part of
#: its pages. Neither can concern a constant.
RARE = 64
#: Elements nested deeper become children of the deepest one, as in browsers, which do so at 512.
MOST_DEPTH = 150
#: Equal siblings beyond which they are a list, and one node of a template.
LIST = 16
#: Parts that the pages of a host are spread over before their templates meet.
PARTS = 64

#: Characters of all templates together up to which they go to every task; beyond, they are joined by shuffle.
MOST_SENT = 64_000_000
#: Pages of a task whose copies are told.
MOST_SEEN = 200_000

#: Elements without content, elements whose end tag may be missing, and what ends each of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {
    "p": BLOCKS - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: Elements whose text is never shown or never prose, and words that name boilerplate in class, id or role.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noframes".split())
CHROME = frozenset("nav footer aside form button select dialog menu head header label fieldset legend option input search".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumbs?|"
    r"side-?bar\w*|widgets?|related|recommend\w*|footer\w*|masthead|copyright|legal|site-?header|page-?header|top-?bar|social|share\w*|sharing|comments?|comment-?list|disqus|respond|replies|pagination|pager|toolbar|tags?|search\w*|skip\w*|navigation|contentinfo|complementary|banner-?\w*)(?:$|[\s_-])",
    re.I,
)
#: Elements that hold the article where a page has one, and elements of running text, which are no place of it.
MAIN = frozenset({"article", "main"})
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption summary option legend".split())
REPEATED = TEXTUAL | {"tr", "td", "th"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The attributes of a well-formed tag; others are read one by one.
_ATTRIBUTES = re.compile(r"((?:\s++[^\s=>\"'/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+)*+)\s*+(/?+)>")
_ANY_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    """An element: its tag, the words of its class, id and role, and children, which are nodes and texts in order."""

    __slots__ = ("tag", "names", "children", "content", "constant")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children, self.content, self.constant = tag, names, [], False, False


def _tag_end(source: str, at: int) -> tuple[int, str, bool]:
    """(end of the tag whose attributes start at `at`, its attributes, whether it closes itself); a quote counts in values
    only. Each character is looked at a few times, whatever is missing; a tag that never ends runs to the end."""
    m = _ATTRIBUTES.match(source, at)
    if m:
        return m.end(), m[1], bool(m[2])
    start = at
    while True:
        m = _ANY_ATTRIBUTE.match(source, at)
        if m is None:
            return len(source), source[start:], False
        at = m.end()
        if m[1]:
            return at, source[start : at - 1], source[at - 2 : at - 1] == "/"


def parse(source: str) -> Node:
    """The tree of a page, however broken: end tags without a start are left out, open elements end with their parent,
    and the elements of CLOSED_BY end where HTML lets them. Scripts and the like keep no text. Elements below
    MOST_DEPTH have no depth of their own; no text is lost by that."""
    root = Node("#root")
    stack, deeper = [root], []
    at = 0
    while at < len(source):
        begin = source.find("<", at)
        if begin < 0:
            break
        after = source[begin + 1 : begin + 2]
        if after == "/":
            name = _NAME.match(source, begin + 2)
        elif after == "!" or after == "?":
            name = None
        else:
            name = _NAME.match(source, begin + 1)
            if name is None:  # a sign, not a tag
                stack[-1].children.append(source[at : begin + 1])
                at = begin + 1
                continue
        if begin > at:
            stack[-1].children.append(source[at:begin])
        if name is None:
            ends = "-->" if source.startswith("<!--", begin) else ">"
            found = source.find(ends, begin + (4 if ends == "-->" else 1))
            at = found + len(ends) if found >= 0 else len(source)
            continue
        tag = name[0].lower()
        if after == "/":
            found = source.find(">", name.end())
            at = found + 1 if found >= 0 else len(source)
            if tag in deeper:
                while deeper.pop() != tag:
                    pass
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    deeper.clear()
                    break
            continue
        at, attributes, closed = _tag_end(source, name.end())
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
            deeper.clear()
        if tag in BLOCKS:  # a block ends an open paragraph even from within its inline elements
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in BLOCKS:
                    if stack[k].tag == "p" and tag in CLOSED_BY["p"]:
                        del stack[k:]
                    break
        node = Node(tag, " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not closed:
            if len(stack) < MOST_DEPTH:
                stack.append(node)
            elif len(deeper) < MOST_DEPTH:
                deeper.append(tag)
    if at < len(source):
        stack[-1].children.append(source[at:])
    return root


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def mark_of(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Block:
    """A block element of a page: the text outside its block children, how much of that is in links, and its children."""

    __slots__ = ("node", "label", "text", "linked", "children")

    def __init__(self, node: Node):
        # Names may carry a page's number, so digits don't count.
        self.node, self.label, self.children = node, f"{node.tag}.{re.sub(r'[0-9]+', '', node.names)}", []
        parts: list[str] = []
        linked: list[str] = []

        def gather(n: Node, link: bool) -> None:
            for c in n.children:
                if isinstance(c, str):
                    parts.append(c)
                    if link:
                        linked.append(c)
                elif c.tag in RAW or c.tag == "br":
                    parts.append(" ")
                elif c.tag in BLOCKS:
                    parts.append(" ")
                    self.children.append(Block(c))
                else:
                    gather(c, link or c.tag == "a")

        gather(node, False)
        self.text = squeezed("".join(parts))
        self.linked = min(len(self.text), len(squeezed("".join(linked))))


def runs(blocks: list[Block]) -> list[list[Block]]:
    """Children as nodes of a template: siblings of one label that follow one another are one, if they are running text,
    rows or cells, or more than LIST; the others stand alone."""
    out: list[list[Block]] = []
    for b in blocks:
        if out and out[-1][0].label == b.label:
            out[-1].append(b)
        else:
            out.append([b])
    return [part for run in out for part in ([run] if len(run) > LIST or run[0].node.tag in REPEATED else [[b] for b in run])]


class Template:
    """A node of a host's template: a run of siblings with one label. It knows how many pages have it, blocks in all,
    the characters of their texts and those in links, on how many pages each of its common texts is (at most `lost` more,
    with the text's length), and its children, the aligned children of all those blocks."""

    __slots__ = ("label", "pages", "blocks", "chars", "linked", "texts", "lost", "children", "content", "constants")

    def __init__(self, label, pages=0, blocks=0, chars=0, linked=0, texts=None, lost=0, children=None):
        self.label, self.pages, self.blocks, self.chars, self.linked, self.lost = label, pages, blocks, chars, linked, lost
        self.texts, self.children = texts or {}, children or []
        self.content, self.constants = False, frozenset()

    @classmethod
    def of(cls, run: list[Block]) -> Template:
        """The template of one page's run."""
        texts = {mark_of(b.text): (1, len(b.text)) for b in run if b.text}
        children: list[Template] = []
        for b in run:
            own = [cls.of(r) for r in runs(b.children)]
            children = _aligned(children, own, 0) if children else own
        return cls(run[0].label, 1, len(run), sum(len(b.text) for b in run), sum(b.linked for b in run), texts, 0, children)

    def packed(self) -> list:
        return [self.label, self.pages, self.blocks, self.chars, self.linked, self.texts, self.lost, [c.packed() for c in self.children]]

    @classmethod
    def unpacked(cls, x: list) -> Template:
        return cls(*x[:5], {k: tuple(v) for k, v in x[5].items()}, x[6], [cls.unpacked(c) for c in x[7]])

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


def similarity(a: Template, b: Template, known: dict | None = None) -> int:
    """Simple tree matching: the most nodes of two trees that can be matched, roots with roots, in order; 0 if the roots
    differ."""
    if a.label != b.label:
        return 0
    known = {} if known is None else known
    found = known.get((id(a), id(b)))
    if found is None:
        found = known[id(a), id(b)] = 1 + _table(a.children, b.children, known)[0][0]
    return found


def _table(a: list[Template], b: list[Template], known: dict) -> list[list[int]]:
    """best[i][j]: the most nodes that the children from i and from j on can match."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        below, row, x = best[i + 1], best[i], a[i]
        for j in range(len(b) - 1, -1, -1):
            most = below[j] if below[j] > row[j + 1] else row[j + 1]
            if x.label == b[j].label:
                most = max(most, below[j + 1] + similarity(x, b[j], known))
            row[j] = most
    return best


Alignment = list[tuple[int | None, int | None]]


def plain_matching(a: list[str], b: list[str]) -> Alignment | None:
    """The alignment of two lists of labels, if none occurs twice in a list and those of both are in the same order, so that
    the one that matches all of them is the best whatever is below; else None."""
    at = {x: j for j, x in enumerate(b)}
    if len(at) < len(b) or len(set(a)) < len(a):
        return None
    out: Alignment = []
    last = -1
    for i, x in enumerate(a):
        j = at.get(x)
        if j is None:
            out.append((i, None))
        elif j <= last:
            return None
        else:
            out += [(None, k) for k in range(last + 1, j)]
            out.append((i, j))
            last = j
    return out + [(None, k) for k in range(last + 1, len(b))]


def matching(a: list[Template], b: list[Template]) -> Alignment:
    """The alignment of two lists of children by which simple tree matching matches most nodes; every child of either is
    in it once, in order."""
    plain = plain_matching([x.label for x in a], [x.label for x in b])
    if plain is not None:
        return plain
    known: dict = {}
    best = _table(a, b, known)
    out: Alignment = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].label == b[j].label and best[i][j] == best[i + 1][j + 1] + similarity(a[i], b[j], known):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= len(b) or (i < len(a) and best[i][j] == best[i + 1][j]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _aligned(a: list[Template], b: list[Template], pages: int) -> list[Template]:
    return [merged(a[i], b[j], pages) if i is not None and j is not None else a[i] if j is None else b[j] for i, j in matching(a, b)]


def merged(a: Template, b: Template, pages: int | None = None) -> Template:
    """The template of the pages of both; `pages` is 0 for two blocks of one page, which is counted once."""
    same = pages == 0
    texts = dict(a.texts)
    for t, (n, size) in b.texts.items():
        texts[t] = (max(n, texts[t][0]) if same else n + texts[t][0], size) if t in texts else (n, size)
    lost = a.lost + b.lost
    total = a.pages if same else a.pages + b.pages
    # Counters by Misra and Gries: what is taken off all of them is at most total / 4, so a constant can't be among those that go.
    most = 8 + 4 * -(-(a.blocks + b.blocks) // total)
    if len(texts) > 2 * most:
        cut = sorted((n for n, _ in texts.values()), reverse=True)[most]
        texts = {t: (n - cut, size) for t, (n, size) in texts.items() if n > cut}
        lost += cut
    children = _aligned(a.children, b.children, pages)
    if not same and total >= RARE:
        children = [c for c in children if c.pages * RARE >= total]
    return Template(a.label, total, a.blocks + b.blocks, a.chars + b.chars, a.linked + b.linked, texts, lost, children)


def is_chrome(tag: str, names: str, inside: bool = False) -> bool:
    """Whether tag or names say that an element is no content."""
    if tag in CHROME and not (inside and tag == "header"):
        return True
    return bool(names) and tag not in MAIN and tag not in ("body", "html") and BOILERPLATE.search(names) is not None


def decide(root: Template) -> Template:
    """Notes on a template which of its slots are content, and which texts in them are constant.

    The place of the content is found from the root down: as long as one element that a page has once, and that isn't
    running text, holds the bulk of the varying text outside links, the content is in there. Its slots are content
    but for those whose tag or names say otherwise; names don't count against an element that holds an article or main
    element, or, where there is none, most of the varying text."""
    pages = root.pages
    size: dict[int, int] = {}
    has_main: dict[int, bool] = {}

    def constants(t: Template, share: float) -> frozenset:
        return frozenset(k for k, (n, _) in t.texts.items() if n + t.lost >= share * pages) if pages >= LEAST_PAGES else frozenset()

    def measure(t: Template) -> None:
        for c in t.children:
            measure(c)
        fixed = sum(n * length for k, (n, length) in t.texts.items() if n + t.lost >= CONSTANT * pages) if pages >= LEAST_PAGES else 0
        size[id(t)] = max(0, t.chars - t.linked - fixed) + sum(size[id(c)] for c in t.children)
        has_main[id(t)] = any(not chrome_by_name(c) and (c.tag in MAIN or has_main[id(c)]) for c in t.children)

    def chrome_by_name(t: Template, inside: bool = False) -> bool:
        tag, names = t.label.split(".", 1)
        return is_chrome(tag, names, inside)

    measure(root)
    anywhere = has_main[id(root)]

    def chrome(t: Template, of: int, inside: bool) -> bool:
        if not chrome_by_name(t, inside) or has_main[id(t)]:
            return False
        return anywhere or not of or size[id(t)] < MOSTLY * of

    place = root
    while True:
        left = [c for c in place.children if not chrome(c, size[id(place)], False)]
        total = sum(size[id(c)] for c in left) + size[id(place)] - sum(size[id(c)] for c in place.children)
        once = [c for c in left if c.blocks <= 1.1 * c.pages and c.tag not in TEXTUAL]
        step = [c for c in once if c.tag in MAIN and size[id(c)] >= BULK_MAIN * total] or [c for c in once if size[id(c)] >= BULK * total]
        if not step or not total:
            break
        place = max(step, key=lambda c: size[id(c)])

    share = CONSTANT_INSIDE if place.tag in MAIN else CONSTANT
    most = size[id(place)]

    def settle(t: Template) -> tuple[int, int]:
        t.content, t.constants = True, constants(t, share)
        fixed = sum(n * length for k, (n, length) in t.texts.items() if k in t.constants)
        chars = t.chars
        for c in t.children:
            if not chrome(c, most, True):
                more = settle(c)
                fixed, chars = fixed + more[0], chars + more[1]
        return fixed, chars

    fixed, chars = settle(place)
    if fixed > MOST_CONSTANT * chars:

        def take_back(t: Template) -> None:
            t.constants = frozenset()
            for c in t.children:
                take_back(c)

        take_back(place)
    return root


def mark(page: Block, template: Template) -> bool:
    """Notes on a page's elements whether the template makes them content; whether any text is."""
    any_text = False

    def align(block: Block, t: Template | None, inside: bool) -> None:
        nonlocal any_text
        node = block.node
        if t is None:  # no slot of the template: content if it stands among content
            node.content = inside and not is_chrome(node.tag, node.names, True)
        else:
            node.content, inside = t.content, t.content
            node.constant = bool(t.constants) and mark_of(block.text) in t.constants
        any_text = any_text or (node.content and not node.constant and bool(block.text))
        parts = runs(block.children)
        if t is None:
            for part in parts:
                for b in part:
                    align(b, None, node.content)
            return
        pairs = plain_matching([p[0].label for p in parts], [c.label for c in t.children])
        for i, j in matching([Template.of(p) for p in parts], t.children) if pairs is None else pairs:
            if i is not None:
                for b in parts[i]:
                    align(b, t.children[j] if j is not None else None, node.content)

    align(page, template, False)
    return any_text


def _linked_share(node: Node) -> float:
    total = linked = 0

    def walk(n: Node, within: bool) -> None:
        nonlocal total, linked
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                total += size
                linked += size * within
            elif c.tag not in RAW:
                walk(c, within or c.tag == "a")

    walk(node, False)
    return linked / total if total else 0.0


def main_text(root: Node, template: Template | None = None) -> str:
    """The texts of a page's content blocks, joined in page order: the content slots of its host's template, or of its own
    where it has none, or where nothing of the page fits the template's. Constants go, and lists that are mostly links."""
    page = Block(root)
    if template is None or not mark(page, template):
        for b in _below(page):
            b.node.content = b.node.constant = False
        mark(page, decide(Template.of([page])))
    whole = len(page.text) + sum(len(b.text) for b in _below(page))
    out: list[str] = []
    current: list[str] = []

    def end() -> None:
        text = squeezed("".join(current))
        current.clear()
        if text:
            out.append(text)

    def walk(node: Node, shown: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    current.append(c)
            elif c.tag in RAW:
                end()
            elif c.tag == "br":
                current.append(" ")
            elif c.tag in BLOCKS:
                end()
                if not (c.content and c.tag in ("ul", "ol", "table", "dl") and _linked_share(c) > 0.8):
                    walk(c, c.content and not c.constant)
                end()
            elif is_chrome(c.tag, c.names, True) and _chars(c) < MOSTLY * whole:
                end()
            else:
                walk(c, shown)

    walk(root, root.content and not root.constant)
    end()
    return " ".join(out)


def _below(block: Block) -> Iterator[Block]:
    for b in block.children:
        yield b
        yield from _below(b)


def _chars(node: Node) -> int:
    return sum(len(c) if isinstance(c, str) else 0 if c.tag in RAW else _chars(c) for c in node.children)


def _partial(pages: DataFrame) -> DataFrame:
    """(host, part, template): the template of each task's pages of a host, distinct pages only."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Template] = {}
        seen: set[tuple[str, bytes]] = set()
        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = (host, blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                if mark in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(mark)
                page = Template.of([Block(parse(source))])
                by[host] = merged(by[host], page) if host in by else page
            if len(by) > 4096:  # hosts of a task beyond memory's bound go out early
                yield rows(by)
                by.clear()
        if by:
            yield rows(by)

    def rows(by: dict[str, Template]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(by)), pa.array([json.dumps(t.packed()) for t in by.values()])], ["host", "template"])

    return pages.mapInArrow(tidied(align), "host string, template string")


def _met(partial: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, key = None, None
        for b in batches:
            for row in b.to_pylist():
                page = Template.unpacked(json.loads(row["template"]))
                if key is not None and row["host"] != key:
                    yield out(key, pruned(whole, whole.pages) if last else whole)
                    whole = None
                key = row["host"]
                whole = page if whole is None else merged(whole, page)
        if whole is not None:
            yield out(key, pruned(whole, whole.pages) if last else whole)

    def out(host: str, whole: Template) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(whole.packed())])], ["host", "template"])

    def pruned(t: Template, pages: int) -> Template:
        t.texts = {k: v for k, v in t.texts.items() if v[0] + t.lost >= CONSTANT * pages}
        for c in t.children:
            pruned(c, pages)
        return t

    # Tasks merge what they have of a host as it comes, one template at a time in memory.
    return partial.repartition(*keys).sortWithinPartitions("host").select("host", "template").mapInArrow(meet, "host string, template string")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of `pages` (host, html): trees of all distinct pages of each host, aligned and merged.

    Tasks align the pages they read; then their templates, one per task and host, meet in PARTS parts and at last
    by host, so a host with a third of all pages is no task's alone. Copies of a page count once where a task has
    both. What is passed on of the whole template is what decides: texts that may be constant."""
    pages = pages.select("host", F.coalesce("html", F.lit("")).alias("html"))
    partial = written(_partial(pages), "page-templates")
    parted = _met(partial.withColumn("part", F.pmod(F.xxhash64("template"), F.lit(PARTS))), ["host", "part"])
    return _met(parted, ["host"], last=True)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (url, html, and what else it has) with text, the main text, and n_chars, its code points.

    Null html is empty and gives an empty text. Pages whose url is null or without :// share the host of no name.
    Pages of hosts with fewer than LEAST_PAGES pages are judged by a template of their own, without constants.
    Repeated rows give the same text; an empty table gives no rows. Columns text and n_chars of `pages` are replaced.
    Nothing of a content block is dropped or capped. A template's size follows that of its pages, not their number."""
    pages = pages.drop("text", "n_chars").withColumn("__host", host_of(F.col("url")))
    found = written(templates(pages.select(F.col("__host").alias("host"), "html")), "page-hosts").withColumnRenamed("host", "__of")
    size = found.agg(F.sum(F.length("template"))).first()[0] or 0
    found = F.broadcast(found) if size <= MOST_SENT else found
    x = pages.join(found, F.col("__host") == F.col("__of"), "left").drop("__of", "__host")
    schema = x.drop("template").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            texts = []
            for source, packed in zip(b.column(b.schema.get_field_index("html")).to_pylist(), b.column(b.schema.get_field_index("template")).to_pylist()):
                if packed is not None and packed not in known:
                    if len(known) > 256:
                        known.clear()
                    known[packed] = decide(Template.unpacked(json.loads(packed)))
                template = known.get(packed)
                texts.append(main_text(parse(source or ""), template if template and template.pages >= LEAST_PAGES else None))
            keep = [k for k, n in enumerate(b.schema.names) if n != "template"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(b.schema.names[k] for k in keep), "text", "n_chars"])

    return x.mapInArrow(tidied(take), schema)
