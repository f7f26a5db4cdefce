"""A tolerant DOM, simple tree matching, and wrappers of same-host pages. No Spark here.

A wrapper is the skeleton that pages of one host share: a tree of labels whose
nodes say what they are. Simple tree matching aligns it with a page; the page's
nodes opposite CONTENT hold the article, those opposite FURNITURE go, and so do
blocks that have the text of their TEMPLATE node.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no text of an article wherever they stand.
NO_TEXT = frozenset("head nav footer aside form script style noscript button select textarea iframe svg template object canvas dialog menu".split())
#: Elements that only hold others; an article's container is one of them.
CONTAINERS = frozenset("html body div section article main table tbody tr td center header nav footer aside form ul ol dl".split())
CELLS = frozenset("table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Hints in class or id, used where a host has no wrapper and for slots of a wrapper that come out the same size as the article.
MARKS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice popup modal nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side widget footer comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar".split()
)
#: Words that may stand beside a mark in a class or id.
NEUTRAL = frozenset("area bar block bottom box container content group inner item items left link links list main outer panel posts region right section site thread top wrap wrapper".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol table article section main div body html dl select".split())
#: Deeper elements become siblings, as in browsers.
DEEPEST = 512
#: A block is template if it is the same, at one place, on so many sampled pages of different content at least, and on so large a share of them.
CONSTANT_PAGES, MOST_PAGES = 3, 0.6
#: Two pages are of different content if each has so large a share of its text to itself.
OWN_SHARE = 0.25
#: The article's container is entered if it holds so many times the text of the next one, and leaves at most this share to paragraphs beside it.
LEAD, BESIDE = 2.0, 0.05
CONTENT, FURNITURE = "content", "furniture"


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "marks", "label", "children", "parent", "depth")

    def __init__(self, tag: str, marks: str = "", parent: Node | None = None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.label = f"{tag}.{marks}" if marks else tag
        self.depth = parent.depth + 1 if parent else 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def _close(self, tags: set[str]) -> None:
        """Close the nearest open element of those, unless a scope lies between."""
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in _SCOPES:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._close({"p"})
        if tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag])
        if tag == "body" and self.at.tag == "head":
            self.at = self.at.parent or self.root
        found = dict(attrs)
        marks = {word for name in ("class", "id", "role") for word in (found.get(name) or "").lower().split()}
        node = Node(tag, " ".join(sorted(marks)), self.at)
        self.at.children.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = self.at
        self.handle_starttag(tag, attrs)
        if self.at is not before and self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The DOM of a page; broken markup is repaired, never refused."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def marked(node: Node) -> bool:
    """Whether class or id say nothing but that this is furniture."""
    if not node.marks or node.tag in ("body", "html", "article", "main"):
        return False
    words = {w for w in re.split(r"[\W\d_]+", node.marks) if w}
    return not MARKS.isdisjoint(words) and words <= MARKS | NEUTRAL


def walk(root: Node) -> list[Node]:
    """The elements below and with a root, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.elements()))
    return out


def runs(root: Node, gone: frozenset[int] | set[int] = frozenset()) -> list[tuple[Node, str]]:
    """(owner, text) of the blocks below an element in page order, white space collapsed; the owner is the block element around the text.

    Left out are elements without text, page headers outside articles, and the elements whose id() is in `gone`.
    """
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    owners = [root]

    def end() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((owners[-1], text))

    stack: list[tuple[object, bool, bool]] = [(root, True, root.tag in ("article", "main"))]
    while stack:
        item, opening, inside = stack.pop()
        if isinstance(item, str):
            buffer.append(item)
        elif not opening:
            end()
            owners.pop()
        elif item is root or not (item.tag in NO_TEXT or (item.tag == "header" and not inside) or id(item) in gone):
            if item.tag in ("br", "hr", "wbr", "img"):
                if item.tag == "hr":
                    end()
                elif item.tag != "wbr":
                    buffer.append(" ")
                continue
            if item.tag not in INLINE:
                end()
                owners.append(item)
                stack.append((item, False, inside))
            within = inside or item.tag in ("article", "main")
            stack.extend((c, True, within) for c in reversed(item.children))
    end()
    return out


class Matcher:
    """Simple tree matching: the alignment of two trees, order and parents kept, with most matching nodes.

    What two subtrees can match depends on their labels alone, so weights are
    kept for pairs of shapes; and children that begin or end both lists alike
    are matched at once, which never loses a match.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...], int]] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> dict[int, int]:
        """The shape of each element below a root, by id()."""
        of: dict[int, int] = {}
        for node in reversed(walk(root)):
            key = (node.label, tuple(of[id(c)] for c in node.elements()))
            if key not in self.shapes:
                self.shapes[key] = len(self.parts)
                self.parts.append((*key, 1 + sum(self.parts[s][2] for s in key[1])))
            of[id(node)] = self.shapes[key]
        return of

    @staticmethod
    def _trim(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
        """How many shapes both lists have in common at their start, and then at their end."""
        most = min(len(xs), len(ys))
        head = next((k for k in range(most) if xs[k] != ys[k]), most)
        tail = next((k for k in range(most - head) if xs[-1 - k] != ys[-1 - k]), most - head)
        return head, tail

    def weigh(self, x: int, y: int) -> int:
        """How many nodes of two shapes match."""
        todo = [(x, y)]
        while todo:
            pair = todo[-1]
            if pair in self.weights:
                todo.pop()
                continue
            (la, xs, size), (lb, ys, _) = self.parts[pair[0]], self.parts[pair[1]]
            if la != lb or pair[0] == pair[1]:
                self.weights[pair] = size if pair[0] == pair[1] else 0
                continue
            head, tail = self._trim(xs, ys)
            xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            missing = [p for p in {(a, b) for a in set(xs) for b in set(ys)} if p not in self.weights]
            if missing:
                todo.extend(missing)
                continue
            same = self.parts[pair[0]][1]
            ends = sum(self.parts[s][2] for s in same[:head]) + sum(self.parts[s][2] for s in same[len(same) - tail :])
            self.weights[pair] = 1 + ends + int(self._table(xs, ys)[0][-1])
        return self.weights[x, y]

    def _table(self, xs: tuple[int, ...], ys: tuple[int, ...], trace: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Last row of the table of two lists of children, and for each row where a cell is reached by matching, and from above, as packed bits."""
        row, moves = np.zeros(len(ys) + 1, np.int64), []
        gains = {a: np.array([self.weights[a, b] for b in ys], np.int64) for a in set(xs)}
        for a in xs:
            matched = row[:-1] + gains[a]
            new = np.maximum.accumulate(np.append(0, np.maximum(matched, row[1:])))
            if trace:
                moves.append(np.packbits(np.stack([(matched == new[1:]) & (gains[a] > 0), row[1:] == new[1:]])))
            row = new
        return row, moves

    def pairs(self, a: Node, b: Node, shapes: dict[int, int] | None = None, wanted: set[int] | None = None) -> list[tuple[Node, Node]]:
        """The matched nodes of two trees; shapes: of the first, if they are known; wanted: which of its nodes to follow, if not all."""
        sa, sb = shapes or self.shape(a), self.shape(b)
        out: list[tuple[Node, Node]] = []
        todo = [(a, b)] if self.weigh(sa[id(a)], sb[id(b)]) else []
        while todo:
            x, y = todo.pop()
            if wanted is not None and id(x) not in wanted:
                continue
            out.append((x, y))
            cx, cy = x.elements(), y.elements()
            if not cx or not cy:
                continue
            xs, ys = tuple(sa[id(c)] for c in cx), tuple(sb[id(c)] for c in cy)
            head, tail = self._trim(xs, ys)
            todo.extend(zip(cx[:head], cy[:head], strict=True))
            todo.extend(zip(cx[len(cx) - tail :], cy[len(cy) - tail :], strict=True))
            cx, cy, xs, ys = cx[head : len(cx) - tail], cy[head : len(cy) - tail], xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            if not xs or not ys:
                continue
            for p, q in {(p, q) for p in set(xs) for q in set(ys)}:
                self.weigh(p, q)
            _, moves = self._table(xs, ys, trace=True)
            i, j = len(xs), len(ys)
            while i and j:
                match, above = np.unpackbits(moves[i - 1], count=2 * len(ys)).reshape(2, -1)[:, j - 1]
                if match:
                    todo.append((cx[i - 1], cy[j - 1]))
                    i, j = i - 1, j - 1
                elif above:
                    i -= 1
                else:
                    j -= 1
        return out


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> None:
    """The matched nodes of two trees, appended to pairs."""
    pairs.extend(Matcher().pairs(a, b))


def _prose(node: Node, constant: dict[int, set[str]]) -> dict[int, int]:
    """Characters of varying text outside links below each element; elements without text have none."""
    out: dict[int, int] = {}
    order: list[Node] = []
    todo = [(node, False)]
    while todo:
        at, link = todo.pop()
        if at is not node and at.tag in NO_TEXT:
            continue
        order.append(at)
        own = " ".join("".join(c for c in at.children if isinstance(c, str)).split())
        out[id(at)] = 0 if link or own in constant.get(id(at), ()) else len(own)
        todo.extend((c, link or c.tag == "a" or (at.tag not in CONTAINERS and id(at) in constant)) for c in at.elements())
    for at in reversed(order):
        if at is not node:
            out[id(at.parent)] += out[id(at)]
    return out


def _roots(root: Node, masses: dict[int, int]) -> list[Node]:
    """What holds the article, found from the text that varies below each node."""
    at = root
    while at.tag != "article":
        children = at.elements()
        inside = [c for c in children if masses.get(id(c)) and c.tag in CONTAINERS]
        titles = [c for c in children if masses.get(id(c)) and c.tag in HEADINGS]
        beside = masses[id(at)] - sum(masses[id(c)] for c in (*inside, *titles))
        if not inside or beside > BESIDE * masses[id(at)]:
            break
        groups: dict[object, list[Node]] = {}  # siblings of one label are parts of one thing, if the label says more than div or td
        for c in inside:
            groups.setdefault(c.label if c.marks or c.tag in ("section", "article") else id(c), []).append(c)
        size = lambda group: sum(masses[id(c)] for c in group)
        leading = lambda some: some and (len(some) == 1 or size(some[1]) * LEAD <= size(some[0]))
        ranked = sorted(groups.values(), key=size, reverse=True)
        if not leading(ranked):  # another slot is as large as the article: hints decide
            ranked = [g for g in ranked if not marked(g[0])]
            if not leading(ranked):
                break
        first = ranked[0]
        headless = not any(d.tag in HEADINGS for c in first for d in walk(c))
        if len(first) > 1 or (titles and headless):
            kept = {id(c) for c in (*first, *(titles if headless else ()))}
            return [c for c in children if id(c) in kept]
        at = first[0]
    return [at]


def plain_content(root: Node) -> list[tuple[Node, str]]:
    """The blocks of a page without a wrapper: its articles if they hold most of the text, else the container that its own text points to."""
    gone = {id(n) for n in walk(root) if marked(n)}
    masses = _prose(root, {})
    for node in reversed(walk(root)):
        if id(node) in gone and id(node) in masses:
            size, at = masses[id(node)], node
            while at is not None and id(at) in masses:
                masses[id(at)] -= size
                at = at.parent
    named, todo = [], [root]
    while todo:
        at = todo.pop()
        if at.tag in ("article", "main"):
            named.append(at)
        elif id(at) not in gone:
            todo.extend(reversed(at.elements()))
    total = masses[id(root)]
    if total and 2 * sum(masses.get(id(c), 0) for c in named) >= total:
        chosen = [c for c in named if masses.get(id(c))]
    else:
        chosen, at = [root], root
        while total and (whole := [c for c in at.elements() if c.tag in CONTAINERS and masses.get(id(c)) == masses[id(at)]]):
            at = whole[0]
            chosen = [at]
    return [block for part in chosen for block in runs(part, gone)]


def distinct(trees: list[Node]) -> list[Node]:
    """The trees less those whose content is mostly that of one before: copies of an article are no evidence of a template."""
    kept: list[tuple[Node, Counter]] = []
    for tree in trees:
        mine = Counter({text: len(text) for _, text in plain_content(tree)})
        own = lambda a, b: sum(n for t, n in a.items() if t not in b) >= OWN_SHARE * sum(a.values())
        if mine and all(own(mine, other) and own(other, mine) for _, other in kept):
            kept.append((tree, mine))
    return [tree for tree, _ in kept]


def induce(pages: list[str]) -> list[list] | None:
    """The wrapper of same-host pages, None if fewer than two differ: [place of the parent, label, what it is, template texts] of each node of the skeleton."""
    trees = distinct(sorted((parse(p) for p in pages), key=lambda t: len(walk(t)), reverse=True))
    if len(trees) < 2:
        return None
    base = trees[len(trees) // 3]  # neither the largest page nor a stub
    others, matcher = [t for t in trees if t is not base], Matcher()
    opposite: dict[int, list[tuple[int, Node]]] = {}
    texts = [owned(t) for t in others]
    for k, tree in enumerate(others):
        for x, y in matcher.pairs(base, tree):
            opposite.setdefault(id(x), []).append((k, y))
    enough = max(CONSTANT_PAGES - 1, MOST_PAGES * len(others))
    constant: list[dict[int, set[str]]] = [{} for _ in others]
    mine: dict[int, set[str]] = {}
    for owner, found in owned(base).items():
        met = opposite.get(owner, [])
        same = {t for t in found if all(t in texts[k].get(id(y), ()) for k, y in met)} if len(met) >= enough else set()
        if same:
            mine[owner] = same
            for k, y in met:
                constant[k][id(y)] = same
    masses, beside = _prose(base, mine), [_prose(t, c) for t, c in zip(others, constant, strict=True)]
    total = {x: m + sum(beside[k].get(id(y), 0) for k, y in opposite.get(x, ())) for x, m in masses.items()}
    roots, flags = _roots(base, total), {}
    for part in roots:
        for node in walk(part)[1:]:
            stable = len(opposite.get(id(node), ())) >= enough
            if stable and marked(node):
                flags[id(node)] = FURNITURE
            elif id(node) in mine and (node.marks or node.tag in CONTAINERS - CELLS):
                flags[id(node)] = sorted(mine[id(node)])
    flags |= {id(part): CONTENT for part in roots}
    return _skeleton(base, flags, matcher.shape(base))


def _skeleton(base: Node, flags: dict[int, str | list[str]], shapes: dict[int, int]) -> list[list]:
    """The flagged tree without texts; of like neighbours, three are kept."""
    out: list[list] = []
    todo = [(base, -1)]
    while todo:
        node, parent = todo.pop()
        flag = flags.get(id(node))
        out.append([parent, node.label, flag if isinstance(flag, str) else "", flag if isinstance(flag, list) else []])
        kept: list[Node] = []
        for c in node.elements():
            alike = len(kept) > 2 and all(shapes[id(k)] == shapes[id(c)] and id(k) not in flags for k in kept[-3:])
            if not alike or id(c) in flags or any(id(d) in flags for d in walk(c)):
                kept.append(c)
        todo.extend((c, len(out) - 1) for c in reversed(kept))
    return out


def owned(root: Node) -> dict[int, set[str]]:
    """The texts of the blocks of each owner."""
    out: dict[int, set[str]] = {}
    for owner, text in runs(root):
        out.setdefault(id(owner), set()).add(text)
    return out


class Wrapper:
    """A wrapper ready to read pages."""

    def __init__(self, skeleton: list[list]):
        self.nodes: list[Node] = []
        for parent, label, *_ in skeleton:
            tag, _, marks = label.partition(".")
            above = self.nodes[parent] if parent >= 0 else None
            node = Node(tag, marks, above)
            self.nodes.append(node)
            if above is not None:
                above.children.append(node)
        self.kind = {id(n): row[2] for n, row in zip(self.nodes, skeleton, strict=True) if row[2]}
        self.template = {id(n): set(row[3]) for n, row in zip(self.nodes, skeleton, strict=True) if row[3]}
        self.content = [n for n in self.nodes if self.kind.get(id(n)) == CONTENT]
        self._start()

    def _start(self) -> None:
        self.matcher = Matcher()
        self.shapes = self.matcher.shape(self.nodes[0])
        self.wanted: set[int] = set()
        for node in self.nodes:
            if id(node) in self.kind or id(node) in self.template:
                while node is not None and id(node) not in self.wanted:
                    self.wanted.add(id(node))
                    node = node.parent

    def read(self, root: Node) -> list[tuple[Node, str]] | None:
        """The blocks of the article, None if the page has no place for it."""
        if len(self.matcher.parts) > 50_000:
            self._start()
        pairs = self.matcher.pairs(self.nodes[0], root, self.shapes, self.wanted)
        parts = [y for x, y in pairs if self.kind.get(id(x)) == CONTENT]
        if not parts:
            return None
        labels = Counter(n.label for n in self.content)
        if any(n > 1 for n in labels.values()):  # an article of several parts may have more or fewer of them here
            parts = [c for c in parts[0].parent.elements() if labels[c.label]]
        gone = {id(y) for x, y in pairs if self.kind.get(id(x)) == FURNITURE}
        template = {id(y): self.template[id(x)] for x, y in pairs if id(x) in self.template}
        if len(parts) > 1:
            place = {id(n): k for k, n in enumerate(walk(root))}
            parts.sort(key=lambda n: place[id(n)])
        found = [block for part in parts for block in runs(part, gone)]
        left = [(owner, text) for owner, text in found if text not in template.get(id(owner), ())]
        size = lambda some: sum(len(t) for _, t in some)
        return left if 2 * size(left) >= size(found) else found


def extract(html: str, wrapper: Wrapper | None) -> str:
    """The main text of a page: what its host's wrapper calls content, less template and furniture at their places.

    If the template were most of the content, the page is a copy of those that
    it was learned from, and keeps everything.
    """
    root = parse(html)
    found = wrapper.read(root) if wrapper else None
    return "\n".join(t for _, t in (plain_content(root) if found is None else found))
