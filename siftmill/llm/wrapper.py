"""Main text of web pages by wrapper induction.

Trees: a page's elements, those of a line (``b``, ``a``) taken as text. Neighbouring elements of one
sign (tag and class, id and role words) are one repeated node, also with up to ``FOLD`` other kinds
in between, so that a list of entries is one node whatever its length.

Template: all pages of a host are aligned by simple tree matching (``treematch``) into one tree of all
their nodes, the slots. Pages that have the same nodes, whatever their texts and however often a node
repeats, are of one kind and merged once. Every page is aligned with its host's template, and its
nodes' texts are counted by slot, over all pages: a page that is logged more than once counts once,
and the page's own host name is left out of the texts. Nodes of a very long list that the matching
passes over are counted by their path instead, so that every node of every page is judged.

Verdicts: how often a slot's text stands in other pages too, and how many different texts it has, are
estimated from the host's pages, however few, and, with the weight of ``PRIOR`` pages, from the pages of all hosts
that have a node at the same path. A slot whose texts nearly all recur (``RECUR``) and are few
(``FEW``), be they one or some in turn, is constant, and belongs to the template; so does a text that nearly all
(``SHARED``) pages of a host have in a slot, if ``ENOUGH`` pages of any hosts have it. The article is what is left when a page's constants are
dropped, all of it in page order.

Ties: what does not recur may still be a menu, an advert or a comment. Elements that are known by their tag or by
their class, id and role (``MENUS``, ``MARKS``) are dropped too, on hosts of any number of pages. They count only if all their words
do or name a box (``BOXES``): "related-posts" and "ad top" do, "related work" and "share prices" are the article's own. On a page without
any constant, or one of which constants leave less than 1 / ``LEFT`` of the text or of the article elements that hold most of it (copies of one page), the article is all of its ``article`` elements, else its ``main``, else the element that
holds most of the text. Scripts, styles, forms and the like are never text.

Skew: a host's pages are never gathered. A page is parsed once for its outline (signs, repetitions, prints); the
different kinds of a host are merged one after the other in ``SALTS`` parts, then the parts; outlines meet the
template in a join that Spark can split; counts are of (host, slot, text, page) first, then of (host, slot, text).

Defined cases: null html is empty and gives an empty text; pages without a host share one; repeated
rows each keep their row; unclosed and stray tags are mended as browsers do for blocks; a tag that
never ends makes the rest text; ``br`` is white space; pages of any length and depth are read whole, in
time that grows with their length; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import treematch
from siftmill.llm.shared import Shelf, columns, small
from siftmill.llm.treematch import Shape
from siftmill.llm.urlfilter import host_and_path

ENOUGH = 3
SALTS = 64
FOLD = 4
LONG = 1 << 16  # characters of an outline above which a worker does not remember it
PRIOR = 10
RECUR, FEW, SHARED = 0.95, 0.35, 0.8
LEFT = 100
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = frozenset("ul ol dl table div section article body html td th main aside nav select".split())
NEVER = frozenset("script style noscript template head title form button select option input textarea iframe svg object embed canvas".split())
MENUS = frozenset("nav footer aside menu dialog".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
MARKS = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended footer masthead toolbar pagination pager login banner contentinfo complementary".split())
#: Words that say nothing beside one of MARKS: a class of such words alone names a kind of box.
BOXES = frozenset("area articles bar block body bottom box buttons center col column container content entries form global group holder icons inner item items js left link links list main more news outer page panel post posts reader right row section site slot social stories text thread tool tools top unit user widget widgets wrap wrapper zone".split())
WHOLE = frozenset(("html", "body", "main", "article"))  # their marks tell of what the page has beside the article
HEADERS = frozenset(("header", "hgroup"))
HOLDERS = frozenset(("article", "main"))

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r""">|=\s*(["'])""")
MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("kind", "marks", "parts", "print", "runs", "shape", "tag")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()):
        self.tag, self.marks, self.parts = tag, marks, []  # parts: texts and nodes in order

    def nodes(self) -> list["Node"]:
        return [p for p in self.parts if not isinstance(p, str)]


class _Open:
    """The open elements of a page being read, with the places of each tag, so that looking for one takes no walk."""

    def __init__(self):
        self.stack = [Node("#root")]
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in FENCES:
            self.fences.append(at)
        if node.tag not in INLINE:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in FENCES:
                self.fences.pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        at = self.places.get(tag)
        if at and (tag not in INLINE or not self.blocks or self.blocks[-1] < at[-1]):  # a stray end tag of a line closes no block
            self.cut(at[-1])

    def close(self, tags: "set[str] | frozenset[str]") -> None:
        """Closes the last open element of ``tags`` if no other that fences it in is open in it."""
        at = max((p[-1] for t in tags if (p := self.places.get(t))), default=0)
        if at and (not self.fences or self.fences[-1] <= at):
            self.cut(at)


def _tag_end(html: str, at: int, without: dict[str, int]) -> int:
    """The place after the tag's ``>``; -1 if it never ends. A quote counts after an equals sign if it is closed somewhere."""
    while found := STOP.search(html, at):
        at = found.end()
        if (mark := found.group(1)) is None:
            return at
        if at < without.get(mark, len(html)):
            closed = html.find(mark, at)
            if closed < 0:
                without[mark] = at  # from here on no quote of the kind is closed
            else:
                at = closed + 1
    return -1


def parse(html: str) -> Node:
    """The page's tree. Text is kept as it stands, with its character references decoded."""
    opened = _Open()
    stack, n, at = opened.stack, len(html), 0
    without: dict[str, int] = {}
    since = 0  # start of text not yet taken

    def text(to: int) -> None:
        if to > since:
            stack[-1].parts.append(unescape(html[since:to]))

    while (at := html.find("<", at)) >= 0:
        follows = html[at + 1 : at + 2]
        if follows in ("!", "?"):
            text(at)
            for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if html.startswith(opens, at):
                    end = html.find(closes, at + len(opens))
                    break
            if end < 0 and closes == ">":
                since = at
                break
            at = since = n if end < 0 else end + len(closes)
            continue
        found = TAG.match(html, at)
        if found is None:
            at += 1
            continue
        end = _tag_end(html, found.end(), without)
        if end < 0:
            break
        text(at)
        extra, tag = html[found.end() : end - 1], found.group(1).lower()
        since = end
        if follows == "/":
            if tag not in VOID:
                opened.end(tag)
            at = end
            continue
        if tag in CLOSED_BY_BLOCK:
            opened.close(frozenset(("p",)))
        if tag in SIBLINGS:
            opened.close(SIBLINGS[tag])
        marks = tuple(w.lower() for m in MARKED.finditer(extra) for w in WORDS.findall(m.group(1) or m.group(2) or m.group(3) or "")) if extra else ()
        node = Node(tag, marks)
        stack[-1].parts.append(node)
        at = end
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if tag in ("textarea", "title"):
                node.parts.append(unescape(html[at : closing.start() if closing else n]))
            at = since = closing.end() if closing else n
        elif tag not in VOID and not extra.endswith("/"):
            opened.push(node)
    text(n)
    return stack[0]


class Rules:
    """What is known of a page's elements: constants, and whether tags and words may break ties."""

    def __init__(self, constant: "set[int] | frozenset[int]" = frozenset(), words: bool = True):
        self.constant, self.words = constant, words

    def unwanted(self, node: Node, inside: bool) -> bool:
        """Whether an element is not of the article. inside: below an ``article`` or ``main``, whose headers are its own."""
        if node.tag in NEVER or id(node) in self.constant:
            return True
        if not self.words or node.tag in WHOLE:
            return False
        if node.tag in MENUS or node.tag in HEADERS and not inside:
            return True
        return not MARKS.isdisjoint(node.marks) and all(m in MARKS or m in BOXES or len(m) == 1 for m in node.marks)


def blocks(nodes: "Node | list[Node]", rules: Rules = Rules(), inside: bool = True) -> list[str]:
    """The blocks of text below nodes, white space made single, without what the rules do not want."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (text := " ".join("".join(line).split())):
            out.append(text)
        line.clear()

    tops = nodes if isinstance(nodes, list) else [nodes]
    kept = {id(x) for x in tops}
    todo: list = [(x, inside) for x in reversed(tops)]
    while todo:
        x, within = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif id(x) not in kept and rules.unwanted(x, within):
            if x.tag not in INLINE:
                end()
        else:
            within = within or x.tag in HOLDERS
            if x.tag not in INLINE:
                end()
                todo.append((None, within))
            todo.extend((p, within) for p in reversed(x.parts))
    end()
    return out


# --- trees as the matching sees them ------------------------------------------------------


def survey(root: Node, host: str = "") -> None:
    """Gives every block element its print (a hash of its text, 0 if it has none), its runs of like children that have text, its shape and its kind."""
    order, contents = [root], []
    for node in order:
        content, todo = [], list(reversed(node.parts))
        while todo:  # through the elements of a line
            x = todo.pop()
            if isinstance(x, str) or x.tag not in INLINE:
                content.append(x)
                if not isinstance(x, str):
                    if x.tag in NEVER:
                        content.pop()
                    else:
                        order.append(x)
            else:
                content.append(" ")
                todo.extend(reversed(x.parts))
        contents.append(content)
    for node, content in zip(reversed(order), reversed(contents)):
        parts, line = [], []
        runs: list[tuple[str, list[Node]]] = []
        recent: dict[str, list[Node]] = {}
        for x in [*content, None]:
            if isinstance(x, str):
                line.append(x)
                continue
            if line and (words := " ".join("".join(line).split())):
                parts.append((words.replace(host, "") if host else words).encode("utf-8", "surrogatepass"))
            line = []
            if x is not None and x.print:
                parts.append(x.print.to_bytes(8, "little"))
                sign = " ".join((x.tag, *x.marks))
                if sign in recent:
                    recent[sign].append(x)
                else:
                    runs.append((sign, [x]))
                    recent[sign] = runs[-1][1]
                    if len(recent) > FOLD:
                        del recent[next(iter(recent))]
        node.print = xxhash.xxh3_64_intdigest(b"\0".join(parts)) if parts else 0
        _form(node, " ".join((node.tag, *node.marks)), runs)


def _form(node: Node, sign: str, runs: list[tuple[str, list[Node]]]) -> None:
    """Gives a node its runs, its shape (of each run the largest member) and its kind (of each run all different members)."""
    node.runs = runs
    node.shape = treematch.shape(sign, tuple(max((m.shape for m in members), key=lambda t: t.size) for _, members in runs))
    node.kind = treematch.shape(sign, tuple(treematch.shape("", tuple(dict.fromkeys(m.kind for m in members))) for _, members in runs))


def _flat(root: Node, once: bool) -> tuple[str, list[Node]]:
    """A surveyed tree without its texts (JSON: the sign of each node, its parent and which run of the parent it is in, parents first), and its nodes in that order.

    once: members of a run that are of one kind are written once.
    """
    order, signs, ups, places = [root], [root.shape.sign], [-1], [0]
    for at, node in enumerate(order):
        for place, (sign, members) in enumerate(node.runs):
            if once and len(members) > 1:
                members = list({id(m.kind): m for m in reversed(members)}.values())[::-1]
            order.extend(members)
            signs.extend([sign] * len(members))
            ups.extend([at] * len(members))
            places.extend([place] * len(members))
    return json.dumps([signs, ups, places], separators=(",", ":")), order


def _unflat(flat: str) -> list[Node]:
    """The nodes that ``_flat`` wrote, parents first; prints are not known."""
    signs, ups, places = json.loads(flat)
    nodes = [Node("") for _ in signs]
    runs: list[list[tuple[str, list[Node]]]] = [[] for _ in signs]
    for node, sign, up, place in zip(nodes, signs, ups, places):
        if up >= 0:
            if place == len(runs[up]):
                runs[up].append((sign, []))
            runs[up][place][1].append(node)
    for node, sign, own in zip(reversed(nodes), reversed(signs), reversed(runs)):
        _form(node, sign, own)
    return nodes


_kinds: dict[Shape, str] = {}


def outline(html: str, host: str = "") -> tuple[str, str, bytes]:
    """kind and tree of a page (``_flat``, with members of one kind once and with all), and the prints of the tree's nodes."""
    root = parse(html)
    survey(root, host)
    tree, order = _flat(root, False)
    kind = _kinds.get(root.kind)
    if kind is None:
        if len(_kinds) > 1000:
            _kinds.clear()
        kind = _flat(root, True)[0]
        if len(kind) < LONG:
            _kinds[root.kind] = kind
    return kind, tree, array("Q", [n.print for n in order]).tobytes()


class Slot:
    """A node of a template."""

    __slots__ = ("index", "kids", "path", "shape", "sign")

    def __init__(self, sign: str):
        self.sign, self.kids, self.index, self.path = sign, [], 0, 0
        self.shape: Shape = treematch.shape(sign, ())

    @property
    def runs(self) -> list[tuple[str, list["Slot"]]]:
        return [(k.sign, [k]) for k in self.kids]

    @property
    def kind(self) -> "Slot":
        return self


def _all_slots(root: Slot) -> list[Slot]:
    """Every slot, parents first."""
    out, todo = [], [root]
    while todo:
        slot = todo.pop()
        out.append(slot)
        todo.extend(reversed(slot.kids))
    return out


def _reshape(root: Slot) -> None:
    for slot in reversed(_all_slots(root)):
        slot.shape = treematch.shape(slot.sign, tuple(k.shape for k in slot.kids))


def _merge(root: Slot, tree: "Node | Slot") -> None:
    """Puts a page's nodes, or another template's, into the template: those that match where they match, new ones between."""
    todo: list[tuple[Slot, list]] = [(root, [tree])]
    grown = False
    while todo:
        slot, members = todo.pop()
        below: dict[int, tuple[Slot, list]] = {}
        for member in {id(m.kind): m for m in members}.values():
            if not member.runs:
                continue
            now = treematch.pairs(tuple(k.shape for k in slot.kids), member.shape.kids)
            place = {j: i for i, j in now}
            kids, at = [], 0
            for j, (sign, nodes) in enumerate(member.runs):
                if j in place:
                    kids += slot.kids[at : place[j] + 1]
                    at = place[j] + 1
                    kid = slot.kids[place[j]]
                else:
                    kid = Slot(sign)
                    kids.append(kid)
                    grown = True
                below.setdefault(id(kid), (kid, []))[1].extend(nodes)
            slot.kids = kids + slot.kids[at:]
        todo.extend(below.values())
    if grown:
        _reshape(root)


def _apart(path: int) -> int:
    """The key of a node that matches no slot: its path, made unlike any slot's index."""
    return _signed(path | 1 << 63)


def align(tree: Node, template: Slot) -> Iterator[tuple[int, int, list[Node]]]:
    """(key, path, members) of each of the page's repeated nodes: the index and path of its slot, or what stands for them where none matches."""
    todo: list[tuple[Node, Slot | None, int]] = [(tree, template, template.path)]
    known: dict[tuple, dict[int, int]] = {}
    while todo:
        node, slot, path = todo.pop()
        place: dict[int, int] = {}
        if slot is not None and slot.kids:
            key = (node.shape, slot)
            if key not in known:
                known[key] = dict(treematch.pairs(node.shape.kids, slot.shape.kids))
            place = known[key]
        for i, (sign, members) in enumerate(node.runs):
            if i in place:
                kid = slot.kids[place[i]]
                index, below = kid.index, kid.path
            else:
                kid, below = None, _below(path, sign)
                index = _apart(below)
            yield index, below, members
            todo.extend((m, kid, below) for m in members if m.runs)


def _below(path: int, sign: str) -> int:
    return xxhash.xxh3_64_intdigest(sign.encode("utf-8", "surrogatepass"), path)


def _written(root: Slot) -> str:
    """A template as JSON: [sign, parent] of each slot, parents first."""
    slots = _all_slots(root)
    number = {id(s): i for i, s in enumerate(slots)}
    parent = {id(k): number[id(s)] for s in slots for k in s.kids}
    return json.dumps([[s.sign, parent.get(id(s), -1)] for s in slots], separators=(",", ":"), ensure_ascii=False)


def induce(pages: list[str]) -> str:
    """The template of pages (html)."""
    root = Slot("#root")
    for kind in sorted({outline(page)[0] for page in pages}):
        _merge(root, _unflat(kind)[0])
    return _written(root)


def _read(template: str) -> Slot:
    slots: list[Slot] = []
    for index, (sign, parent) in enumerate(json.loads(template)):
        slot = Slot(sign)
        slot.index = index
        if parent >= 0:
            slots[parent].kids.append(slot)
        slot.path = _below(slots[parent].path if parent >= 0 else 0, sign)
        slots.append(slot)
    _reshape(slots[0])
    return slots[0]


_loaded = lru_cache(64)(_read)


@lru_cache(64)
def _verdict(verdict: str) -> tuple[set[int], set[tuple[int, int]]]:
    known = json.loads(verdict)
    return set(known.get("constant") or ()), {(m["slot"], m["print"]) for m in known.get("shared") or ()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: What a row of ``observe`` is of: a repeated node, one of its members, or a node that stands alone (both).
RUN, MEMBER, ALONE = 0, 1, 2


def _places(tree: str, template: str) -> list[tuple[int, int, list[int]]]:
    """(slot, path, places in the outline) of a page's repeated nodes."""
    nodes = _unflat(tree)
    number = {id(n): i for i, n in enumerate(nodes)}
    return [(key, _signed(path), [number[id(m)] for m in members]) for key, path, members in align(nodes[0], _loaded(template))]


_known_places = lru_cache(256)(_places)


def observed(tree: str, prints: bytes, template: str) -> Iterator[tuple[int, int, int, int]]:
    """(slot, path, what, print) of an outline's nodes; each once."""
    of = memoryview(prints).cast("q")
    seen = set()
    for key, path, at in (_known_places if len(tree) < LONG else _places)(tree, template):
        if len(at) == 1:
            seen.add((key, path, ALONE, of[at[0]]))
        else:
            seen.add((key, path, RUN, _signed(xxhash.xxh3_64_intdigest(b"".join(prints[8 * i : 8 * i + 8] for i in at)))))
            seen.update((key, path, MEMBER, of[i]) for i in at)
    yield from sorted(seen)


def observe(html: str, host: str, template: str) -> Iterator[tuple[int, int, int, int]]:
    """(slot, path, what, print) of the page's nodes; each once."""
    _, tree, prints = outline(html, host)
    return observed(tree, prints, template)


# --- extraction ----------------------------------------------------------------------------


def known_of(tree: Node, template: str, verdict: str) -> set[int]:
    """ids of the page's elements that are constant."""
    fixed, shared = _verdict(verdict)
    return {id(m) for key, _, members in align(tree, _loaded(template)) for m in members if key in fixed or (key, _signed(m.print)) in shared}


def _measures(tree: Node, rules: Rules) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Of each element: the characters of its wanted text; and, unwanted ones too, how many are in links and how many there are."""
    order = [(tree, False)]
    for node, linked in order:
        order.extend((k, linked or k.tag == "a") for k in node.nodes())
    sizes: dict[int, int] = {}
    links: dict[int, tuple[int, int]] = {}
    for node, linked in reversed(order):
        size = within = whole = 0
        for p in node.parts:
            if isinstance(p, str):
                n = len("".join(p.split()))
                size, whole, within = size + n, whole + n, within + n * (linked or node.tag == "a")
            else:
                a, b = links[id(p)]
                within, whole = within + a, whole + b
                if not rules.unwanted(p, False):
                    size += sizes[id(p)]
        sizes[id(node)], links[id(node)] = size, (within, whole)
    return sizes, links


def _holders(tree: Node, rules: Rules) -> list[Node]:
    """All ``article`` elements that are not in another, else the ``main`` elements; those with text."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(tree, False, False)]
    while todo:
        x, in_article, in_main = todo.pop()
        if x.tag != "#root" and rules.unwanted(x, True):
            continue
        is_main = x.tag == "main" or "main" in x.marks
        if x.tag == "article" and not in_article:
            found["article"].append(x)
        elif is_main and not in_main:
            found["main"].append(x)
        todo.extend((k, in_article or x.tag == "article", in_main or is_main) for k in reversed(x.nodes()))
    for kind in ("article", "main"):
        if kept := [x for x in found[kind] if blocks(x, rules)]:
            return kept
    return []


def _by_words(tree: Node, rules: Rules) -> list[str]:
    """The blocks of the article of a page without a constant."""
    if not rules.words:
        return blocks(tree, rules, False)
    if holders := _holders(tree, rules):
        return blocks(holders, rules)
    sizes, links = _measures(tree, rules)
    node = tree
    todo: list[Node] = []
    while True:  # what holds nearly all of the text is no box of links; what stands beside it may be
        whole = sizes[id(node)]
        heavy = [k for k in node.nodes() if k.tag not in INLINE and not rules.unwanted(k, False) and sizes[id(k)] * 10 >= whole * 9]
        if not heavy or not whole or heavy[0].tag in ("p", "h1", "h2", "h3", "li"):
            break
        todo += [k for k in node.nodes() if k is not heavy[0]]
        node = heavy[0]
    todo += node.nodes()
    skip = set(rules.constant)
    while todo:  # lists and boxes of links are menus
        x = todo.pop()
        linked, whole = links[id(x)]
        if x.tag in ("ul", "ol", "div", "table", "section") and whole and linked * 10 >= whole * 6:
            skip.add(id(x))
        else:
            todo.extend(x.nodes())
    return blocks(tree, Rules(skip), False)


def _hollow(tree: Node, left: list[str], constant: set[int], words: bool) -> bool:
    """Whether constants leave less than 1 / LEFT of the page's text, or of its ``article`` elements where these hold most of it: a copy of other pages."""
    whole, kept = sum(map(len, blocks(tree, Rules(words=False)))), sum(map(len, left))
    if kept * LEFT < whole:
        return True
    if not words or not (holders := _holders(tree, Rules(words=False))):
        return False
    own = sum(map(len, blocks(holders, Rules(words=False))))
    outside = sum(map(len, blocks(tree, Rules(constant | {id(x) for x in holders}, words), False)))
    return own * 2 >= whole and (kept - outside) * LEFT < own


def extract(html: str | None, template: str | None = None, verdict: str | None = None, host: str = "", words: bool = True) -> str:
    """The main text of a page. words: whether tags and class words may break ties."""
    if not html:
        return ""
    tree = parse(html)
    if template and verdict:
        survey(tree, host)
        constant = known_of(tree, template, verdict)
        left = blocks(tree, Rules(constant, words), False) if constant else []
        if left and not _hollow(tree, left, constant, words):
            return "\n".join(left)
    return "\n".join(_by_words(tree, Rules(words=words)))


# --- on tables --------------------------------------------------------------------------------


OUTLINE = "host string, hk long, h long, kind string, tree string, prints binary"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 128):
        pages, hosts, keys, hashes = columns(batch, "html", "host", "hk", "h")
        rows = [outline(p.as_py(), n) for p, n in zip(pages, hosts.to_pylist())]
        made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.binary()))]
        yield pa.record_batch([hosts, keys, hashes, *made], names=["host", "hk", "h", "kind", "tree", "prints"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One template for each host and salt, whose kinds of pages (or else templates) come one after the other."""
    now, root = None, Slot("#root")

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], t) for x, t in zip((*now, _written(root)), (pa.string(), pa.int64(), pa.string()))], names=["host", "salt", "template"])

    for batch in batches:
        hosts, salts, texts, whole = columns(batch, "host", "salt", "text", "whole")
        for host, salt, text, is_template in zip(hosts.to_pylist(), salts.to_pylist(), texts, whole.to_pylist()):
            if (host, salt) != now:
                if now is not None:
                    yield done()
                now, root = (host, salt), Slot("#root")
            _merge(root, _read(text.as_py()) if is_template else _unflat(text.as_py())[0])
    if now is not None:
        yield done()


FACT = ("hk", "slot", "path", "what", "print", "h")


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 128):
        trees, prints, keys, hashes, templates = columns(batch, "tree", "prints", "hk", "h", "template")
        rows = [(k, *r, h) for t, p, k, h, made in zip(trees, prints, keys.to_pylist(), hashes.to_pylist(), templates) for r in observed(t.as_py(), p.as_py(), made.as_py())]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=list(FACT))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 128):
        ids, urls, pages, hosts, templates, verdicts = columns(batch, "page_id", "url", "html", "host", "template", "verdict")
        texts = [extract(p.as_py(), t.as_py(), v.as_py(), n.as_py()) for p, n, t, v in zip(pages, hosts, templates, verdicts)]
        yield pa.record_batch([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def outlines(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """The outline of every page. pages: host, html, hk and h (hashes of host and html)."""
    return shelf.put(pages.select("host", "html", "hk", "h").mapInArrow(_outline, OUTLINE))


def templates(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """host, template of every host, from all of its pages. pages: outlines, or host, html, h (a hash of html)."""
    if "kind" not in pages.columns:
        pages = outlines(pages.withColumn("hk", F.xxhash64("host")), shelf)
    kinds = pages.select("host", "kind").distinct().select("host", F.pmod(F.xxhash64("kind"), F.lit(SALTS)).alias("salt"), F.col("kind").alias("text"))

    def merged(rows: DataFrame, whole: bool) -> DataFrame:
        ordered = rows.withColumn("whole", F.lit(whole)).repartition("host", "salt").sortWithinPartitions("host", "salt", "text")
        return ordered.mapInArrow(_induce, "host string, salt long, template string")

    parts = shelf.put(merged(kinds, False))
    return merged(parts.select("host", F.lit(0).cast("long").alias("salt"), F.col("template").alias("text")), True).select("host", "template")


def evidence(facts: DataFrame, shelf: Shelf) -> DataFrame:
    """hk, verdict (JSON) of every host that has one, from the rows of ``observe`` of all pages."""
    texts = shelf.put(facts.distinct().groupBy("hk", "slot", "path", "what", "print").agg(F.count("*").alias("c")))
    # summed before the shuffle and joined back: a menu that all hosts of one software share is a row for each of them
    everywhere = texts.groupBy("path", "print").agg(F.sum("c").alias("everywhere"))
    texts = texts.join(everywhere, ["path", "print"])
    c, everywhere = F.col("c"), F.col("everywhere")

    def one(of: Column) -> Column:
        return F.struct(of.alias("print"), c.alias("n"), F.when(everywhere > 1, c).otherwise(0).alias("recurring"), (c / everywhere).alias("different"), everywhere.alias("everywhere"))

    of_slot = F.when(F.col("what") != MEMBER, one(F.lit(None).cast("long")))
    of_text = F.when((F.col("what") != RUN) & (everywhere >= ENOUGH), one(F.col("print")))
    each = texts.select("hk", "slot", "path", F.explode(F.array_compact(F.array(of_slot, of_text))).alias("f")).select("hk", "slot", "path", "f.*")
    counted = shelf.put(each.groupBy("hk", "slot", "path", "print").agg(F.sum("n").alias("n"), F.sum("recurring").alias("recurring"), F.sum("different").alias("different"), F.max("everywhere").alias("everywhere")))
    slots = counted.filter(F.col("print").isNull()).select("hk", "slot", "path", "n", "recurring", "different")
    pool = slots.groupBy("path").agg(F.sum("n").alias("all_n"), F.sum("recurring").alias("all_recurring"), F.sum("different").alias("all_different"))

    def estimate(own: str, whole: str) -> Column:
        return (F.col(own) + PRIOR * F.col(whole) / F.col("all_n")) / (F.col("n") + PRIOR)

    judged = slots.join(pool, "path").select(
        "hk", "slot", "path", "n", "all_n",
        ((estimate("recurring", "all_recurring") >= RECUR) & (estimate("different", "all_different") <= FEW)).alias("constant"),
    )
    judged = shelf.put(judged)
    of_texts = counted.filter(F.col("print").isNotNull()).select("hk", "slot", "print", F.col("n").alias("c"), "everywhere")
    shared = of_texts.join(judged.filter("not constant"), ["hk", "slot"]).filter((F.col("c") + PRIOR * F.col("everywhere") / F.col("all_n")) / (F.col("n") + PRIOR) >= SHARED)
    rows = judged.filter("constant").select("hk", "slot", F.lit(None).cast("long").alias("print")).unionByName(shared.select("hk", "slot", "print"))
    constant = F.sort_array(F.collect_list(F.when(F.col("print").isNull(), F.col("slot")))).alias("constant")
    texts_of = F.sort_array(F.collect_list(F.when(F.col("print").isNotNull(), F.struct("slot", "print")))).alias("shared")
    lists = rows.groupBy("hk").agg(constant, texts_of)  # no longer than the host's template
    return lists.select("hk", F.to_json(F.struct("constant", "shared")).alias("verdict"))


def wrappers(keyed: DataFrame, shelf: Shelf) -> DataFrame:
    """host, template, verdict of every host whose evidence gives one. keyed: host, html, hk and h (hashes of host and html)."""
    seen = outlines(keyed, shelf)
    made = shelf.put(templates(seen, shelf))  # as a table its size is known: a small one is broadcast and no page is moved
    facts = seen.select("host", "hk", "h", "tree", "prints").join(made, "host").mapInArrow(_observe, "hk long, slot long, path long, what int, print long, h long")
    verdicts = shelf.put(evidence(facts, shelf))
    return shelf.put(made.withColumn("hk", F.xxhash64("host")).join(verdicts, "hk").select("host", "template", "verdict"))


def main_text(pages: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row of ``pages`` (page_id, url, html)."""
    host, _ = host_and_path(F.coalesce("url", F.lit("")))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    keyed = keyed.withColumn("hk", F.xxhash64("host")).withColumn("h", F.xxhash64(F.lit(0), "html"))
    shelf = Shelf(pages.sparkSession, "wrapper")
    joined = keyed.select("page_id", "url", "html", "host").join(wrappers(keyed, shelf), "host", "left")
    return joined.mapInArrow(_extract, SCHEMA)
