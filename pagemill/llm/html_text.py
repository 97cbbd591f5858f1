"""Main text of web pages by tree scoring.

The markup is read once into a tree of block elements, in time linear in its length whatever the nesting. Boilerplate
(menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) is known by its
tag, role, or a name of its class or id, and is left out with all in it, inline elements too. A name is read as a
compound: its last word must mark it (`site-sidebar`), words that only say which part it is aside (`sidebar-left`), so
`social-science` marks nothing. A wrapper that holds the main element, or most of the text where little stands outside
of it, is no boilerplate; nor is one that a word marks only weakly if it holds paragraphs that are not links.

Every paragraph passes points for its length and its commas to its ancestors, all to the container, half to the next, a
third and less to those above, up to SHARED; a container's sum is discounted by its link density. The container with
the most points is the main one, or the one around it where its neighbours score as well; the article or main element
around it, if there is one, stands for it, and siblings that score well are kept with it; without one, all siblings that
are not mostly links are, but loose divisions of the page itself without a paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

# Element names of the HTML standard, and the words that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
DROPPED = frozenset("nav footer aside form menu dialog template svg math button select datalist object audio video canvas map head fieldset search".split())
#: Never text of a page, whatever they hold; and those that only an article or main element in them brings back.
UNREAD = frozenset("dialog template svg math button select datalist object audio video canvas map head".split())
SIDE = frozenset("nav footer menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
MARKS = frozenset(
    "ad ads adbox adslot adsbygoogle advert advertisement advertisements advertising adverts sponsor sponsored sponsors promo promos promoted banner banners cookie cookies consent gdpr "
    "notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup signin login paywall recommendations recirculation sidebar sidebars rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager paging footer foot header masthead topbar toolbar comment comments commentlist reply replies respond disqus widget widgets outbrain taboola "
    "tagcloud copyright".split()
)
#: These mark alone, or with parts only, and not what holds paragraphs.
WEAK = frozenset("social follow related recommended share shares sharing tags skip discussion feedback toc promotion register".split())
#: Words that say which part, place or size something is.
PARTS = frozenset(
    "item items link links list lists bar box block area section wrapper wrap container inner outer content body form button buttons btn icon icons panel pane row col column left right top bottom "
    "main primary secondary mobile desktop slot unit zone label title heading text message msg post posts article articles story stories us info toggle trail holder group module feed media count "
    "meta field input center sticky fixed fluid large small to the this on for".split()
)
#: A header after these belongs to the text.
OF_TEXT = frozenset("entry article post story section content recipe chapter".split())
#: Words of these never mark a wrapper of the whole page.
ASIDE = frozenset("cookie cookies consent gdpr comment comments commentlist reply replies respond disqus hidden outbrain taboola".split())
#: Ancestors that a paragraph's points reach.
SHARED = 8
NOT_A_MARK_AFTER = frozenset("has with no without is".split())
SELF_CLOSING_GROUPS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "items", "marked", "weak", "aside", "dropped", "unread", "mains", "points", "chars", "linked", "near")

    def __init__(self, tag: str, parent: Node | None, mark: str = "", aside: bool = False):
        self.tag, self.parent, self.marked, self.weak, self.aside = tag, parent, bool(mark), mark == "weak", aside
        self.dropped = False
        self.unread = tag in UNREAD or parent is not None and parent.unread
        self.mains = (0 if parent is None else parent.mains) | (tag == "article") | 2 * (tag == "main")
        self.items: list[Node | str] = []  # children and the text blocks between them
        self.points = 0.0
        self.chars = self.linked = 0
        self.near: Node | None = None  # the nearest marked element around it, itself included


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", "")


def _names(attributes: dict[str, str]) -> Iterator[list[str]]:
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            yield _WORDS.findall(_CAMEL.sub(" ", name).lower())


def _named(words: list[str], inside: bool) -> str:
    """Whether a name marks boilerplate: "yes", "weak" or "". inside: it stands in an article or main element."""
    if words == ["hidden"]:
        return "yes"
    k = len(words) - 1
    while k > 0 and words[k] in PARTS:
        k -= 1
    if k < 0:
        return ""
    head, before = words[k], words[:k]
    if before and before[-1] in NOT_A_MARK_AFTER:
        return ""
    if head in ("header", "head") and (inside or before and before[-1] in OF_TEXT):
        return ""
    if head in MARKS:
        return "yes"
    return "weak" if head in WEAK and all(w in PARTS or w in MARKS or w in WEAK for w in before) else ""


def boilerplate(tag: str, attributes: dict[str, str], inside: bool) -> str:
    """Whether an element and all in it is boilerplate: "yes", "weak" or ""."""
    if tag in DROPPED or tag == "header" and not inside:
        return "yes"
    if tag in ("html", "body", "main", "article") or not attributes:
        return ""
    if attributes.get("role", "").strip().lower() in ROLES or _is_hidden(attributes):
        return "yes"
    found = {_named(words, inside) for words in _names(attributes)}
    return "yes" if "yes" in found else "weak" if "weak" in found else ""


def _is_aside(attributes: dict[str, str]) -> bool:
    """Whether a boilerplate element is hidden, a notice or reader comments, and so no wrapper of a page."""
    return _is_hidden(attributes) or any(not ASIDE.isdisjoint(words) for words in _names(attributes))


class Tree:
    """Reads a page; a missing end tag ends with its parent, a page that breaks off ends there."""

    def __init__(self, page: str):
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]
        self.text: list[str] = []
        self.link_chars = 0
        self.in_link = False
        self.inside = self.verbatim = 0
        self.left_out: list[str] = []  # open inline elements from one that is boilerplate on
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[Node, str, int]] = []
        self.links: dict[tuple[int, int], int] = {}  # by node and place in its items: a text block's characters in links
        self._read(page)
        self._flush()
        if any(node.marked for node in self.nodes):
            self._settle()
            self.blocks = [x for x in self.blocks if not x[0].dropped]

    def _data(self, text: str) -> None:
        if not self.at.unread and not self.left_out:
            if "&" in text:
                text = unescape(text)
            self.text.append(text)
            if self.in_link:
                self.link_chars += len("".join(text.split()))

    def _flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                if self.link_chars:
                    self.links[id(self.at), len(self.at.items)] = self.link_chars
                self.at.items.append(block)
                self.blocks.append((self.at, block, self.link_chars))
            self.text = []
        self.link_chars = 0

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        self._flush()
        if tag == "p" or tag in BLOCKS:
            if self.at.tag == "p":
                self._leave(self.at)
        if (group := SELF_CLOSING_GROUPS.get(tag)) is not None:
            ends, stops = group[0].split(), group[1]
            node, found = self.at, None
            while node is not None and node.tag not in stops:
                if node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                self._leave(found)
        elif tag in _HEADINGS and self.at.tag in _HEADINGS:
            self._leave(self.at)
        if tag in ("html", "body"):
            return
        mark = "yes" if self.left_out else boilerplate(tag, attributes, self.inside > 0)
        self.open[tag] += 1
        node = Node(tag, self.at, mark, bool(mark) and (bool(self.left_out) or _is_aside(attributes)))
        self.at.items.append(node)
        self.nodes.append(node)
        self.at = node
        self.verbatim += tag == "pre"
        if tag in _MAIN:
            self.inside += 1
        self.in_link = False

    def _leave(self, node: Node) -> None:
        """Ends node and all open elements in it."""
        self._flush()
        while True:
            if self.at.tag in _MAIN:
                self.inside -= 1
            at, self.at = self.at, self.at.parent
            self.open[at.tag] -= 1
            self.verbatim -= at.tag == "pre"
            if at is node:
                break
        self.in_link = False
        if self.left_out and not self.at.marked:
            self.left_out = []

    def _close(self, tag: str) -> None:
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._leave(node)
        elif tag == "p" or tag == "br":
            self._flush()

    def _inline(self, tag: str, attributes: dict[str, str]) -> None:
        if self.left_out:
            self.left_out.append(tag)
        elif attributes and (_is_hidden(attributes) if self.verbatim else boilerplate(tag, attributes, True) == "yes"):
            self.left_out = [tag]
        elif tag == "a":
            self.in_link = True

    def _end_inline(self, tag: str) -> None:
        if self.left_out:
            if tag in self.left_out:
                while self.left_out.pop() != tag:
                    pass
        elif tag == "a":
            self.in_link = False

    def _settle(self) -> None:
        """Takes marks off elements that are no boilerplate by what they hold; then all in a marked one is dropped.

        Those are weakly marked ones with paragraphs, and those that hold the page's main element, or most of its text
        where little is left outside: from the outermost inwards, as long as it is so.
        """
        for node, block, linked in self.blocks:
            node.chars += len(block)
            node.linked += linked
            node.points += _points(block, linked) if node.tag in _ITEMS else 0.0
        for node in reversed(self.nodes):
            if node.weak and node.points >= 10 and node.linked < node.chars / 4:
                node.marked = False
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
                node.parent.points += node.points
        inner: dict[int, list[Node]] = {}  # marked elements by the marked one around them
        for node in self.nodes:
            around = None if node.parent is None else node.parent.near
            node.near = node if node.marked else around
            if node.marked:
                inner.setdefault(id(around), []).append(node)
        own: dict[int, float] = {}  # points, and whether there is a main element, outside of inner marked ones
        main: dict[int, bool] = {}
        kinds: dict[int, int] = {}  # article and main elements around or in it
        for node, block, linked in self.blocks:
            k = id(node.near)
            own[k] = own.get(k, 0.0) + (_points(block, linked) if node.tag in _ITEMS else 0.0)
            main[k] = main.get(k, False) or node.mains > 0
            kinds[k] = kinds.get(k, 0) | node.mains
        for node in reversed(self.nodes):
            if node.marked and node.parent is not None and node.parent.near is not None:
                k = id(node.parent.near)
                kinds[k] = kinds.get(k, 0) | kinds.get(id(node), 0)
        nothing = id(None)
        total, outside, found = self.root.points, own.get(nothing, 0.0), main.get(nothing, False)

        def is_wrapper(node: Node) -> bool:
            most = outside < total / 5 and node.points > total / 2
            within = kinds.get(id(node), 0)
            return not node.aside and (within & 2 > 0 or most and (node.tag not in SIDE or within > 0))

        waiting = [x for x in reversed(inner.get(nothing, ())) if is_wrapper(x)]
        while waiting and not found:
            node = waiting.pop()
            if is_wrapper(node):
                node.marked = False
                outside += own.get(id(node), 0.0)
                found = main.get(id(node), False)
                waiting += [x for x in reversed(inner.get(id(node), ())) if is_wrapper(x)]
        for node in self.nodes:
            node.dropped = node.marked or node.parent is not None and node.parent.dropped
            node.points, node.chars, node.linked = 0.0, 0, 0

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self._data(page[at:])
                return
            if lt > at:
                self._data(page[at:lt])
            m = _TAG.match(page, lt)
            if m is None:
                if page.startswith("<!--", lt):
                    if page.startswith((">", "->"), lt + 4):
                        at = page.find(">", lt) + 1
                    else:
                        end = page.find("-->", lt + 4)
                        at = end + 3 if end >= 0 else n
                elif page.startswith(("<!", "<?", "</"), lt):
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:
                    self._data("<")
                    at = lt + 1
                continue
            tag = m[2].lower()
            attributes: dict[str, str] = {}
            at = m.end()
            while at < n and page[at] != ">":
                a = _ATTRIBUTE.match(page, at)
                if a.end() == at:
                    at += 1
                    continue
                if a[1]:
                    attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
                at = a.end()
            at += 1
            if m[1]:
                if tag in BLOCKS or tag in DROPPED or tag == "br":
                    self._close(tag)
                else:
                    self._end_inline(tag)
            elif tag in RAW:
                end = _ENDS[tag].search(page, at)
                if end is None:
                    return
                gt = page.find(">", end.end())
                at = gt + 1 if gt >= 0 else n
            elif tag in VOID:
                if tag == "br":
                    self._data(" ")
                elif tag == "hr":
                    self._flush()
                    if self.at.tag == "p":
                        self._leave(self.at)
            elif tag in BLOCKS or tag in DROPPED:
                self._open(tag, attributes)
            else:
                self._inline(tag, attributes)


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_MAIN = frozenset(("article", "main"))
_ITEMS = frozenset(("p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main", "html", "figcaption", "center", "address", "th", "dt", "details"))


def _points(block: str, linked: int) -> float:
    return (1 + block.count(",") + min(len(block) / 100, 3)) * (1 - min(1, linked / len(block)))


def _share(node: Node | None, points: float) -> None:
    for level in range(SHARED):
        if node is None:
            return
        node.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
        node = node.parent


def _walk(node: Node, out: list[str]) -> None:
    """Text blocks of a container in page order, boilerplate left out."""
    stack = [iter((node,))]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                out.append(item)
            elif not item.dropped:
                stack.append(iter(item.items))
                break
        else:
            stack.pop()


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by a line feed; empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    if not tree.blocks:
        return ""
    own: dict[int, float] = {}  # points of a container's paragraphs, whatever the level
    for node, block, linked in tree.blocks:
        node.chars += len(block)
        node.linked += linked
        if node.tag in _ITEMS:
            points = _points(block, linked)
            own[id(node)] = own.get(id(node), 0.0) + points
            _share(node if node.tag in ("div", "section", "article", "main", "html") else node.parent, points)
    for node in reversed(tree.nodes):
        if node.parent is not None and not node.dropped:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            own[id(node.parent)] = own.get(id(node.parent), 0.0) + own.get(id(node), 0.0)
    best, most = tree.root, -1.0
    for node in tree.nodes:
        if node.chars and not node.dropped and node.tag not in ("p", "li", "pre", "td", "th", "tr", "dd", "dt", "ul", "ol"):
            points = node.points * (1 - min(1, node.linked / node.chars))
            if node.tag in _MAIN:
                points = points * 2 + 5
            if points > most:
                best, most = node, points
    up, main = best, None
    while up is not None:  # an article's heading may stand beside the container with its paragraphs
        if up.tag in _MAIN:
            main = up
        up = up.parent
    path = [main or best]
    while main is None and path[-1].parent is not None:
        around = path[-1].parent
        path.append(around)
        inner, outer = own.get(id(path[-2]), 0.0), own.get(id(around), 0.0)
        if outer - inner < inner / 5 or around.linked >= around.chars / 4:
            break  # the neighbours are kept if they are like text, but they don't make this the main container
    if main is not None and main.parent is not None:
        path.append(main.parent)
    before: list[list[str]] = []
    middle: list[str] = []
    after: list[str] = []
    _walk(path[0], middle)
    for item, around in zip(path, path[1:], strict=False):
        first, last = _beside(tree, item, around, own)
        before.append(first)
        after += last
    return "\n".join([x for part in reversed(before) for x in part] + middle + after)


def _beside(tree: Tree, chosen: Node, around: Node, own: dict[int, float]) -> tuple[list[str], list[str]]:
    """Text before and after the chosen container in the one around it that belongs to it."""
    parts: tuple[list[str], list[str]] = ([], [])
    least, side = max(10.0, 0.2 * own.get(id(chosen), 0.0)), 0
    for k, item in enumerate(around.items):
        if item is chosen:
            side = 1
        elif isinstance(item, str):
            if chosen.tag not in _MAIN and tree.links.get((id(around), k), 0) / len(item) < 0.25:
                parts[side].append(item)
        elif not item.dropped and item.chars:
            density, points = item.linked / item.chars, own.get(id(item), 0.0)
            if chosen.tag in _MAIN:
                keep = item.tag not in ("ul", "ol", "table") and points * (1 - density) >= least
            else:
                loose = around.parent is None and item.tag in ("div", "section", "center") and points < 2
                keep = item.tag in _HEADINGS or density < 0.25 and not loose
            if keep:
                _walk(item, parts[side])
    return parts


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, repeated rows each, with no shuffle.

    A null or empty html has the empty text. Null ids and urls are passed on; other columns are ignored.
    """
    source = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html", 4 << 20):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    fields = source.schema.fields
    return source.mapInArrow(run, f"page_id {fields[0].dataType.simpleString()}, url {fields[1].dataType.simpleString()}, text string, n_chars bigint")
