"""HTML as flat text blocks: what stands between two block-level tags, with the figures that tell main text from the rest.

Tags are read one by one, with quoted values, comments and elements without text of their own (scripts, styles, ...) skipped as browsers do, in time linear in the page. A block
knows its words, how many of them are links, its heading level, and what its ancestors say they are by their tag, role, class or id.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

_NAME, _QUOTE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+")
#: Fixed values of HTML: elements that part blocks; those whose text is none of the page's; those that are never closed.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math select object canvas audio video datalist button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these kinds above the next container.
_ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}
_BOXES = frozenset("address article aside blockquote body center details dialog div fieldset figure footer form header main nav section td th".split())
#: What elements say they are.
MAIN_TAGS, OTHER_TAGS = frozenset(("article", "main")), frozenset("nav header footer aside form menu dialog".split())
MAIN_ROLES, OTHER_ROLES = frozenset(("main", "article")), frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status form".split())
MAIN_WORDS, TITLE_WORDS = frozenset("article content post entry story main prose".split()), frozenset(("header", "head"))
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pager pagination
    sidebar side aside rail widget widgets related recommended recommendations trending popular more share sharing social follow tags meta byline comment comments commentlist reply replies respond discussion disqus
    cookie cookies consent gdpr notice notices notification alert warning disclaimer newsletter subscribe subscription signup login search popup modal overlay toast
    header head masthead topbar footer foot bottom copyright legal credits form skip print toolbar hidden""".split()
)
FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "heading", "inner", "in_main", "in_other", "box_words", "box_links", "box_share")
#: A class or id can't make an element with more of the page's words, and with its title or <main>, a part that is not main text.
WRAPPER_SHARE = 0.5


class Element:
    """An open element: where it stands, and what it says it is (1 main text, -1 something else)."""

    __slots__ = ("box", "by_name", "inside", "kind", "name", "parent", "title", "words")

    def __init__(self, name: str, kind: int, by_name: bool, parent: Element | None):
        self.name, self.kind, self.by_name, self.parent = name, kind, by_name, parent
        self.words, self.title, self.inside = 0, name == "main", name in MAIN_TAGS or parent is not None and parent.inside
        if name == "header" and self.inside:  # an article's own
            self.kind = 0
        self.box = self if parent is None or self.kind or name in _BOXES else parent.box


ROOT = "#page"


def kind_of(name: str, attributes: str) -> tuple[int, bool]:
    """What an element says it is, and whether its tag or role, rather than a class or id, says so."""
    if name in OTHER_TAGS:
        return -1, True
    kind = 1 if name in MAIN_TAGS else 0
    if not attributes or attributes.isspace():
        return kind, bool(kind)
    said: set[str] = set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            return -1, True
        if key == "role" and (role := value.strip().lower()) in MAIN_ROLES | OTHER_ROLES:
            return (-1 if role in OTHER_ROLES else 1), True
        if key == "class" or key == "id":
            said.update(w.lower() for w in _WORDS.findall(value))
    if name in ("html", "body"):
        return 0, False
    if other := said & OTHER_WORDS:
        return (0, False) if other <= TITLE_WORDS and said & MAIN_WORDS else (-1, False)  # "article-header" is where the title stands
    return (1, bool(kind)) if kind or said & MAIN_WORDS and name not in ("p", "a") else (0, False)


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends the tag, one inside a quoted value not counting; -1 if there is none."""
    while True:
        end = page.find(">", at)
        quote = _QUOTE.search(page, at, end) if end >= 0 else None
        if quote is None:
            return end
        close = page.find(quote[1], quote.end())
        if close < 0:
            return end
        at = close + 1


class Blocks:
    """The blocks of one page in order."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.words: list[int] = []
        self.linked: list[int] = []
        self.heading: list[int] = []
        self.owner: list[Element] = []
        self._pieces: list[str] = []
        self._linked, self._link, self._heading = 0, None, 0
        self._stack = [Element(ROOT, 0, False, None)]
        self._open_names: Counter = Counter()
        self._never: set[str] = set()
        self._read(page)

    def _end_block(self) -> None:
        if self._pieces:
            found = "".join(self._pieces).split()
            if found:
                element = self._stack[-1]
                self.texts.append(" ".join(found))
                self.words.append(len(found))
                self.linked.append(min(self._linked, len(found)))
                self.heading.append(self._heading)
                self.owner.append(element)
                element.words += len(found)
            self._pieces, self._linked = [], 0

    def _say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._pieces.append(text)
        if self._link is not None:
            self._linked += len(text.split())

    def _pop(self) -> None:
        gone = self._stack.pop()
        self._open_names[gone.name] -= 1
        self._stack[-1].words += gone.words
        self._stack[-1].title |= gone.title
        if self._link is not None and len(self._stack) < self._link:
            self._link = None

    def _open(self, name: str, attributes: str) -> None:
        if name == "a":
            self._link = len(self._stack)
        elif name in BLOCK_TAGS:
            self._end_block()
            ended = _ENDED_BY.get(name, ("p",))
            while self._stack[-1].name in ended:
                self._pop()
            self._heading = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0
            if name == "h1":
                self._stack[-1].title = True
            if name not in VOID_TAGS:
                self._stack.append(Element(name, *kind_of(name, attributes), self._stack[-1]))
                self._open_names[name] += 1

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = None
        elif name in BLOCK_TAGS:
            self._end_block()
            self._heading = 0
            if self._open_names[name]:
                while self._stack[-1].name != name:
                    self._pop()
                self._pop()

    def _skip(self, page: str, name: str, at: int) -> int:
        """Past the end tag of an element whose text is none of the page's; an unclosed script or style runs to the end, another is only a tag."""
        found = None if name in self._never else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
        if found is None:
            self._never.add(name)
            return len(page) if name in ("script", "style") else at
        end = page.find(">", found.end())
        return len(page) if end < 0 else end + 1

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                self._say(page[at:])
                break
            if mark > at:
                self._say(page[at:mark])
            following = page[mark + 1 : mark + 2]
            if following == "!" or following == "?":
                if page.startswith("<!--", mark):
                    end = page.find("-->", mark + 2 if page.startswith(("<!-->", "<!--->"), mark) else mark + 4)
                    at = size if end < 0 else end + 3
                else:
                    end = page.find(">", mark)
                    at = size if end < 0 else end + 1
                continue
            closing = following == "/"
            named = _NAME.match(page, mark + 1 + closing)
            if named is None:  # no tag
                if closing:
                    end = page.find(">", mark)
                    at = size if end < 0 else end + 1
                else:
                    self._say("<")
                    at = mark + 1
                continue
            name = named[0].lower()
            end = _tag_end(page, named.end())
            if end < 0:
                break
            at = end + 1
            if closing:
                self._close(name)
            elif name == "br":
                self._pieces.append(" ")
            elif name in SILENT_TAGS:
                if page[end - 1] != "/" or name not in ("svg", "math"):
                    at = self._skip(page, name, at)
            else:
                self._open(name, page[named.end() : end])
        self._end_block()
        while len(self._stack) > 1:
            self._pop()

    def features(self) -> np.ndarray:
        """(blocks, FEATURES)."""
        n = len(self.texts)
        out = np.zeros((n, len(FEATURES)))
        if not n:
            return out
        words, links = np.array(self.words, float), np.array(self.linked, float)
        total = words.sum()
        said: dict[int, tuple[int, int, int]] = {}

        def says(e: Element) -> tuple[int, int, int]:
            """The innermost kind, and whether there is a main ancestor and another."""
            chain = []
            while e is not None and id(e) not in said:
                chain.append(e)
                e = e.parent
            got = said[id(e)] if e is not None else (0, 0, 0)
            for e in reversed(chain):
                kind = e.kind
                if kind < 0 and not e.by_name and e.title and e.words > WRAPPER_SHARE * total:
                    kind = 0
                got = (kind or got[0], got[1] or int(kind > 0), got[2] or int(kind < 0))
                said[id(e)] = got
            return got

        boxes: dict[int, int] = {}
        box = np.array([boxes.setdefault(id(e.box), len(boxes)) for e in self.owner])
        box_words, box_links = np.bincount(box, words)[box], np.bincount(box, links)[box]
        density = links / words
        out[:, 1], out[:, 4] = words, density
        out[1:, 0], out[:-1, 2], out[1:, 3], out[:-1, 5] = words[:-1], words[1:], density[:-1], density[1:]
        out[:, 6] = self.heading
        out[:, 7:10] = [says(e) for e in self.owner]
        out[:, 10], out[:, 11], out[:, 12] = box_words, box_links / box_words, box_words / total
        return out
