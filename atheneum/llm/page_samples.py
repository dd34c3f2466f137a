"""A small labelled table of blocks: pages made by rule in the usual layouts, in which each block is known to be main text or not.

The words carry no meaning (``m`` marks main text, ``b`` the rest) and are no feature; what varies is what pages vary in: semantic tags, class names or neither, long and very
short paragraphs, links inside the text, and menus, notices, adverts, forms, asides and comments around and within it.
"""

from __future__ import annotations

from random import Random

from .html_blocks import FEATURES, Blocks

PAGES, SEED = 400, 11
#: Elements around a whole page.
WRAPPERS = ('div id="content"', 'div class="main-wrapper"', 'div class="layout-sidebar"', "div")
#: How pages of several kinds name their parts; None is a plain div.
STYLES = (
    {"top": "header", "menu": "nav", "text": "article", "side": "aside", "comments": 'section class="comments"', "end": "footer", "notice": 'div class="cookie-notice"', "ad": 'div class="ad"'},
    {"top": "header", "menu": "nav", "text": "main", "side": 'div class="sidebar"', "comments": 'div id="comments"', "end": "footer", "notice": 'div role="alert"', "ad": 'div class="advert"'},
    {"top": 'div id="header"', "menu": 'div class="menu"', "text": 'div class="content"', "side": 'div class="related"', "comments": 'div class="replies"', "end": 'div id="footer"', "notice": 'div class="notice"', "ad": 'div class="sponsored"'},
    {"top": 'div class="masthead"', "menu": 'ul class="navbar"', "text": 'div class="entry"', "side": 'div class="widget"', "comments": 'section id="discussion"', "end": 'div class="copyright"', "notice": 'div class="newsletter"', "ad": 'div class="promo"'},
    dict.fromkeys(("top", "menu", "text", "side", "end", "notice", "ad"), "div"),
)


def _element(tag: str, inner: str) -> str:
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def sample_page(rng: Random, style: dict[str, str]) -> str:
    """One page; parts that the style has no name for are left out."""

    def words(mark: str, least: int, most: int) -> str:
        return " ".join([mark] * rng.randint(least, most))

    def links(n: int, tag: str = "li") -> str:
        inner = "".join(_element(tag, f'<a href="x">{words("b", 1, 4)}</a>') for _ in range(n))
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def paragraph() -> str:
        n = rng.choice((2, 6, 15, 40, 80, 160))
        text = words("m", max(1, n // 2), n)
        return _element("p", f'{text} <a href="x">m m</a> {text}' if rng.random() < 0.25 else text)

    def piece() -> str:
        kind = rng.random()
        if kind < 0.72:
            return paragraph()
        if kind < 0.8:
            return _element(rng.choice(("h2", "h3")), words("m", 1, 8))
        if kind < 0.86:
            return _element("ul", "".join(_element("li", words("m", 2, 15)) for _ in range(rng.randint(2, 6))))
        if kind < 0.9:
            return _element("blockquote", _element("p", words("m", 5, 40)))
        if style["ad"] == "div":
            return paragraph()
        return _element(*rng.choice(((style["ad"], words("b", 2, 40)), (style["menu"], links(4)), (style["side"], _element("p", words("b", 5, 40))), ("form", _element("label", words("b", 1, 5))))))

    rest = rng.random
    short = style["top"] == "div"  # where nothing is named, the rest is short or made of links
    pieces = [piece() for _ in range(rng.choice((0, 1, 3, 8, 20)))] + [_element("p", words("m", 30, 120))]
    if rest() < 0.2:
        pieces = [_element(rng.choice(("div", "section")), x) for x in pieces]
    title = _element("h1", words("m", 2, 12)) * (rest() < 0.9)
    text = title + "".join(pieces)
    longest = 300 if rest() < 0.5 else 80
    alone = rest() < 0.05  # the text and nothing else
    parts = [
        _element(style["top"], _element("div", words("b", 1, 3))) * (rest() < 0.7),
        _element(style["menu"], links(rng.randint(3, 12), rng.choice(("li", "div", "span")))) * (rest() < 0.9),
        _element(style["notice"], words("b", 4, 12 if short else 60)) * (rest() < 0.5),
        _element(style["ad"], words("b", 2, 10 if short else 60)) * (rest() < 0.6),
        text if short and rest() < 0.4 else _element(style["text"], text),
        _element(style["side"], (_element("h3", words("b", 1, 3)) + (links(rng.randint(3, 8)) if short or rest() < 0.6 else _element("p", words("b", 5, 60))))) * (rest() < 0.7),
        (_element(style["comments"], _element("h2", "b b") + "".join(_element(rng.choice(("div", "article", "p", 'div class="comment-content"')), words("b", 2, longest)) for _ in range(rng.randint(1, 12)))) if "comments" in style and rest() < 0.6 else ""),
        _element(style["end"], f"&copy; {words('b', 2, 12 if short else 20)}" + links(rng.randint(2, 6), "span") * (rest() < 0.5)) * (rest() < 0.8),
    ]
    page = parts[4] if alone else "".join(parts)
    if title and not short and rest() < 0.4:
        page = _element(rng.choice(WRAPPERS), page)
    return f"<html><body>{page}</body></html>"


def labelled_blocks() -> list[tuple[float, ...]]:
    """(label, *FEATURES) of each block of ``PAGES`` pages; label 1 is main text."""
    rng = Random(SEED)
    rows = []
    for i in range(PAGES):
        blocks = Blocks(sample_page(rng, STYLES[i % len(STYLES)]))
        rows += [(float(text.startswith("m")), *map(float, f)) for text, f in zip(blocks.texts, blocks.features(), strict=True)]
    return rows


COLUMNS = ("label", *FEATURES)
