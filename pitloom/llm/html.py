"""Main text of web pages by two passes over their blocks.

First, each block is judged by itself: link density, length and the share of stop words make it good or bad, or
leave it undecided if it is short or tells too little. On a page in a language without stop words here, length and link density decide. Then undecided blocks take the label of the nearest decided
neighbours inside the same article. Blocks in menus, notices, forms and the like are bad by their markup. A name alone says less: one whose last
word is something else (`related-work`, `share-price`), or that stands in an article, only asks that the block be good by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_texts

#: Common words by language.
STOP_WORDS = {
    "en": "the of and to a in is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there use an each which she do how their if will",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'un cette ont ses mais comme on tout nous sa été elle ou leur lui si vous ces y être",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

_RAW = frozenset(["script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select", "canvas", "audio", "video", "noframes", "xmp", "title"])
_EXCLUDED = frozenset(["nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "fieldset", "head", "datalist", "label"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_CONTAINERS = _EXCLUDED | frozenset(["div", "section", "article", "main", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "center", "blockquote", "figure", "details", "body", "html"])
_BLOCKS = _CONTAINERS | _HEADINGS | frozenset(["p", "li", "dt", "dd", "pre", "hr", "address", "figcaption", "caption", "summary", "legend", "option", "optgroup"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_BAD_NAMES = frozenset(["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "discussion", "disqus", "respond", "replies", "reply", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "pagination", "pager", "widget", "search", "skip", "disclaimer", "copyright", "toc", "hidden", "paywall"])
#: Of these, names of what is no part of an article even inside one.
_SURE_NAMES = frozenset(["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "sidebar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "newsletter", "subscribe", "subscription", "signup", "popup", "modal", "pagination", "pager", "disclaimer", "copyright", "hidden", "paywall"])
#: Words after which a name's meaning stands before them (`comments-wrapper`).
_PLAIN_NAMES = frozenset(["area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col", "column", "container", "content", "desktop", "form", "grid", "group", "holder", "icon", "icons", "info", "inner", "item", "items", "left", "link", "links", "list", "message", "mobile", "module", "outer", "panel", "placeholder", "right", "row", "section", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone"])
_BAD_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tablist", "status"])
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Ideographs and syllables of scripts without spaces between words.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass
class Block:
    tag: str
    text: str
    #: Characters inside links.
    linked: int
    #: What its markup says, from _FREE to _OUT.
    markup: int
    #: Which article (or main part) it stands in; 0: none.
    article: int

    @property
    def excluded(self) -> bool:
        return self.markup == _OUT


#: What markup says of a block: nothing; it must be good by itself; it must be good and long by itself; it's no part of the article.
_FREE, _DOUBTFUL, _UNLIKELY, _OUT = range(4)


def _by_name(word: str, tag: str, in_article: bool) -> int:
    """Of a class or id such as `ad-slot` or `cookie_notice`, but not `with-sidebar`; an article may have a header of its own."""
    parts = [p for p in _NAME_PART.findall(word) if not (p == "header" and in_article)]
    bad = [p for p in parts if p in _BAD_NAMES]
    if not bad or parts[0] in ("has", "with", "no", "not", "is"):
        return _FREE
    while parts[-1] in _PLAIN_NAMES or len(parts[-1]) == 1:
        parts.pop()
    if parts[-1] in _BAD_NAMES:  # the last word says what it is
        if parts[-1] in _SURE_NAMES:
            return _OUT
        if tag not in _CONTAINERS:
            return _DOUBTFUL
        return _UNLIKELY if in_article else _OUT
    return _OUT if not in_article and any(p in _SURE_NAMES for p in bad) else _DOUBTFUL


def _by_markup(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _EXCLUDED and not (tag == "header" and in_article):
        return _OUT
    worst = _FREE
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return worst
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in _BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return _OUT
        if name in ("class", "id") and tag in _BLOCKS:
            worst = max([worst, *(_by_name(word, tag, in_article) for word in value.split())])
    return worst


def blocks(html: str | None) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded, white space becomes one space, a line break too."""
    out: list[Block] = []
    if not html:
        return out
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open containers and blocks: name, markup, article
    places: dict[str, list[int]] = {}  # of open blocks, by name
    containers: list[int] = []
    state = ["", _FREE, 0]  # of the text that is being gathered
    articles = in_link = 0
    strict = True
    no_comment_end = False

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(state[0], text, min(len(text), len(" ".join("".join(linked).split()))) if linked else 0, state[1], state[2]))
            pieces.clear()
            linked.clear()

    def enter() -> None:
        state[:] = stack[-1] if stack else ("", _FREE, 0)

    def cut(at: int) -> None:
        for name, _, _ in stack[at:]:
            places[name].pop()
        while containers and containers[-1] >= at:
            containers.pop()
        del stack[at:]

    def add(text: str) -> None:
        if "&" in text:  # a reference ends where a tag begins
            text = unescape(text)
        pieces.append(text)
        if in_link:
            linked.append(text)

    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        if begin > at:
            add(html[at:begin])
        after = html[begin + 1 : begin + 2]
        if after in ("!", "?"):
            if html.startswith("<!--", begin):
                end = -1 if no_comment_end else html.find("-->", begin + 4)
                no_comment_end = end < 0
                if end >= 0:
                    at = end + 3
                    continue
            end = html.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        m = (_TAG if strict else _LOOSE_TAG).match(html, begin)
        if not m and strict and (after.isalpha() or after == "/"):
            loose = _LOOSE_TAG.match(html, begin)
            if loose:  # a quote without an end; look no further for others
                m, strict = loose, False
        if not m:
            if html.startswith("</", begin) and (end := html.find(">", begin)) >= 0:
                at = end + 1  # a bogus comment
            elif after.isalpha():
                break  # a tag without an end
            else:
                add("<")
                at = begin + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in _RAW and not closing:
            if m[3].endswith("/") and tag in ("svg", "math", "object", "iframe"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
            if tag not in _BLOCKS:
                add(" ")
            at = end.end() if end else size
        elif tag == "br":
            add(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in _BLOCKS:
            flush()
            in_link = 0
            if closing:
                open_at = places.get(tag)
                # otherwise a stray end: of what isn't open, or of a paragraph or the like outside the innermost container
                if open_at and (tag in _CONTAINERS or not containers or open_at[-1] > containers[-1]):
                    cut(open_at[-1])
            elif tag not in _VOID:
                while stack and stack[-1][0] not in _CONTAINERS and (tag in _CONTAINERS or stack[-1][0] in ("p", tag, *_HEADINGS)):
                    cut(len(stack) - 1)  # paragraphs and items end where the next block begins
                _, markup, article = stack[-1] if stack else ("", _FREE, 0)
                if tag in ("article", "main") and not article:
                    articles += 1
                    article = articles
                places.setdefault(tag, []).append(len(stack))
                if tag in _CONTAINERS:
                    containers.append(len(stack))
                stack.append((tag, max(markup, _by_markup(tag, m[3], article > 0)), article))
            enter()
    flush()
    return out


def _length(text: str) -> int:
    """In characters; those of scripts without spaces between words say about three times as much."""
    return len(text) + 2 * len(_WIDE.findall(text)) if not text.isascii() else len(text)


def _stop_words(b: Block) -> tuple[int, int]:
    """How many of the block's words are stop words, and how many words it has."""
    words = _WORD.findall(b.text.lower())
    return sum(w in _STOP for w in words), len(words)


def _by_itself(b: Block, known: tuple[int, int] | None, short: int, long: int, few: float, many: float, links: float) -> bool | None:
    """True: good, False: bad, None: undecided. known: of _stop_words(), or None where they tell nothing."""
    if b.excluded or b.linked > links * len(b.text):
        return False
    if b.markup != _FREE and (b.tag in _HEADINGS or _length(b.text) < (long if b.markup == _UNLIKELY else short)):
        return False
    if b.tag in _HEADINGS or _length(b.text) < short:
        return False if _RIGHTS.match(b.text) and not b.article else None
    if known is None:
        return True if _length(b.text) >= long else None if b.markup == _FREE else False
    share = known[0] / max(1, known[1])
    if share >= (many if len(b.text) < long else few):
        return True
    return None if b.markup == _FREE and (share >= few / 2 or b.article) else False


def _is_sentence(b: Block, few: float, other: bool) -> bool:
    known, words = _stop_words(b)
    return not b.linked and b.tag not in _HEADINGS and _SENTENCE.search(b.text) is not None and (other or known >= few * max(1, words))


def main_text(html: str | None, *, short: int = 70, long: int = 200, few: float = 0.1, many: float = 0.15, links: float = 0.3) -> str:
    """The good blocks' texts, joined by one space. short, long: characters; few, many: shares of stop words; links: share of linked characters.

    If no block of a page is good by itself, undecided sentences with stop words and without links are. A page whose blocks together have less than a quarter of `few` is taken to be in another language. Of two decided neighbours
    equally far away the good one counts.
    """
    found = blocks(html)
    known = [(0, 0) if b.excluded or b.linked > links * len(b.text) or len(b.text) < short // 3 else _stop_words(b) for b in found]
    other = sum(k for k, _ in known) < few / 4 * sum(n for _, n in known)
    label = [_by_itself(b, None if other else k, short, long, few, many, links) for b, k in zip(found, known, strict=True)]
    if not any(label):  # a short page: sentences are its text
        label = [(_is_sentence(b, few, other) or None) if v is None else v for b, v in zip(found, label, strict=True)]
    # an article's blocks have their neighbours in it, where what markup excludes is none; other blocks have them anywhere
    decided: dict[int, list[int]] = {0: [k for k, v in enumerate(label) if v is not None]}
    for k, (b, v) in enumerate(zip(found, label, strict=True)):
        if b.article and v is not None and not b.excluded:
            decided.setdefault(b.article, []).append(k)
    out = []
    for k, (b, v) in enumerate(zip(found, label, strict=True)):
        if v is None:
            at = decided.get(b.article, [])
            j = bisect_left(at, k)
            near = [(abs(k - n), not label[n], n) for n in at[max(0, j - 1) : j + 1]]
            v = label[min(near)[2]] if near else b.article > 0
        if v:
            out.append(b.text)
    return " ".join(out)


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), **options) -> DataFrame:
    """The columns in `keep`, then text and n_chars (code points): the main text of each page.

    A null or empty page, or one without an article, gives an empty text. Repeated rows get a row each, other columns
    are ignored, an empty table gives an empty one. No shuffle.
    """

    def make():
        def of(texts: list) -> list[tuple]:
            return [(t, len(t)) for t in (main_text(h, **options) for h in texts)]

        return of

    return map_texts(pages.select(*keep, F.col(html_col)), keep, html_col, [("text", pa.string(), "string"), ("n_chars", pa.int64(), "long")], make)


def all_text(html: str | None) -> str:
    """Every block's text, one to a line."""
    return "\n".join(b.text for b in blocks(html))
