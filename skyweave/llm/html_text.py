"""Main text of web pages by scoring the tree of elements (operator 10).

Scripts, controls, navigation and what is hidden are taken out by their tags. Each paragraph
of what is left gives points for its length and its commas, discounted by the share of its
text that is in links: all of them to its container and to article and main elements around
it, less to other ancestors the higher they stand. An element's points are discounted by the
share of links once more. Words of a class or id, roles, forms and headers only weigh: what
they mark is left out unless it has HALF of the page's points. What is marked as reader
comments, follows a title such as "Comments" or is an article in an article is left out, if
anything else has points, where it also looks like comments: by authors, dates or replies
inside, as a list or blocks after a title, or as inner articles that have less text than
their outer one has itself. Either is left out if an article or main element elsewhere has
text. A page whose text is all in noscript elements has that text.

The element with most points is kept with those siblings that have a fair share of them or
read like prose, with headings before these and bare text between them, and all blocks of
these are the text. Nothing inside of what is kept is left out for its links.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline.

Whole pages are read, however long or deep. Defined results: a null page counts as empty; a
page without text gives the empty text; a tag that is not closed ends with its parent; of
elements with equally many points the first in page order is the best; rows that repeat are
repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, slices, table

#: Taken out wherever they stand.
NEVER = frozenset("script style noscript template iframe object embed svg canvas input button select textarea nav footer aside menu dialog head title audio video map datalist progress".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre blockquote figure figcaption hr address header hgroup details summary center fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption"} | {"form", "nav", "footer", "aside", "menu"}
#: Opening the first ends an open one of the others, up to the nearest of the last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
#: Words of a class or id that mark what is not the article.
APART = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar aside rail widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay toast paywall newsletter subscribe subscription signup login signin register search searchbox share sharing shares social follow "
    "related recommended recommendations trending popular more teaser teasers breadcrumb breadcrumbs pagination pager pages toolbar tools comment comments commentlist respond reply replies discussion disqus feedback reviews "
    "copyright legal disclaimer skip hidden outbrain taboola byline-social jump tags taglist".split()
)
#: Those of reader comments.
COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
#: Those of a comment's author, date and tools.
VOICES = COMMENTS | frozenset("author authors byline commenter date avatar posted timestamp username vcard".split())
#: Words that stand beside them and say nothing else.
NEUTRAL = frozenset("area bar block bottom box button buttons container content desktop fixed form global inner item items layer left link links list main message mobile outer page post posts primary right row secondary section site slot small sticky text thread top unit user wrap wrapper".split())
#: Beginnings of such words, where they stand alone.
APART_PREFIXES = ("share", "social", "sponsor", "advert", "cookie", "newsletter", "sidebar", "breadcrumb", "pagin", "navig", "footer", "subscri", "recommend")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
LIKELY = frozenset("article content entry post story main body text page".split())
#: Titles of reader comments; fixed values.
TITLES = re.compile(r"(?:\d+ )?(?:(?:reader|user) )?(?:comments?|responses|replies|kommentare|commentaires|comentarios|leave a (?:comment|reply)|join the discussion)(?: \(\d+\))?:?", re.I)
#: The share of a page's points that no mark outweighs.
HALF = 0.5

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOSCRIPT = re.compile("<noscript", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOP = re.compile(r"[.!?。！？…:;\"”»](?:\s|$)")
_COMMA = re.compile("[,،、，]")


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "total", "chars", "linked", "mark", "holders", "inner", "voice")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.points, self.total, self.chars, self.linked, self.mark, self.holders = 0.0, 0.0, 0, 0, "", 0
        self.inner, self.voice = 0, False  # letters of the articles inside; whether something inside tells an author, a date or a reply

    def elements(self) -> list[Element]:
        return [c for c in self.children if not isinstance(c, str)]


#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
_OPEN = re.compile(r"<([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Tree:
    """The tree of a page, however badly it is closed; what takes back what was read takes no more time than reading it."""

    def __init__(self):
        self.root = self.at = Element("html", {}, None)
        self.open: Counter = Counter()  # tags from the root to where it is
        self.stuck: set[tuple[int, str]] = set()  # end tags that end nothing there

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            tag = html.find("<", at)
            self.text(html[at : tag if tag >= 0 else n])
            if tag < 0:
                return
            begin = html[tag + 1 : tag + 2]
            if html.startswith("<!--", tag):
                end = html.find("-->", tag + 4)
                at = end + 3
            elif begin in ("!", "?", "/") or begin.isascii() and begin.isalpha():
                end = html.find(">", tag)
                at = end + 1
                if end > 0 and begin == "/" and (name := _NAME.match(html, tag + 2)):
                    self.end(name[0].lower())
                elif end > 0 and begin not in "!?/":
                    at = self.begun(html, tag, end)
                    end = at if at >= 0 else -1
            else:
                end = tag
                self.text("<")
                at = tag + 1
            if end < 0:
                return  # what does not end ends the page

    def begun(self, html: str, tag: int, end: int) -> int:
        """Takes a start tag, with the text of an element without tags inside; gives the place after it, or -1."""
        whole = _OPEN.match(html, tag)
        name, inside = (whole[1], whole[2]) if whole else (_NAME.match(html, tag + 1)[0], html[tag + 1 : end])
        at = whole.end() if whole else end + 1
        name = name.lower()
        attrs: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(inside):
            attrs.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
        self.start(name, attrs)
        if inside.endswith("/") and name in ("svg", "path", "iframe"):
            self.end(name)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            return close.start() if close else -1
        return at

    def text(self, data: str) -> None:
        if data:
            self.at.children.append(unescape(data))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or tag == "body" and self.open["body"]:
            return
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "li", "article", "section", "div", "blockquote"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        new = Element(tag, attrs, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if not self.open[tag] or (id(self.at), tag) in self.stuck:
            return
        at = self.at
        while at.tag != tag:
            if at.tag in BLOCKS and tag not in BLOCKS and tag not in NEVER:
                self.stuck.add((id(self.at), tag))
                return  # an inline end tag does not end a block
            at = at.parent
        self._leave(at)

    def _leave(self, e: Element) -> None:
        while self.at is not e:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        if e.parent:
            self.open[e.tag] -= 1
            self.at = e.parent

    def _end(self, tags: set[str], within: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        at = self.at
        while at.parent and at.tag not in within:
            above = at.parent
            if at.tag in tags:
                self._leave(at)
                if "td" not in tags and "tr" not in tags:
                    return
            at = above


def marks(e: Element) -> set[str]:
    return {w.lower() for name in ("class", "id") for w in _WORD.findall(e.attrs.get(name, ""))}


def marked(e: Element, outer: Element | None) -> str:
    """What says that an element is not of the article: "sure", "apart" or nothing. ``outer`` is the article around it."""
    in_article = outer is not None
    found: set[str] = set()
    for token in f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(token)]
        if words and all(w in APART or w in NEUTRAL for w in words) or len(words) == 1 and words[0].startswith(APART_PREFIXES):
            found |= {w for w in words if w in APART or w.startswith(APART_PREFIXES)}
    if e.tag not in ("html", "body", "main") and found & COMMENTS:
        return "sure" if e.voice or e.tag in ("ul", "ol", "dl", "li", "article") else "apart"
    if e.tag == "article" and in_article:
        return "sure" if e.voice or 2 * outer.inner <= outer.chars else ""
    if e.tag in ("html", "body", "main", "article"):
        return ""
    if e.tag in ("form", "header") or e.attrs.get("role", "").lower() in ROLES:
        return "" if e.tag == "header" and in_article else "apart"
    if e.tag in HEADINGS or e.tag not in BLOCKS and e.tag not in ("span", "a", "ins", "td", "th"):
        return "apart" if found & {"ad", "ads", "hidden", "share"} else ""
    return "" if not found or in_article and found == {"header"} else "apart"


def hidden(e: Element) -> bool:
    return "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(e.attrs.get("style", "")))


def cleared(root: Element, never: frozenset[str] = NEVER) -> None:
    """Takes out what never is text, and tells what is marked."""
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        at.children = [c for c in at.children if isinstance(c, str) or c.tag not in never and not hidden(c)]
        stack.extend(at.elements())
    for at in reversed(order):
        at.chars = sum(len(c.strip()) if isinstance(c, str) else c.chars for c in at.children)
        at.inner = sum(c.chars if c.tag == "article" else c.inner for c in at.elements())
        at.voice = any(c.voice or c.tag in ("time", "cite") or marks(c) & VOICES for c in at.elements())
    around: list[tuple[Element, Element | None]] = [(root, None)]
    while around:
        at, outer = around.pop()
        at.mark = marked(at, outer)
        outer = at if at.tag == "article" else outer
        around.extend((c, outer) for c in at.elements())
        tail(at.elements())


def tail(siblings: list[Element]) -> None:
    """Marks what follows a title of comments, up to the next heading of its level, if it looks like comments."""
    for i, title in enumerate(siblings):
        if title.tag in HEADINGS and TITLES.fullmatch(tidy("".join(texts(title)))):
            end = next((k for k in range(i + 1, len(siblings)) if siblings[k].tag in HEADINGS and siblings[k].tag <= title.tag), len(siblings))
            after = siblings[i + 1 : end]
            if any(e.voice or e.tag in ("ul", "ol", "dl", "div", "section", "article", "form", "time", "cite") or marks(e) & VOICES for e in after):
                for e in siblings[i:end]:
                    e.attrs = {**e.attrs, "class": "comment"}
                    e.voice = True


def tidy(text: str) -> str:
    """``text`` with one space for white space, and none at its ends."""
    return " ".join(text.split())


def texts(e: Element) -> list[str]:
    out, stack = [], [e]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            stack.extend(reversed(at.children))
    return out


def measured(root: Element) -> list[tuple[Element, str]]:
    """Letters and linked letters of all elements, and the points of the paragraphs in them; gives the paragraphs."""
    stack = [(root, False)]
    order: list[tuple[Element, bool]] = []
    while stack:
        at, link = stack.pop()
        link = link or at.tag == "a" and "href" in at.attrs
        order.append((at, link))
        at.points = at.total = 0.0
        stack.extend((c, link) for c in at.elements())
    for at, link in reversed(order):
        chars = linked = 0
        for c in at.children:
            if isinstance(c, str):
                chars += len(tidy(c))
            else:
                chars += c.chars
                linked += c.linked
        at.chars, at.linked = chars, chars if link else linked
        at.holders = sum(c.holders for c in at.elements()) + (at.tag in ("article", "main") and not at.mark and chars > 0)  # articles with text
    found = blocks(root)
    for owner, text in found:
        owner.total += worth(owner, text)
    for at, _ in reversed(order):
        if at.parent and at is not root:
            at.parent.total += at.total
    return found


def worth(owner: Element, text: str) -> float:
    """A paragraph's points; titles have none."""
    if owner.tag in HEADINGS:
        return 0.0
    return (min(len(text) / 100, 3) + len(_COMMA.findall(text)) + (len(text) >= 25)) * (1 - (density(owner) if owner.tag in ("p", "li", "td", "dd", "dt") else 0))


def weighed(root: Element) -> list[tuple[Element, str]]:
    """Takes out what is marked and has too few of the points; gives the paragraphs that are left."""
    found = measured(root)
    for kind in ("sure", "apart"):
        least = root.total if kind == "sure" else HALF * root.total
        stack, gone = [(root, 0)], False
        while stack:
            at, around = stack.pop()  # with the number of articles that it is in
            around += at.tag in ("article", "main") and not at.mark
            elsewhere = root.holders - around
            kept = [c for c in at.children if isinstance(c, str) or c.mark != kind or c.holders == elsewhere and c.total >= least and c.total]
            gone = gone or len(kept) < len(at.children)
            at.children = kept
            stack.extend((c, around) for c in at.elements())
        found = measured(root) if gone else found
    return found


def blocks(e: Element) -> list[tuple[Element, str]]:
    """The blocks below an element, each with the element whose text it is."""
    out: list[tuple[Element, str]] = []
    owner, parts = e, []

    def flush():
        if text := tidy("".join(parts)):
            out.append((owner, text))
        parts.clear()

    stack: list[tuple[str, object]] = [("open", e)]
    while stack:
        what, x = stack.pop()
        if what == "text":
            parts.append(x)
        elif what == "own":
            flush()
            owner = x
        else:
            if x.tag in ("br", "td", "th"):
                parts.append(" ")
            if x.tag in BLOCKS:
                flush()
                owner, back = x, owner
                stack.append(("own", back))
            stack.extend(("text", c) if isinstance(c, str) else ("open", c) for c in reversed(x.children))
    flush()
    return out


def density(e: Element) -> float:
    return e.linked / e.chars if e.chars else 0.0


def scored(found: list[tuple[Element, str]]) -> list[Element]:
    """Elements that paragraphs gave points, in page order of their first paragraph."""
    got: dict[int, Element] = {}
    for owner, text in found:
        points = worth(owner, text)
        if not points:
            continue
        at, level = owner if owner.tag in ("div", "section", "article", "main", "body", "html", "td", "form") else owner.parent, 1
        while at:
            got[id(at)] = at
            at.points += points if at.tag in ("article", "main") else points / level
            at, level = at.parent, level + 1
    for e in got.values():
        e.points *= 1 - density(e)
        if e.tag == "article":
            e.points *= 1.25
        elif marks(e) & LIKELY and e.tag not in ("main", "body", "html"):
            e.points *= 1.1
    return list(got.values())


def chosen(root: Element, found: list[tuple[Element, str]]) -> list[Element | str]:
    """The best element with those of its siblings that belong to it."""
    candidates = scored(found)
    if not candidates:
        return [root]
    best = max(candidates, key=lambda e: e.points)  # of equal ones the first, which is the innermost
    articles = [e for e in candidates if e.tag == "article"]
    if best.tag == "main" and sum(e.total for e in articles) >= HALF * best.total:
        best = max(articles, key=lambda e: e.points)  # what stands beside them in the main element must belong to them
    if not best.parent:
        return [best]
    semantic = best.tag in ("article", "main")
    keep: list[Element | str] = []
    waiting: list[Element | str] = []  # headings, until something after them is kept
    seen = False
    for e in best.parent.children:
        if e is best:
            keep += [*waiting, e]
            waiting, seen = [], True
        elif isinstance(e, str):
            text = tidy(e)
            if len(text) > 80 or text and _STOP.search(text):
                keep += [*waiting, e]
                waiting = []
        elif e.tag in HEADINGS:
            if density(e) < 0.5:
                waiting.append(e)
        elif belongs(e, best, semantic):
            keep += [*waiting, e]
            waiting = []
        elif seen:
            waiting = []
    return keep


def belongs(e: Element, best: Element, semantic: bool) -> bool:
    """Whether a sibling has a fair share of the points, or is prose."""
    if e.tag == best.tag == "article":
        return e.total > 0 and density(e) < 0.5
    alike = e.tag == best.tag and e.attrs.get("class") == best.attrs.get("class")
    if e.points >= max(1.0, best.points * 0.2) or e.points > 0 and alike and e.attrs.get("class"):
        return True
    prose = {"p", "pre", "blockquote", "table", "figure"} if semantic else {"p", "pre", "blockquote", "table", "figure", "ul", "ol", "dl"}
    if e.tag not in prose and not alike or density(e) >= 0.25:
        return False
    text = " ".join(t for _, t in blocks(e))
    return len(text) > 80 or bool(_STOP.search(text))


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    text = extracted_text(html, NEVER)
    return text or (extracted_text(html, NEVER - {"noscript"}) if _NOSCRIPT.search(html) else "")


def extracted_text(html: str, never: frozenset[str]) -> str:
    tree = Tree()
    tree.feed(html)
    cleared(tree.root, never)
    found = weighed(tree.root)
    out = []
    for part in chosen(tree.root, found):
        if isinstance(part, str):
            out.append(tidy(part))
            continue
        for owner, text in blocks(part):
            if part.tag in ("body", "html") and owner.tag in ("ul", "ol", "li") and density(owner) > 0.6:
                continue  # lists of links beside the paragraphs, where no element holds the article
            out.append(text)
    return "\n".join(out)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""

    def step(ids, urls, htmls):
        for a, b in slices(len(ids), [len(h or "") for h in htmls], 8 << 20):
            texts = [main_text(h) for h in htmls[a:b]]
            yield {"page_id": ids[a:b], "url": urls[a:b], "text": texts, "n_chars": [len(t) for t in texts]}

    columns = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")]
    return map_rows(pages, columns, step, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
