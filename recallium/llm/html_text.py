"""HTML extraction by two-pass block rules (op 7).

Pass one cuts a page into blocks of text and classifies each by stop-word density, length and link density, with the
page's own structure as evidence (a menu, an advert, a comment list say what they are). Pass two gives each block
that was too short or too plain to decide the label of its nearest decided neighbours, those of its own container first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset("""
the of and to in a is that it for on was be as with by he she they are from at this an not but or had his her have
der die das und zu den mit von ist im ein eine nicht auf dem sich des für es an als auch am aus bei sie er wie
le la les de des et en un une du que qui dans pour au par sur avec est il elle ne pas plus se ce sont
el los las y del se por con una su para es al lo como más pero sus o este sí porque
""".split())
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, LINKS_MOST = 0.2, 0.3
LINKS_MOST_MAIN = 0.65  # inside an article, whose paragraphs may cite
STOP_KNOWN = 0.05  # below this share over the page's text, its language is none that the stop words know
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "math", "audio", "video", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
PLAIN_BAD = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "search", "fieldset"}
ROLE_BAD = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
NAME_BAD = {"ad", "ads", "adv", "nav", "menu", "footer", "header", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related", "widget", "pager", "login", "search", "copyright", "legal", "hidden", "popup", "modal", "overlay", "gdpr", "notice", "notices", "alert", "reply", "replies", "respond", "disqus", "tags", "meta", "skip", "signup", "subscribe", "outbrain", "taboola", "recommended"}
NAME_BAD_HEADS = ("advert", "sponsor", "promo", "banner", "cookie", "consent", "newsletter", "comment", "sidebar", "breadcrumb", "navbar", "navigation", "pagination", "subnav", "disclaimer", "subscri")
#: What stands beside such a word when the name is of a part of the page, not of a subject (``social-history``).
NAME_PLAIN = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "nav", "outer", "page", "panel", "posts", "right", "row", "section", "site", "slot", "top", "unit", "wrap", "wrapper", "zone"}
NAME_MAIN = {"article", "main", "content", "post", "story", "entry"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)""", re.I)


def _names_bad(words: list[str]) -> bool:
    """Whether one class or id names a part beside the text: its last word does, or its words do but for plain ones."""
    bad = [w in NAME_BAD or w.startswith(NAME_BAD_HEADS) for w in words]
    return any(bad) and (bad[-1] or all(b or w in NAME_PLAIN for b, w in zip(bad, words, strict=True)) or any(w.startswith(NAME_BAD_HEADS) for w in words))


def _hint(name: str, attrs: str, in_main: bool) -> tuple[str, str]:
    """What an element says of itself, and ``article``, ``main`` or ``form`` if it is one. The first is ``bad``; ``soft`` (bad by a
    name or as a form, unless what it holds says otherwise); ``main``; ``header`` (of an article: only its headings
    count); or nothing."""
    if name == "header":
        return ("header" if in_main else "bad"), ""
    if name in PLAIN_BAD and name != "form":
        return "bad", ""
    region = name if name in ("article", "main") else ""
    form, named, named_main = name == "form", False, False
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "bad", ""
        if key == "role":
            if value in ROLE_BAD and value != "form":
                return "bad", ""
            form = form or value == "form"
            region = value if value in ("main", "article") else region
        elif key in ("class", "id") and name not in ("html", "body"):
            for token in value.split():
                words = re.findall(r"[a-z]+", token)
                named = named or _names_bad(words)
                named_main = named_main or any(w in NAME_MAIN for w in words)
    if region == "main" or (region and (named_main or not named)):
        return "main", region
    if (named and not (in_main and name in TEXT_LEVEL)) or form:
        return "soft", region or ("form" if form else "")
    return ("main" if named_main and name in ("div", "section", "td") else ""), ""


def _settle(found: list[dict], soft: list[dict]) -> None:
    """Which soft elements are bad after all, and so which blocks.

    One that holds ``main``, or at least half of the text of all articles, holds the page; so does a form with at least
    half of the page's text, and on pages without articles any element with four fifths of it. An article that is bad by its own name stays out only where other articles have text.
    A soft element's ``up`` is the one round it, begun before it, so sums go up and verdicts down in one pass each.
    """
    held = [b for b in found if not b["bad"]]
    page, articles = sum(len(b["text"]) for b in held), sum(len(b["text"]) for b in held if b["region"])
    text, of_articles = [0] * len(soft), [0] * len(soft)
    for b in held:
        if b["soft"] >= 0:
            text[b["soft"]] += len(b["text"])
            of_articles[b["soft"]] += len(b["text"]) * b["region"]
    for k in range(len(soft) - 1, -1, -1):
        if (up := soft[k]["up"]) >= 0:
            text[up] += text[k]
            of_articles[up] += of_articles[k]
    for k, s in enumerate(soft):
        s["bad"] = not (s["main"] or (s["articles"] and 2 * of_articles[k] >= articles) or (s["form"] and 2 * text[k] >= page) or (not articles and 5 * text[k] >= 4 * page))

    def under() -> list[bool]:
        out: list[bool] = []
        for s in soft:
            out.append(s["bad"] or (s["up"] >= 0 and out[s["up"]]))
        return out

    bad = under()
    if not any(b["region"] and len(b["text"]) >= LENGTH_LOW and not (b["soft"] >= 0 and bad[b["soft"]]) for b in held):
        for s in soft:
            s["bad"] = s["bad"] and not s["article"]
        bad = under()
    for b in held:
        b["bad"] = b["soft"] >= 0 and bad[b["soft"]]


class _Open:
    """The open elements, with counts of all that blocks ask for, so that depth costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, str, int, bool]] = []  # name, hint, number, whether it is an article or main
        self.names: Counter = Counter()
        self.hints: Counter = Counter()
        self.regions = 0
        self.mains: list[int] = []  # numbers of open main containers
        self.softs: list[int] = []  # numbers of open soft elements
        self.soft: list[dict] = []

    def push(self, name: str, hint: str, number: int, region: bool) -> None:
        self.stack.append((name, hint, number, region))
        self.names[name] += 1
        self.hints[hint] += 1
        self.regions += region
        if hint == "soft":
            self.softs.append(number)
            if self.soft[number]["in"]:
                self.mains.append(self.soft[number]["in"])
        elif hint == "main":
            self.mains.append(number)

    def pop(self) -> None:
        name, hint, number, region = self.stack.pop()
        self.names[name] -= 1
        self.hints[hint] -= 1
        self.regions -= region
        if hint == "soft":
            self.softs.pop()
            if self.soft[number]["in"]:
                self.mains.pop()
        elif hint == "main":
            self.mains.pop()

    def close(self, name: str, over_blocks: bool) -> None:
        """Close the innermost element of this name and all inside it; an inline one does not end a block inside it."""
        if not self.names[name]:
            return
        if not over_blocks:
            for n, *_ in reversed(self.stack):
                if n == name:
                    break
                if n in BLOCK:
                    return
        while self.stack[-1][0] != name:
            self.pop()
        self.pop()


TEXT_LEVEL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "span", "em", "strong", "b", "i", "a", "table", "figure", "figcaption"}  # an article's own text, whatever its class
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def blocks(html: str) -> list[dict]:
    """Blocks in page order: text, characters in links, hint, container, heading; in time linear in the page."""
    out: list[dict] = []
    up = _Open()
    ends: dict[str, re.Match | None] = {}  # the next end tag of each raw element, looked for once
    text: list[str] = []
    link_chars = n_containers = at = 0

    def flush() -> None:
        nonlocal link_chars
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            heading = any(up.names[h] for h in HEADINGS)
            bad = up.hints["bad"] > 0 or (up.hints["header"] > 0 and not heading)
            out.append({"text": joined, "links": link_chars, "bad": bad, "in": up.mains[-1] if up.mains else 0, "heading": heading, "soft": up.softs[-1] if up.softs else -1, "region": up.regions > 0})
        link_chars = 0

    def add(piece: str) -> None:
        nonlocal link_chars
        text.append(piece)
        if up.names["a"]:
            link_chars += len(piece)

    while (m := _TAG.search(html, at)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"].replace("&", "&amp;"))
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not end and not attrs.endswith("/"):
                if name not in ends or ((found := ends[name]) is not None and found.start() < at):
                    ends[name] = _closing(name).search(html, at)
                close = ends[name]
                at = close.end() if close else (len(html) if name in ("script", "style") else at)
            continue
        if name == "br":
            add(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        if end:
            up.close(name, block)
            continue
        if name in VOID:
            if name == "img":
                add(" ")
            continue
        if block and up.names["p"]:
            up.close("p", True)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and up.stack and up.stack[-1][0] == name:
            up.pop()
        if attrs.endswith("/") and not block:
            continue
        hint, region = _hint(name, attrs, bool(up.mains))
        number = 0
        if hint == "main" or region == "article":
            n_containers += 1
            number = n_containers
        if hint == "main" and region:
            said = "main" if region == "main" else "articles"
            for c in reversed(up.softs):
                if up.soft[c][said]:
                    break  # and so have all round it
                up.soft[c][said] = True
        if hint == "soft":
            up.soft.append({"in": number, "article": region == "article", "form": region == "form", "main": False, "articles": False, "up": up.softs[-1] if up.softs else -1})
            number = len(up.soft) - 1
        up.push(name, hint, number, hint == "main" and bool(region))
    if at < len(html):
        add(html[at:])
    flush()
    _settle(out, up.soft)
    return out


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def _nearest(found: list[dict], first: list[str], step: int) -> list[tuple[int, bool] | None]:
    """Per block: distance to the nearest decided block on that side in its own container, and whether that is good."""
    out: list[tuple[int, bool] | None] = [None] * len(found)
    last, home = None, None
    order = range(len(found)) if step < 0 else range(len(found) - 1, -1, -1)
    for k in order:
        if found[k]["in"] != home:
            last, home = None, found[k]["in"]
        out[k] = None if last is None else (abs(k - last), first[last] == "good")
        if first[k] in ("good", "bad") and not found[k]["bad"]:
            last = k
    return out


def classify_blocks(found: list[dict]) -> list[bool]:
    """Pass one: ``good``, ``bad`` or undecided (``near`` for plain, ``short`` for short). Pass two: neighbours decide."""
    counted = [_WORD.findall(b["text"].lower()) for b in found]
    stops = [sum(w in STOP_WORDS for w in words) for words in counted]
    held = [k for k, b in enumerate(found) if not b["bad"]]
    known = sum(stops[k] for k in held) >= STOP_KNOWN * sum(len(counted[k]) for k in held)
    first = []
    for b, words, n in zip(found, counted, stops, strict=True):
        size = len(b["text"])
        density = b["links"] / max(1, size)
        dense = n >= STOP_LOW * max(1, len(words)) if known else size > LENGTH_HIGH
        if b["bad"] or density > (LINKS_MOST_MAIN if b["in"] else LINKS_MOST) or (not b["in"] and size < LENGTH_LOW and _RIGHTS.match(b["text"])):
            first.append("bad")
        elif b["heading"] or size < LENGTH_LOW:
            first.append("short")
        elif dense:
            first.append("good" if size > LENGTH_HIGH or b["in"] else "near")
        else:
            first.append("near")
    has_main = any(b["in"] and f in ("good", "near") for b, f in zip(found, first, strict=True))
    good, some_good = [f == "good" for f in first], "good" in first
    before, after = _nearest(found, first, -1), _nearest(found, first, 1)
    for k, f in enumerate(first):
        if f in ("good", "bad"):
            continue
        sides = [s for s in (after[k], before[k]) if s]
        home = found[k]["in"]
        good[k] = min(sides, key=lambda s: (s[0], not s[1]))[1] if sides else bool(home) or (not has_main and (f == "near" or not some_good))
    if has_main:  # a page that marks its article keeps to it
        good = [g and bool(b["in"]) for g, b in zip(good, found, strict=True)]
    return good


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return " ".join(b["text"] for b, g in zip(found, classify_blocks(found), strict=True) if g)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``. Null and empty pages, and pages without main text, give an empty text.
    Repeated rows give repeated results; an empty table gives none; extra columns are ignored."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
