"""Main text of html pages: the contiguous region with the highest score.

A page is read as a sequence of words and tags, by a scanner that passes each character
once however broken the tags are. Parts that hold no article by their element or their
class name are taken out with all inside them, if they end. Each word that is left
scores a positive weight and each tag a negative one; one scan finds the contiguous
stretch with the highest sum, which is the text, with the rest of the article element
it stands in. Weights come from labelled pages, where the tags of the article are known.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import bounded_sample, per_row

#: Labelled pages that weights are learned from, at most.
MOST_PAGES = 2000
#: Elements whose text is not read as html (fixed values).
RAW = ("script", "style", "textarea", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title")
#: Elements that are no part of an article (fixed values).
ASIDE = frozenset(("nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "label", "fieldset", "video", "audio", "map"))
#: Words in a class, id or role that say the same of an element (fixed values).
ASIDE_WORDS = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "pager", "popup", "promo", "promotion",
    "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "widget"))
#: Words that say an element holds the article, whatever else its class says (fixed values).
MAIN_WORDS = frozenset(("article", "main", "content", "post", "entry", "story", "body"))
#: Elements that never have content (fixed values).
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements inside a line: their tags do not part words (fixed values).
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_START = re.compile(r"<(?:(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)|(?P<other>[!?]))")
_STOP = re.compile(r">|=\s*([\"'])")
_RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9])[^>]*>?", re.IGNORECASE) for name in RAW}
#: Beginnings of a class name that say how an element is laid out, not what it is (fixed values).
LAYOUT_WORDS = frozenset(("has", "with", "no", "without", "hide", "show"))
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Positive weight of a word, and the least and the most that a tag costs.
WORD_WEIGHT, LEAST_COST, MOST_COST = 1.0, 0.05, 8.0


def _is_aside(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is no part of an article. In an article a class name of other content counts beside any other."""
    if name in ASIDE:
        return True
    if name in ("article", "main", "body", "html"):
        return False
    if "=" in rest:
        aside = main = False
        for told in (x for a, b, c in _NAMES.findall(rest) for x in (a or b or c).split()):
            words = [w for w in _SPLIT.split(_CAMEL.sub(" ", told).lower()) if w]
            if words and words[0] in LAYOUT_WORDS:
                continue
            found = not ASIDE_WORDS.isdisjoint(words)
            aside |= found
            main |= not found and not MAIN_WORDS.isdisjoint(words)
        if aside and (inside or not main):
            return True
    return " hidden" in f" {rest} "


def scan(page: str) -> list[tuple[str, str, str]]:
    """("text", text, ""), ("open" or "close", name, attributes) in order; "open" with a final slash is "alone".

    A quote opens a value after an equals sign only. Where a tag would have no end but for its
    quotes, quotes mean nothing from there on; what no ``>`` follows is text.
    """
    out: list[tuple[str, str, str]] = []
    at, last, quotes = 0, page.rfind(">"), True
    search = 0
    while (m := _START.search(page, search)) and m.start() <= last:
        if m["other"]:
            if page.startswith("<!--", m.start()):
                end = page.find("-->", m.end() + 2)
                end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", m.end()) + 1
            if m.start() > at:
                out.append(("text", page[at:m.start()], ""))
            at = search = end
            continue
        place = m.end()
        end = -1
        while quotes and (stop := _STOP.search(page, place)):
            if not stop[1]:
                end = stop.start()
                break
            shut = page.find(stop[1], stop.end())
            if shut < 0:
                break
            place = shut + 1
        if end < 0:
            quotes, end = False, page.find(">", m.end())
        if m.start() > at:
            out.append(("text", page[at:m.start()], ""))
        name, rest = m["name"].lower(), page[m.end():end]
        at = search = end + 1
        if name in _RAW_END and not m["close"]:
            if not rest.endswith("/"):
                shut = _RAW_END[name].search(page, at)
                at = search = shut.end() if shut else len(page)
            continue
        out.append(("close" if m["close"] else "alone" if rest.endswith("/") or name in VOID else "open", name, rest))
    if at < len(page):
        out.append(("text", page[at:], ""))
    return out


def tokens(page: str, whole: bool = False) -> list[tuple[str, str, int]]:
    """Text and tags of a page in order: ("text", ..., article) or ("tag", name, article). ``whole`` keeps the parts that are no article.

    ``article`` numbers the outermost article or main element around, 0 for none. An element that
    never ends is no reason to leave anything out; an article inside another element stays.
    """
    nodes = scan(page)
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(nodes):
        if kind == "open":
            open_.setdefault(name, []).append(i)
        elif kind == "close" and open_.get(name):
            ends[open_[name].pop()] = i
    article = [i for i, (kind, name, _) in enumerate(nodes) if kind == "open" and name in ("article", "main") and i in ends]
    out: list[tuple[str, str, int]] = []
    i = number = upto = nearest = 0
    while i < len(nodes):
        kind, value, rest = nodes[i]
        while nearest < len(article) and article[nearest] < i:
            nearest += 1
        inside = i < upto
        if kind == "text":
            out.append(("text", value, number if inside else 0))
        elif not whole and kind == "open" and i in ends and _is_aside(value, rest, inside):
            out.append(("tag", "|", number if inside else 0))
            held = nearest < len(article) and article[nearest] < ends[i]
            i = article[nearest] if held else ends[i] + 1
            continue
        else:
            if kind == "open" and value in ("article", "main") and i in ends and not inside:
                number, upto = number + 1, ends[i]
                inside = True
            if not (not whole and kind == "alone" and value not in VOID and _is_aside(value, rest, inside)):
                out.append(("tag", value, number if inside else 0))
        i += 1
    return out


def blocks(page: str) -> list[tuple[list[str], str, int]]:
    """Texts and tags in turn: the tags before each block of text, the block, and the number of its article."""
    out: list[tuple[list[str], str, int]] = []
    tags: list[str] = []
    parts: list[str] = []
    article, filled = 0, False

    def close() -> None:
        nonlocal tags, parts, filled
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((tags, text, article))
            tags = []
        parts, filled = [], False

    for kind, value, number in tokens(page):
        if kind == "text":
            if not parts:
                article = number
            parts.append(value)
            filled = filled or not value.isspace()
        elif value in INLINE:
            tags.append(value) if not filled else None
        else:
            close()
            tags.append(value)
    close()
    return out


def tag_costs(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Costs of tags from their numbers inside and outside of articles: the log of how much commoner they are outside."""
    inside, outside = sum(a for a, _ in counts.values()) + 1, sum(b for _, b in counts.values()) + 1
    return {
        tag: min(MOST_COST, max(LEAST_COST, math.log(((b + 0.5) / outside) / ((a + 0.5) / inside))))
        for tag, (a, b) in counts.items()
    }


def label_page(page: str) -> dict[str, tuple[int, int]]:
    """Numbers of tags inside and outside of the one article element of a page; none if it has not just one."""
    told = [value for kind, value, _ in tokens(page, whole=True) if kind == "tag"]
    places = [i for i, value in enumerate(told) if value == "article"]
    if len(places) != 2:
        return {}
    inside, outside = Counter(told[places[0] + 1:places[1]]), Counter(told[:places[0]] + told[places[1] + 1:])
    return {tag: (inside[tag], outside[tag]) for tag in inside.keys() | outside.keys()}


def learn(pages: DataFrame, page: str = "html", key: str = "page_id", most_pages: int = MOST_PAGES) -> dict[str, float]:
    """Costs of tags from the ``most_pages`` pages with the lowest digest of ``key``.

    A page is labelled by its own markup if it has exactly one article element; others
    teach nothing. Without a labelled page every tag has the least cost.
    """
    sample = bounded_sample(pages.where(F.col(page).isNotNull()).select(page, key), key, most_pages, 5).select(page)

    def make():
        def compute(texts):
            found = [label_page(t) for t in texts]
            return {"tags": ["\n".join(f) for f in found], "inside": [[f[t][0] for t in f] for f in found], "outside": [[f[t][1] for t in f] for f in found]}

        return compute

    counted = per_row(sample, page, "tags string,inside array<long>,outside array<long>", make).where("tags != ''")
    each = counted.select(F.explode(F.arrays_zip(F.split("tags", "\n").alias("tag"), "inside", "outside")).alias("t")).select("t.tag", "t.inside", "t.outside")
    total = each.groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc("inside"), F.desc("outside"), "tag").limit(1000)
    return tag_costs({r["tag"]: (r["inside"], r["outside"]) for r in total.collect()})


def best_region(gains: list[float], costs: list[float]) -> tuple[int, int]:
    """First block and block after the last of the stretch with the highest sum: gains of its blocks less costs between them. One scan."""
    best = current = 0.0
    first = start = end = 0
    for i, (gain, cost) in enumerate(zip(gains, costs, strict=True)):
        if current - cost <= 0:
            current, start = 0.0, i
        else:
            current -= cost
        current += gain
        if current > best:
            best, first, end = current, start, i + 1
    return first, end


def main_text(page: str | None, costs: dict[str, float], unknown: float = LEAST_COST) -> str:
    """The blocks of the region with the highest score, and of the article elements it touches, joined by spaces."""
    told = blocks(page or "")
    first, end = best_region(
        [WORD_WEIGHT * (text.count(" ") + 1) for _, text, _ in told], [sum(0.0 if t == "|" else costs.get(t, unknown) for t in tags) for tags, _, _ in told])
    touched = {number for _, _, number in told[first:end]} - {0}
    mine = [i for i, (_, _, number) in enumerate(told) if number in touched]
    if mine:
        first, end = min(first, mine[0]), max(end, mine[-1] + 1)
    return " ".join(text for _, text, _ in told[first:end])


def extract(df: DataFrame, costs: dict[str, float], page: str = "html") -> DataFrame:
    """Add ``text``, the main text of each whole page, and ``n_chars``, its characters.

    A null or empty page, or one without words, has an empty text; the work grows with a
    page's length, also where tags never end. Columns of these names are replaced. ``costs`` has a row for each tag that was learned (at most 1000).
    """
    def make():
        def compute(pages):
            texts = [main_text(p, costs) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return compute

    return per_row(df, page, "text string,n_chars long", make)
