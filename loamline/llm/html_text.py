"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Lines inside elements that by tag, role, class or
id are menus, notices, adverts, forms or reader comments are left out; the others weigh their text outside links. An article
element (or else main) is a weight: lines inside count for more, lines outside for a small part. Sums of the weights over
sliding windows of lines form the distribution; text begins wherever it surges from a window of little weight and ends
where it dives again, on every page. What lies between is the text.

Defined results: null and empty pages give an empty text, and so do pages of noise alone; a page that breaks off keeps what it
has, but for a tag or comment that isn't closed; character references are decoded, with or without the semicolon where HTML allows that;
white space becomes one space; pages of any length and any faults take time that grows with their length; where nothing reaches
a surge, windows of more than half the heaviest one's weight are text; repeated rows are each done, an empty table
gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; a surge needs this many weighted code points in a window, a dive fewer.
WINDOW, SURGE = 3, 120
#: What a line inside a marked element weighs beside its text (a window of such lines surges), and the share that text
#: outside of it weighs.
MARKED, OUTSIDE = SURGE / WINDOW + 1, 0.02

# Names of HTML elements and words of class names.
RAW = frozenset("script style noscript template textarea title svg math iframe select option button object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist discussion disqus replies reply respond related recommended recommendations share sharing social widget pager pagination tags copyright legal skip hidden".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_PLAIN = re.compile(r"[^>\"']*+")
_NOTED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements that a stray end tag inside of them doesn't close, unless it is one that may.
FENCES = frozenset("article main nav footer aside body table".split())
STRONG = frozenset("article main body html nav footer aside".split())


class Scanner:
    """Tags of a page, from left to right. A quote that is never closed is a character like others, a tag that is never
    closed ends the page; what was sought in vain isn't sought again, so the time grows with the page's length."""

    def __init__(self, page: str):
        self.page, self.at, self.missing = page, 0, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _end_of_tag(self, at: int) -> int:
        """Where the > is that closes a tag."""
        while True:
            at = _PLAIN.match(self.page, at).end()
            if at >= len(self.page) or self.page[at] == ">":
                return at if at < len(self.page) else -1
            closed = self.find(self.page[at], at + 1)
            at = closed + 1 if closed >= 0 else at + 1

    def skip(self, tag: str) -> bool:
        """Go behind the end tag of an element whose content is no markup; whether there is one."""
        if tag in self.missing:
            return False
        m = _END[tag].search(self.page, self.at)
        close = self.find(">", m.end()) if m else -1
        if close < 0:
            self.missing.add(tag)
            return False
        self.at = close + 1
        return True

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """Text before a tag, the tag's name (empty for comments and the like and at the end), whether it is an end tag, its attributes."""
        page = self.page
        while self.at < len(page):
            begin = lt = self.at
            while True:
                lt = self.find("<", lt)
                if lt < 0 or lt + 1 >= len(page) or page[lt + 1].isascii() and (page[lt + 1].isalpha() or page[lt + 1] in "!?/"):
                    break
                lt += 1
            if lt < 0:
                self.at = len(page)
                yield page[begin:], "", False, ""
                return
            text = page[begin:lt]
            if page.startswith("<!--", lt):
                end = self.find("-->", lt + 4)
                self.at = end + 3 if end >= 0 else len(page)
                yield text, "", False, ""
                continue
            if page.startswith("<![CDATA[", lt):
                end = self.find("]]>", lt)
                self.at = end + 3 if end >= 0 else len(page)
                yield text, "", False, ""
                continue
            closing = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + closing)
            if not m:
                end = self.find(">", lt) if page[lt + 1 : lt + 2] in ("!", "?", "/") else -1
                self.at = end + 1 if end >= 0 else len(page)
                yield text, "", False, ""
                continue
            end = self._end_of_tag(m.end())
            self.at = end + 1 if end >= 0 else len(page)
            if end < 0:
                yield text, "", False, ""
            else:
                yield text, m.group().lower(), closing, page[m.end() : end]


_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def is_noise(tag: str, attrs: str, in_text: bool) -> bool:
    """Whether an element holds no main text. in_text: inside an article, whose own header holds its heading."""
    if tag in NOISE_TAGS and not (in_text and tag == "header"):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _NOTED.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in NOISE_ROLES:
            return True
        if name in ("class", "id") and any(w in NOISE_WORDS for w in _WORD.findall(value)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """The page's lines: text, code points inside links, zone (-1 noise, 0 open, 1 main, 2 article)."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, zone, in_link = 0, 0, False
    stack: list[tuple[str, int]] = []  # open elements, and the zone outside of each
    places: dict[str, list[int]] = {}  # of each element on the stack
    fences: list[int] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, min(linked, len(text)), zone))
        linked = 0

    scanner = Scanner(page)
    for text, tag, closing, attrs in scanner:
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not tag:
            continue
        if tag in RAW and not closing:
            if tag in BLOCKS:
                flush()
            if not attrs.rstrip().endswith("/") and not scanner.skip(tag) and tag not in ("option", "button", "object"):
                scanner.at = len(page)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in BLOCKS:
            flush()
            in_link = False
        if tag in VOID or tag in RAW:
            continue
        if not closing:
            before = zone
            if zone >= 0 and is_noise(tag, attrs, zone > 0):
                zone = -1
            elif zone >= 0 and tag == "article":
                zone = 2
            elif zone == 0 and tag == "main" or zone == 0 and 'role="main"' in attrs:
                zone = 1
            if tag in BLOCKS or zone != before:
                if zone != before and tag not in BLOCKS:
                    after, zone = zone, before
                    flush()
                    zone = after
                places.setdefault(tag, []).append(len(stack))
                if tag in FENCES:
                    fences.append(len(stack))
                stack.append((tag, before))
        elif places.get(tag):
            at = places[tag][-1]
            # an end tag for something outside of a fence, or of a paragraph that isn't the innermost element, is stray
            if at < len(stack) - 1 if tag == "p" else tag not in STRONG and fences and fences[-1] > at:
                continue
            if tag not in BLOCKS:
                flush()
            zone = stack[at][1]
            for name, _ in stack[at:]:
                places[name].pop()
            del stack[at:]
            while fences and fences[-1] >= at:
                fences.pop()
    flush()
    return out


def weights(lines: list[tuple[str, int, int]]) -> list[float]:
    """What each line weighs: its text outside links; on a page that marks its text (an article, or else main) lines inside
    weigh so much more that a window of them surges however short they are, and lines outside a fraction."""
    marked = max((z for _, _, z in lines), default=0)
    out = []
    for text, linked, zone in lines:
        own = max(0, len(text) - 2 * linked)
        out.append(0.0 if zone < 0 else float(own) if marked <= 0 else own + MARKED if zone == marked else own * OUTSIDE)
    return out


def surge_and_dive(heavy: list[float]) -> list[bool]:
    """Which lines are text: in every run of windows, those from its surge to its dive that weigh anything."""
    n = len(heavy)
    kept = [False] * n
    if not any(heavy):
        return kept
    sums = [sum(heavy[i : i + WINDOW]) for i in range(n)]
    least = min(SURGE, max(sums) / 2)
    for i in range(n):
        if sums[i] > least:
            for j in range(i, min(n, i + WINDOW)):
                kept[j] = heavy[j] > 0
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = [line for line in lines_of(page) if line[2] >= 0]
    heavy, kept, begin = weights(lines), [], 0
    marked = max((z for _, _, z in lines), default=0)
    # windows don't reach over the edge of an article: a line beside one isn't text because its neighbour is
    inside = [z == marked for _, _, z in lines]
    for i in range(1, len(lines) + 1):
        if i == len(lines) or inside[i] != inside[begin]:
            kept += surge_and_dive(heavy[begin:i]) if inside[begin] else outside_text(heavy[begin:i])
            begin = i
    return " ".join(t for (t, _, _), keep in zip(lines, kept, strict=True) if keep)


def outside_text(heavy: list[float]) -> list[bool]:
    """The same outside of an article, where only a full surge is text."""
    sums = [sum(heavy[i : i + WINDOW]) for i in range(len(heavy))]
    return [w > 0 and max(sums[max(0, i - WINDOW + 1) : i + 1]) > SURGE for i, w in enumerate(heavy)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    needed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return needed.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
