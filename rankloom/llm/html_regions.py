"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores from 0 to 1, a tag costs from 0 to
``TAG_COST``, and the contiguous run with the greatest sum is the content region; one pass
over the sequence finds it. The weights come from labelled pages: those that mark their
article with ``<article>`` or ``<main>``. A word's weight follows from the share of words of
its kind inside the mark (kind: block element around it, in a link or not), a tag's cost
from the share of such tags outside. Each labelled page is counted as it is and once
more with its mark taken away, so pages without a mark get weights of their own. Kinds that
no labelled page shows have the stated prior weights.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, hidden parts and
reader comments are known by element or by the names in class, id and role. Their words
score nothing and are left out of the text, also inside the region.

Character references are decoded, white space inside a block becomes one space, and blocks
are joined by one space. Nothing else is dropped, whatever the length of a page; the pass
takes time in proportion to it.

Edge cases: a null html is an empty page; a page without a word that scores has an empty
text; of runs with equal sums the first one counts, without idle words at its ends; markup
that is cut off or not closed ends with the page; rows with a null ``page_id`` or ``url`` and
repeated rows are extracted each; an empty table gives no rows, and prior weights; further
columns are not read.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a tag costs that is always outside of the content, in words that are always inside.
TAG_COST = 3.0
#: Labelled pages to learn from, at most, and how many observations a prior weight counts for.
LABELLED_PAGES, PRIOR_COUNT = 2_000, 20.0

# Elements by the part they play in a page.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
LEFT_OUT = set(
    "aside audio button canvas datalist dialog fieldset footer head iframe input legend map menu nav noembed "
    "noframes noscript object script select style svg template textarea title video xmp".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt address".split())
LISTED = set("ul ol dl li table tbody thead tr td th".split())
CLOSES_P = PROSE | {"ul", "ol", "dl", "li", "table"} | set(
    "article aside center details dialog dir div fieldset figure footer form header hr main menu nav search section "
    "summary".split())
REPEATED = {"li", "tr", "td", "th", "dd", "dt"}
OF_HEAD = set("base link meta noscript script style template title".split())
#: Elements that cannot hold an article: one that is still open there was not closed.
NO_ARTICLE = {"head", "header", "menu", "nav"}
NAMED = PROSE | LISTED | {"div", "section", "article", "main", "body", "figure", "center", "details", "summary"}
# Parts of class and id names, and roles, of what is no content.
HINTS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu "
    "nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe "
    "subscription signup popup modal overlay footer masthead copyright comment comments reply replies respond disqus "
    "share sharing social widget toolbar pagination pager login search".split())
HINT_STARTS = {"has", "with", "without", "no", "not", "is", "js"}
HINT_PAIRS = {("related", x) for x in ("posts", "articles", "links", "stories", "content", "news")}
OUTER_HINTS = {"header", "topbar"}
ROLES = {"navigation", "banner", "contentinfo", "search", "complementary", "form", "dialog", "menu", "menubar", "alert"}
MARK_NAMES = set("article-body article-content post-content post-body entry-content main-content".split())

OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
COMMENT_END = re.compile(r"--!?>")
STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"(?i)\b(?:class|id|role|hidden|style|itemprop|aria-hidden)\b")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: Zones of a page: inside its mark, beside it, or in a page without one.
INSIDE, BESIDE, UNMARKED = "inside", "beside", "unmarked"

Key = tuple[str, str, str]
Marks = tuple[bool, bool, bool]


@dataclass(slots=True)
class Item:
    """A run of text or a tag, with where it stands. A part that is left out is one item."""

    name: str  # the block around a text, or the tag
    start: int
    end: int
    text: bool
    words: int
    linked: bool
    left_out: bool
    form: int  # the number of the form around it
    marks: Marks
    breaks: bool  # a tag that ends a block


@dataclass(slots=True)
class Open:
    """An open element."""

    name: str
    block: int  # the place of the nearest block on the stack
    left_out: int  # the place of the outermost element that is left out, or 0
    form: int
    marks: Marks


@dataclass
class Weights:
    """Words of a kind inside and in all, tags of a kind outside and in all, on labelled pages."""

    words: dict[Key, tuple[float, float]] = field(default_factory=dict)
    tags: dict[Key, tuple[float, float]] = field(default_factory=dict)
    tag_cost: float = TAG_COST

    def word(self, key: Key) -> float:
        inside, n = self.words.get(key, (0.0, 0.0))
        share = (inside + PRIOR_COUNT * _word_prior(key)) / (n + PRIOR_COUNT)
        return max(0.0, 2.0 * share - 1.0)

    def tag(self, key: Key) -> float:
        outside, n = self.tags.get(key, (0.0, 0.0))
        return -self.tag_cost * (outside + PRIOR_COUNT * _tag_prior(key)) / (n + PRIOR_COUNT)


def _word_prior(key: Key) -> float:
    zone, block, linked = key
    if zone != UNMARKED:
        return 1.0 if zone == INSIDE else 0.0
    if linked:
        return 0.8 if block in PROSE else 0.35
    return 0.9 if block in PROSE else 0.8 if block in LISTED else 0.75


def _tag_prior(key: Key) -> float:
    zone, name, _ = key
    if zone != UNMARKED:
        return 0.0 if zone == INSIDE else 1.0
    return 0.02 if name in PROSE or name in ("inline", "br") else 0.04 if name in LISTED else 0.08


class _Page:
    """The items of one page, read in one pass."""

    def __init__(self, html: str):
        self.html, self.items = html, []
        self.stack = [Open("", 0, 0, 0, (False, False, False))]
        self.open_names: Counter = Counter()
        self.linked, self.forms, self.quotes = False, 0, True
        self._read()

    def _read(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            found = OPENING.search(html, at)
            start = found.start() if found else n
            if start > at:
                self._text(at, start)
            if not found:
                return
            at = self._tag(start)

    def _text(self, start: int, end: int) -> None:
        top = self.stack[-1]
        if top.left_out:
            return
        words = len(self.html[start:end].split())
        if words or self.items and not self.items[-1].breaks:
            self.items.append(Item(
                self.stack[top.block].name, start, end, True, words, self.linked, False, top.form, top.marks, False))

    def _tag(self, start: int) -> int:
        """Take the markup at ``start`` and return where it ends."""
        html, n = self.html, len(self.html)
        if html.startswith("<!--", start):
            if html.startswith(("<!-->", "<!--->"), start):
                return html.index(">", start) + 1
            closing = COMMENT_END.search(html, start + 4)
            return closing.end() if closing else n
        named = NAME.match(html, start + 1)
        if not named:
            end = html.find(">", start)
            return n if end < 0 else end + 1
        end = self._tag_end(named.end())
        if end < 0:  # the rest of the page has no closing bracket
            return n
        name = named[1].lower()
        if html[start + 1] == "/":
            self._close(name, start, end)
            return end
        self._open(name, html[named.end():end - 1], start, end)
        if name in RAW:
            closing = re.compile(rf"(?i)</{name}(?=[\s/>])").search(html, end)
            return closing.start() if closing else n
        return end

    def _tag_end(self, at: int) -> int:
        html, i = self.html, at
        while self.quotes:
            stop = STOP.search(html, i)
            if stop is None:
                self.quotes = False  # quotes that are not closed: from here on they are plain characters
                break
            if stop[0] == ">":
                return stop.end()
            i = html.find(html[stop.end() - 1], stop.end()) + 1
            if not i:
                self.quotes = False
        end = html.find(">", at)
        return end + 1 if end >= 0 else -1

    def _emit(self, name: str, start: int, end: int, form: int, marks: Marks, *, left_out: bool = False) -> None:
        inline = name in INLINE
        shown = name if name in NAMED or name in ("a", "br") else "inline" if inline else "other"
        self.items.append(Item(shown, start, end, False, 0, False, left_out, form, marks, not inline))

    def _close_implied(self, name: str) -> None:
        """Close what the start of ``name`` ends: a paragraph, an entry of the same kind, the head."""
        stack = self.stack
        block = stack[-1].block
        open_block = stack[block].name
        if open_block == "p" and name in CLOSES_P or open_block == name and name in REPEATED:
            self._pop_to(block)
        elif open_block == "head" and name not in OF_HEAD:
            self._pop_to(block)
        out = stack[-1].left_out
        if name in ("article", "main") and out and stack[out].name in NO_ARTICLE:
            self._pop_to(out)

    def _open(self, name: str, attributes: str, start: int, end: int) -> None:
        stack = self.stack
        inline = name in INLINE
        if not inline:
            self._close_implied(name)
        top = stack[-1]
        marks, form, out = top.marks, top.form, bool(top.left_out)
        told = dict(_told(attributes)) if TELLING.search(attributes) else {}
        if name == "article" and not _is_comment(told):
            marks = (True, marks[1], marks[2])
        elif name == "main" or told.get("role") == "main":
            marks = (marks[0], True, marks[2])
        elif told.get("itemprop") == "articleBody" or MARK_NAMES & {*told.get("class", "").lower().split(), told.get("id", "").lower()}:
            marks = (marks[0], marks[1], True)
        elif not inline and name not in ("html", "body"):
            in_mark = any(marks)
            out = out or name in LEFT_OUT or name == "header" and not in_mark or _no_content(told, in_mark)
        if name == "form":
            self.forms += 1
            form = self.forms
        if not top.left_out:
            self._emit(name, start, end, form, marks, left_out=out)
        if name == "a":
            self.linked = True
        if name not in VOID:
            here = len(stack)
            stack.append(Open(name, top.block if inline else here, top.left_out or here * out, form, marks))
            self.open_names[name] += 1

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.open_names[self.stack.pop().name] -= 1

    def _close(self, name: str, start: int, end: int) -> None:
        stack = self.stack
        at = len(stack) - 1
        if name == "a":
            self.linked = False
        if self.open_names[name]:
            lowest = stack[-1].block if name in INLINE else 0
            while at > lowest and stack[at].name != name:
                at -= 1
            if stack[at].name != name:  # an inline element that goes on through blocks
                return
        if not stack[at].left_out:
            self._emit(name, start, end, stack[at].form, stack[at].marks)
        if self.open_names[name]:
            self._pop_to(at)


def _told(attributes: str) -> Iterator[tuple[str, str]]:
    for found in ATTRIBUTE.finditer(attributes):
        yield found[1].lower(), found[2] or found[3] or found[4] or ""


def _hinted(name: str, hints: set[str]) -> bool:
    parts = [part.lower() for part in PARTS.findall(name)]
    if not parts or parts[0] in HINT_STARTS:
        return False
    return any(part in hints for part in parts) or any(pair in HINT_PAIRS for pair in zip(parts, parts[1:]))


def _is_comment(told: dict[str, str]) -> bool:
    names = [*told.get("class", "").split(), told.get("id", "")]
    return any(_hinted(name, {"comment", "comments", "reply"}) for name in names)


def _no_content(told: dict[str, str], in_mark: bool) -> bool:
    """Whether an element's attributes name a part that is no content."""
    if not told:
        return False
    hidden = "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "")
    hints = HINTS if in_mark else HINTS | OUTER_HINTS
    names = [*told.get("class", "").split(), told.get("id", "")]
    return hidden or told.get("role", "") in ROLES or any(_hinted(name, hints) for name in names)


def page_items(html: str) -> list[Item]:
    """The page as runs of text and tags; a form with most of the words is the page's wrapper and no form."""
    items = _Page(html).items
    by_form = Counter()
    for item in items:
        by_form[item.form] += item.words
    total = sum(by_form.values())
    forms = {item.form for item in items if item.form and 2 * by_form[item.form] <= total}
    if not forms:
        return items
    kept = []
    for item in items:
        if item.form not in forms:
            kept.append(item)
        elif not kept or kept[-1].form != item.form:
            item.left_out, item.text, item.words, item.breaks = True, False, 0, True
            kept.append(item)
    return kept


def mark_of(items: Sequence[Item]) -> int | None:
    """Which mark the page has: 0 article, 1 main, 2 a named element."""
    return next((m for m in range(3) if any(item.marks[m] for item in items)), None)


def keys(items: Sequence[Item], mark: int | None) -> list[Key]:
    """The kind of each item, for a page with or without a mark."""
    found = []
    for item in items:
        zone = UNMARKED if mark is None else INSIDE if item.marks[mark] else BESIDE
        if item.text:
            found.append((zone, item.name if item.name in NAMED else "other", "a" if item.linked else ""))
        else:
            found.append((zone, "left out" if item.left_out else item.name, ""))
    return found


def scores(items: Sequence[Item], weights: Weights) -> list[float]:
    """What each run of words adds and each tag costs."""
    known: dict[tuple[bool, Key], float] = {}
    out = []
    for item, key in zip(items, keys(items, mark_of(items)), strict=True):
        kind = (item.text, key)
        if kind not in known:
            known[kind] = weights.word(key) if item.text else weights.tag(key)
        out.append(item.words * known[kind] if item.text else known[kind])
    return out


def best_run(values: Sequence[float]) -> tuple[int, int, float]:
    """(start, end, sum) of the run with the greatest sum, in one pass; an empty one if no sum is above 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        if total <= 0.0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, found = total, (start, i + 1)
    return *found, best


def main_text(html: str, weights: Weights) -> tuple[str, int, int, float]:
    """(text, start, end, score): the text of the best region, and where it is in the page."""
    items = page_items(html)
    first, last, score = best_run(scores(items, weights))
    blocks, block = [], []
    for item in items[first:last]:
        if item.breaks:
            blocks.append("".join(block))
            block = []
        elif item.text:
            block.append(markup.unescape(html[item.start:item.end]))
    blocks.append("".join(block))
    text = " ".join(filter(None, (" ".join(b.split()) for b in blocks)))
    if first == last:
        return text, 0, 0, 0.0
    return text, items[first].start, items[last - 1].end, score


def _counted(html: str) -> Counter:
    """(what, zone, name, link) -> [hits, all] of a labelled page, with and without its mark."""
    items = page_items(html)
    mark = mark_of(items)
    counts: Counter = Counter()
    if mark is None or mark > 1:
        return counts
    for as_if in (mark, None):
        for item, key in zip(items, keys(items, as_if), strict=True):
            inside = item.marks[mark]
            if item.text:
                counts["word", *key, inside] += item.words
            else:
                counts["tag", *key, inside] += 1
    return counts


def fit(pages: DataFrame, labelled_pages: int = LABELLED_PAGES, tag_cost: float = TAG_COST) -> Weights:
    """Weights from at most ``labelled_pages`` pages with a mark of their own, drawn by hash; the
    driver gets one row per kind of word or tag, and kinds are fixed in number."""
    rows = pages.select(
        F.xxhash64(F.lit(11), "page_id", "url").alias("draw"), F.col("html")
    ).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    bound = rows.select("draw").distinct().orderBy("draw").limit(labelled_pages).agg(F.max("draw")).first()[0]
    if bound is None:
        return Weights(tag_cost=tag_cost)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch["html"].to_pylist():
                total.update(_counted(html))
        columns = list(zip(*[(*key, n) for key, n in total.items()], strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([
            *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.bool_()),
            pa.array(columns[5], pa.int64())], ["what", "zone", "name", "link", "inside", "n"])

    counts = rows.filter(F.col("draw") <= bound).select("html").mapInArrow(
        count, "what string, zone string, name string, link string, inside boolean, n long")
    weights = Weights(tag_cost=tag_cost)
    for what, zone, name, link, hits, n in counts.groupBy("what", "zone", "name", "link").agg(
            F.sum(F.when(F.col("inside") == (F.col("what") == "word"), F.col("n")).otherwise(0)), F.sum("n")).collect():
        (weights.words if what == "word" else weights.tags)[zone, name, link] = (float(hits), float(n))
    return weights


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars, and the region: region_start, region_end (code points of the html), region_score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html or "", weights) for html in batch["html"].to_pylist()]
            texts, starts, ends, sums = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                pa.array(sums, pa.float64()),
            ], ["page_id", "url", "text", "n_chars", "region_start", "region_end", "region_score"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, region_start long, region_end long, region_score double")
