"""Main text of web pages: elements by their role, and site templates by their recurrence.

Every page is read twice by Spark.  The first pass hashes the element subtrees
of each page, and Spark counts per host on how many different pages each
subtree occurs.  Subtrees that recur on many pages of a host are its template.
The second pass extracts the text without them.  Pages count as different only
if their texts differ, so copies of one article do not make it a template.

A subtree is hashed twice: with its texts, and as a slot by its skeleton (tag,
class, id and role without digits, kinds of blocks inside).  A slot counts on a
page that has it once, outside of articles, full of links or with little text
beside the page's article; what it says may differ from page to page, as menus,
adverts and footers do.

The extraction keeps the articles of a page if they hold at least half of its
text, else its main part on the same condition, else its body, without
navigation, footers, asides, forms, scripts, adverts, notices and reader
comments.  Class, id, role and form only hint at these: an element that holds most
of the page's text is kept, and all are if next to nothing is left.  Tags may be
missing or nested wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import hot_join
from trailframe.session import write_through

MIN_PAGES = 5
MIN_PERCENT = 30
# A long subtree is template as well on so many pages if they are one percent of the host's.
MANY_PAGES = 50
MANY_PERCENT = 1
# A slot of so many words at most, and of this share of the page's text, is short.
SHORT_WORDS = 40
SHORT_PERCENT = 20
# A slot is full of links if they hold this share of its text; it is no menu above this share of the page.
LINK_PERCENT = 50
MENU_PERCENT = 50
# So many words, or characters where words are not divided, make a subtree long.
LONG_WORDS = 10
LONG_CHARS = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-zA-Z][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
# An opened element ends open ones of these names, up to the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Blocks that group others; of the rest, single ones recur in articles of their own accord.
GROUPS = frozenset("address details dir div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
CELLS = frozenset("caption td th tr tbody thead tfoot".split())
ITEMS = frozenset("dd dt figcaption h1 h2 h3 h4 h5 h6 legend li summary".split())
# Elements around articles by their own meaning; they count as slots too.
SECTIONS = frozenset("nav footer aside header".split())
SLOTS = frozenset("div form menu nav ol section ul".split()) | SECTIONS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are no text of a page.
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map "
    "button select input textarea datalist dialog menu title xmp noembed noframes".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
# Elements so marked stay if they hold more than this of a page's text.
MOST_PERCENT = 75
# All of them stay if less than this is left.
LEAST_PERCENT = 10
# Names in class and id attributes of what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification newsletter subscribe subscription signup popup modal overlay sidebar aside menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead share sharing social related "
    "recommended recommendations comment comments disqus respond replies widget toolbar skip login search".split()
)
# Parts of such names that do not change their meaning, as in "top-nav" or "share_buttons".
NEUTRAL = frozenset(
    "site main page top left right bottom global primary secondary box container wrapper wrap block section list item "
    "links link buttons button bar area slot unit group content header posts form".split()
)
_PART = re.compile(r"[-_0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class _Element:
    __slots__ = ("tag", "junk", "mark", "level", "apart", "section", "link", "named", "filled", "words", "chars", "parts", "inside", "out")

    def __init__(self, tag: str, junk: bool, mark: int, level: int):
        self.tag, self.junk, self.level = tag, junk, level
        self.mark = mark  # number of the innermost mark around the text, 0 without
        self.apart = False  # does not tell its parent apart
        self.section = self.link = False  # within a section, within a link
        self.named = ""  # class, id and role
        self.inside: set[int] = set()  # skeletons of the blocks within
        self.filled = False  # holds text, deleted or not
        self.words = self.chars = 0  # of that text
        self.parts: list[bytes] = []  # texts and hashes of children, for the hash
        self.out: list[tuple[int, int, str]] = []  # kept texts with their level and mark


class _Mark:
    """A listed element or a slot: the one around it, and its own text outside of inner ones."""

    __slots__ = ("around", "listed", "slot", "named", "shown", "chars", "words", "links", "headed")

    def __init__(self, around: int, listed: bool, named: bool):
        self.around, self.listed, self.named = around, listed, named
        self.slot: int | None = None
        self.shown = 0  # characters outside of sections, deleted ones too
        self.chars = self.words = self.links = 0
        self.headed = False


def _names(attributes: str) -> str:
    """Class, id and role without digits, in one order."""
    found = []
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            found += _DIGITS.sub("", value.strip("\"'").lower()).split()
    return " ".join(sorted(found))


def _is_name(name: str) -> bool:
    """Whether a class or id names what surrounds an article."""
    if name in MARKS:
        return True
    parts = [p for p in _PART.split(name) if p]
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in NEUTRAL for p in parts)


def _is_junk(tag: str, attributes: str, level: int) -> tuple[bool, bool]:
    """Whether an element is no article text for sure, and whether it is marked so."""
    if tag in DROPPED:
        return True, False
    marked = tag == "form"
    if not attributes or tag in ("html", "body", "main"):
        return False, marked
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            marked = marked or (tag != "article" and any(map(_is_name, value.split())))
        elif name == "role":
            marked = marked or (tag != "article" and value in ROLES)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
    return False, marked


def _deletable(tag: str, level: int, words: int, long: bool) -> bool:
    """Whether recurrence can make this element template.

    Inline elements and parts of tables never; within an article or main part,
    and for list items and headings anywhere, only long ones.  A paragraph of
    one or two words is no template, a group of any size is outside of articles.
    """
    if tag not in BLOCK or tag in CELLS or tag in ("html", "body", "main", "article"):
        return False
    if level or tag in ITEMS:
        return long
    return tag in GROUPS or words > 2


class Page:
    """Reads one page; ``template`` holds the subtree and slot hashes to delete.

    Without ``lists`` neither the sections nor the names nor the preference for
    articles decide, but the template alone.
    """

    def __init__(self, template: frozenset[int] | set[int] = frozenset(), lists: bool = True):
        self.template = template
        self.lists = lists
        self.hashes: dict[int, bool] = {}  # subtrees and slots that may be template: whether they are long
        self.stack = [_Element("", False, 0, 0)]
        self.marks = [_Mark(0, False, False)]
        self.in_article = 0  # characters within articles and main parts

    def read(self, html: str) -> str:
        at = 0
        while True:
            token = _TOKEN.search(html, at)
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            tag = token.group(2)
            attributes = token.group(3) or ""
            if tag is None:
                found = _NAME.match(token.group())
                if found is None:
                    continue
                tag = found.group(1)
            tag = tag.lower()
            if token.group().startswith("</"):
                self._end(tag)
                continue
            self._begin(tag, attributes)
            if attributes.endswith("/") and tag in ("script", "svg", "math"):
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                # Of these elements nothing is kept; an unclosed title or template ends at once.
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(html)
                self._end(tag)
        while len(self.stack) > 1:
            self._close()
        kept = self._kept_marks()
        # Texts by level: of the body, the main part and the articles.
        out = [(level, text) for level, mark, text in self.stack[0].out if kept[mark]]
        sizes = [0, 0, 0]
        for level, text in out:
            sizes[level] += len("".join(text.split()))
        best = 0 if not self.lists else 2 if 2 * sizes[2] >= sum(sizes) else 1 if 2 * (sizes[1] + sizes[2]) >= sum(sizes) else 0
        return " ".join("".join([text if level >= best else " " for level, text in out]).split())

    def _light_slots(self) -> set[int]:
        """Slots that the page has once and that hold links or little text."""
        whole = [[m.chars, m.words, m.links, m.headed] for m in self.marks]
        for k in range(len(whole) - 1, 0, -1):
            above = whole[self.marks[k].around]
            for i in range(3):
                above[i] += whole[k][i]
            above[3] = above[3] or whole[k][3]
        total = whole[0][0]
        has_article = 2 * self.in_article >= total
        times: dict[int, int] = {}
        light = set()
        for mark, (chars, words, links, headed) in zip(self.marks, whole):
            if mark.slot is None or not chars:
                continue
            times[mark.slot] = times.get(mark.slot, 0) + 1
            menu = 100 * links >= LINK_PERCENT * chars and 100 * chars <= MENU_PERCENT * total
            short = words <= SHORT_WORDS and 100 * chars <= SHORT_PERCENT * total
            if menu or (short and has_article and mark.named and not headed):
                light.add(mark.slot)
        return {slot for slot in light if times[slot] == 1}

    def _kept_marks(self) -> list[bool]:
        slots = self._light_slots()
        self.hashes.update(dict.fromkeys(slots, False))
        gone = slots & self.template
        marks = self.marks
        total = sum(m.shown for m in marks)
        whole = [m.shown for m in marks]
        for k in range(len(whole) - 1, 0, -1):
            whole[marks[k].around] += whole[k]
        kept = [True]
        for k, mark in enumerate(marks[1:], 1):
            stays = not mark.listed or 100 * whole[k] > MOST_PERCENT * total
            kept.append(kept[mark.around] and stays and mark.slot not in gone)
        left = sum(m.shown for m, keep in zip(marks, kept) if keep)
        return kept if 100 * left >= LEAST_PERCENT * total else [True] * len(kept)

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if top.junk:
            return
        text = unescape(text)
        words = text.split()
        if words:
            top.filled = True
            top.words += len(words)
            chars = sum(map(len, words))
            top.chars += chars
            mark = self.marks[top.mark]
            mark.chars += chars
            mark.words += len(words)
            if top.link:
                mark.links += chars
            if top.tag in HEADINGS:
                mark.headed = True
            if top.level:
                self.in_article += chars
            if not top.section:
                mark.shown += chars
        top.parts.append(text.encode("utf-8", "surrogatepass"))
        if not top.section:
            top.out.append((top.level, top.mark, text))

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag not in VOID:
                self._end_paragraph()
            self._space()
        if tag in VOID:
            return
        if tag in ENDS:
            names, bounds = ENDS[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in bounds:
                    break
                if self.stack[k].tag in names:
                    while len(self.stack) > k:
                        self._close()
        above = self.stack[-1]
        level = 2 if tag == "article" else 1 if tag == "main" else 0
        level = max(level, above.level)
        junk, marked = _is_junk(tag, attributes, level)
        section = self.lists and tag in SECTIONS and not (tag == "header" and level == 2)
        marked = marked and self.lists
        new = _Element(tag, above.junk or junk, above.mark, level)
        new.section, new.link = above.section or section, above.link or tag == "a"
        if not new.junk:
            if attributes and tag in BLOCK:
                new.named = _names(attributes)
            new.apart = marked or section
            slot = tag in SLOTS and not level
            if marked or slot:
                self.marks.append(_Mark(above.mark, marked, bool(new.named) or tag in SECTIONS))
                new.mark = len(self.marks) - 1
        self.stack.append(new)

    def _end_paragraph(self) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == "p":
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].tag in BLOCK:
                return

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].tag in BLOCK and tag not in BLOCK:
                return

    def _space(self) -> None:
        top = self.stack[-1]
        if not top.junk:
            top.out.append((top.level, top.mark, " "))

    def _close(self) -> None:
        done = self.stack.pop()
        above = self.stack[-1]
        if not done.junk:
            value = xxhash.xxh64_intdigest(done.tag.encode() + b"\0" + b"\1".join(done.parts))
            value -= (value >> 63) << 64
            if done.tag in BLOCK:
                inside = b"".join(n.to_bytes(8, "little", signed=True) for n in sorted(done.inside))
                shape = xxhash.xxh64_intdigest(f"{done.tag}\0{done.named}\0".encode("utf-8", "surrogatepass") + inside, seed=1)
                shape -= (shape >> 63) << 64
                above.inside.add(shape)
                if done.tag in SLOTS and not done.level:
                    self.marks[done.mark].slot = shape
            if done.filled:
                # Deleted elements count too, so that both passes hash their parents alike;
                # marked ones, such as adverts, do not tell their parents apart.
                if not done.apart:
                    above.filled = True
                    above.words += done.words
                    above.chars += done.chars
                    above.parts.append(value.to_bytes(8, "little", signed=True))
                long = done.words >= LONG_WORDS or done.chars >= LONG_CHARS
                if not done.section and _deletable(done.tag, done.level, done.words, long):
                    # The same subtree counts apart inside and outside of articles.
                    value = ~value if done.level else value
                    self.hashes[value] = long
                    if value in self.template:
                        done.out = []
            if not above.out:
                above.out = done.out
            else:
                above.out += done.out
        if done.tag in BLOCK:
            self._space()


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(lists: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages, hashes, longs = [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = Page(lists=lists)
            text = page.read(html.as_py())
            mark = np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64)
            # One row without a subtree, so that every page is counted.
            for value, long in [(None, False), *page.hashes.items()]:
                hosts.append(host)
                pages.append(int(mark))
                hashes.append(value)
                longs.append(long)
        columns = [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(longs, pa.bool_())], ["host", "page", "subtree", "long"])


def site_templates(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT, lists: bool = True
) -> DataFrame:
    """``host, n, template``: rows and template subtrees of each host, from ``pages(host, html)``.

    A template subtree is on at least ``min_percent`` of the host's different
    pages; a long one also on ``MANY_PAGES`` that are ``MANY_PERCENT`` of them, as
    a section's menu.  So a host has at most a hundred times as many as a page has
    elements.
    """
    found = pages.mapInArrow(partial(_subtrees, lists), "host string, page bigint, subtree bigint, long boolean")
    # Counted by task and page first; a frequent subtree is a row per different page, then one.
    counts = (
        found.groupBy("host", "subtree", "page")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("long").alias("long"))
        .groupBy("host", "subtree")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows"), F.max("long").alias("long"))
    )
    counts = write_through(counts, "subtrees")
    hosts = counts.where("subtree is null").select("host", F.col("pages").alias("all"), F.col("rows").alias("n"))
    frequent = counts.where(F.col("subtree").isNotNull() & (F.col("pages") >= min_pages))
    many = hosts.join(frequent.select("host", "subtree", "pages", "long"), "host", "left")
    often = F.col("long") & (F.col("pages") >= MANY_PAGES) & (100 * F.col("pages") >= MANY_PERCENT * F.col("all"))
    chosen = F.when((100 * F.col("pages") >= min_percent * F.col("all")) | often, F.col("subtree"))
    return write_through(many.groupBy("host", "n").agg(F.collect_list(chosen).alias("template")), "templates")


def _extract(lists: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, template in zip(batch.column("html"), batch.column("template").to_pylist()):
            texts.append(Page(frozenset(template or ()), lists).read(html.as_py()))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def main_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT, lists: bool = True
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Without ``lists`` only the templates decide what is no main text.

    A null page counts as empty and has an empty text; pages without a URL form
    a host of their own.  Repeated rows are extracted alike.  Further columns
    are ignored; an empty table gives no rows.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    templates = site_templates(rows.select("host", "html"), min_pages, min_percent, lists)
    total = templates.agg(F.sum("n")).first()[0] or 0
    with_template = hot_join(rows, templates, ["host"], "n", total).select("page_id", "url", "html", "template")
    texts = with_template.mapInArrow(partial(_extract, lists), "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
