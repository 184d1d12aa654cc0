"""Main text of web pages by line-block distribution.

Markup is stripped: elements that HTML itself sets apart (menus, footers, forms, scripts and the like, or elements whose
whole class or id says so) go with their text, and every other block-level element starts a new line. Each line gets a
weight. Over the lines, the weights of WINDOW lines are summed in a sliding window: where the sum surges a region of text
begins, where it dives to nothing the region ends, and the lines between are kept, on every page. Light lines at the
edges of a region, which the window only brushed, are cut off; of several regions the large ones are kept.

Weights: a line weighs its characters outside of links, or nothing if most of it is link text, and somewhat more in a
paragraph or heading. Where the page marks an article, lines of it weigh at least a surge each, and lines outside of it
a fiftieth of their length: so a long text beside a mark that holds next to nothing still wins.

Defined cases: null or empty html, and pages without text, give the empty text; unclosed comments, scripts and tags
reach to the end of the page; unclosed elements are closed by the next one of their kind, their parent or the page's
end; a form that holds an article, or some long paragraphs, is the page's frame and no form; character references are decoded
once, in each piece of text by itself; any white space, a line break element and a no-break space included, becomes
one space; attributes may have any length; a page of any length is read whole, in time linear in it; repeated rows give
the same text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

WINDOW = 3
#: Weight of a window at which a text begins; half of the heaviest window's on pages that have none of this weight.
SURGE = 80
#: Lines at the edge of a region that weigh less than this share of a surge are cut off.
EDGE = 0.25
#: What a line weighs more in a paragraph or heading, as a share of a surge.
PARAGRAPH = 0.25
#: What a character outside of the marked article weighs.
OUTSIDE = 0.02
#: Of several regions, those with at least this share of the heaviest one's weight, or with a line of an article, are kept.
ALSO = 0.1

#: Elements by role in HTML.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
_DROPPED = frozenset("nav footer aside form button select option fieldset dialog menu search datalist noscript template svg object audio video canvas".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = _HEADINGS | frozenset("p blockquote pre figcaption".split())
#: Elements whose class and id are looked at, and those of them for which an id counts.
_NAMED = frozenset("article aside details div dl dd figure header li main ol p section span summary table td ul".split())
_NAMED_BY_ID = frozenset("div section ul ol dl table span header".split())
#: Words that class and id names of side matter are made of, and words that may stand beside them.
_SIDE = frozenset("ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommend recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split())
_BESIDE = frozenset("area article bar block blog bottom box buttons center column container entry form global group header holder icons inner item items left line link links list main media module outer page panel post posts reader right row section secondary site slot small stories story strip thread title top unit user wrap wrapper x".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

# possessive throughout: no part is read twice, however broken the page
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(>?)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}
_FORM_END = re.compile(r"</form(?=[\s/>])", re.IGNORECASE)
#: What a form holds that is the page's own frame and no form to fill in: a marked part, or some long paragraphs.
_CONTENT = re.compile(r"<(?:article|main)(?=[\s/>])|articleBody|role=\"main\"", re.IGNORECASE)
_PARAGRAPH = re.compile(r"<p(?:\s[^<>]*+)?>[^<]{60}", re.IGNORECASE)
FORM_PARAGRAPHS = 3
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _is_side(token: str) -> bool:
    """Whether a class or id says side matter: one of its words does, and no word says anything else."""
    parts = [p.lower() for p in _PART.findall(token)]
    return any(p in _SIDE for p in parts) and all(p in _SIDE or p in _BESIDE or p.isdigit() for p in parts)


def _set_apart(name: str, rest: str, inside: bool) -> bool:
    """Whether an element's own markup says that its text is no main text."""
    if name in _DROPPED or name == "header" and not inside:
        return True
    if not rest or "=" not in rest and "hidden" not in rest.lower() or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class" and name in _NAMED or key == "id" and name in _NAMED_BY_ID:
            tokens = value.split()
            all_of_them = name in ("article", "main", "p", "li", "td")
            if tokens and (all if all_of_them else any)(map(_is_side, tokens)):
                return True
        elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and _HIDDEN.search(value):
            return True
    return False


class Line(NamedTuple):
    text: str
    free: int  # characters outside of links
    paragraph: bool
    mark: int  # 2 in an article, 1 in what else the page marks as its main part


class _Open(NamedTuple):
    name: str
    mark: int
    dropped: bool


class _Elements:
    """The open elements, with their places by name, so that no look-up walks the stack."""

    def __init__(self):
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, e: _Open) -> None:
        self.places[e.name].append(len(self.stack))
        if e.name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.places[e.name].pop()
            if e.name in _BLOCK:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """The end tag of an inline element does not reach beyond the block that it is in."""
        at = self.places[name]
        if at and (name in _BLOCK or not self.blocks or self.blocks[-1] < at[-1]):
            self.cut(at[-1])

    def make_room(self, name: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        if self.blocks:
            top = self.stack[self.blocks[-1]].name
            if top == "p" or top == "head" or top == name and name in ("li", "dt", "dd", "tr", "option") or {top, name} == {"dt", "dd"}:
                self.cut(self.blocks[-1])

    @property
    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", 0, False)


def _frames(html: str, start: int, stop: int) -> bool:
    """Whether a form is wrapped around content."""
    return _CONTENT.search(html, start, stop) is not None or len(_PARAGRAPH.findall(html, start, stop)) >= FORM_PARAGRAPHS


def _mark(name: str, rest: str) -> int:
    return 2 if name == "article" else 1 if name == "main" or "articleBody" in rest or 'role="main"' in rest else 0


def lines_of(html: str) -> list[Line]:
    found: list[Line] = []
    open_ = _Elements()
    text: list[str] = []
    linked = at = look = form_end = 0
    paragraph = False

    def add(part: str) -> None:
        nonlocal linked, paragraph
        if part and not open_.top.dropped:
            part = unescape(part)  # node by node, so that no reference comes of two
            text.append(part)
            if open_.places["a"]:
                linked += len(part)
            if open_.blocks:
                paragraph = paragraph or open_.stack[open_.blocks[-1]].name in _PARAGRAPHS

    def end_line(mark: int) -> None:
        nonlocal linked, paragraph
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append(Line(line, max(0, len(line) - linked), paragraph, mark))
            text.clear()
        linked, paragraph = 0, False

    while (lt := html.find("<", look)) >= 0:
        tag = _TAG.match(html, lt)
        if tag is None:
            kind = html[lt + 1 : lt + 2]
            if not kind or kind not in "!?/":
                look = lt + 1  # a plain sign
                continue
            add(html[at:lt])
            comment = html.startswith("<!--", lt)
            stop = html.find("-->" if comment else ">", lt + (4 if comment else 1))
            at = look = len(html) if stop < 0 else stop + (3 if comment else 1)
            continue
        add(html[at:lt])
        at = look = tag.end()
        if not tag[4]:  # the page ends in it
            at = len(html)
            break
        name, rest = tag[2].lower(), tag[3]
        if tag[1]:
            if name in _BLOCK:
                end_line(open_.top.mark)
            open_.close(name)
        elif name in _RAW:
            stop = _RAW_END[name].search(html, at)
            at = look = stop.start() if stop else len(html)
        elif name in ("br", "wbr"):
            add("" if name == "wbr" else " ")
        else:
            if name in _BLOCK:
                end_line(open_.top.mark)
                open_.make_room(name)
            elif name in ("td", "th"):
                add(" ")
            if name not in _VOID:
                around, frames = open_.top, False
                if name == "form":  # one within another is none, so every form is looked through once
                    frames = lt < form_end
                    if not frames:
                        stop = _FORM_END.search(html, at)
                        form_end = stop.start() if stop else len(html)
                        frames = _frames(html, at, form_end)
                if not (rest.endswith("/") and name in ("svg", "object", "canvas", "audio", "video")):
                    open_.push(_Open(name, max(around.mark, _mark(name, rest)), around.dropped or _set_apart("div" if frames else name, rest, around.mark > 0)))
    add(html[at:])
    end_line(open_.top.mark)
    return found


def weigh(lines: list[Line]) -> tuple[list[float], list[bool]]:
    """The weight of each line, and whether it is in the article that the page marks."""
    mark = max((x.mark for x in lines), default=0)
    weights = []
    for x in lines:
        own = x.free if 2 * x.free >= len(x.text) else 0
        own += PARAGRAPH * SURGE if own and x.paragraph else 0
        weights.append(len(x.text) + SURGE if mark and x.mark == mark else OUTSIDE * own if mark else own)
    return weights, [mark > 0 and x.mark == mark for x in lines]


def chosen(weights: list[float], marked: list[bool]) -> list[int]:
    """The lines between surge and dive of the windows' sums."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = min(SURGE, max(sums, default=0) / 2)
    regions: list[tuple[int, int, float]] = []
    i = 0
    while i < len(sums):
        if sums[i] < surge or not sums[i]:
            i += 1
            continue
        start = i
        while i < len(sums) and sums[i]:
            i += 1
        stop = i
        while weights[start] < EDGE * surge:
            start += 1
        while weights[stop - 1] < EDGE * surge:
            stop -= 1
        regions.append((start, stop, sum(weights[start:stop])))
    most = max((r[2] for r in regions), default=0)
    return [k for start, stop, weight in regions if weight >= ALSO * most or any(marked[start:stop]) for k in range(start, stop)]


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    return "\n".join(lines[k].text for k in chosen(*weigh(lines)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
