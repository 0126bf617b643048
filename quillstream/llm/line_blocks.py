"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of text, and every line has a weight: its length, or nothing where it stands
outside of the page's marked article or, on a page that marks none, in a row of link lines.  Blocks that hold no
text of their own kind (menus, forms, scripts, notices and the like) give no lines.  The weights are summed over a sliding
window of lines.  The text starts where the sum first surges and ends where it last dives; a point that falls in a marked
article moves to that article's edge; and all lines of some weight between the points are kept, short ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names and the words that classes and ids use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe map menu nav noscript object optgroup option script search select style"
    " svg template textarea title video".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SCOPE = frozenset(("article", "main"))
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup"
    " promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that name no content: a class or id of these and of noise words, one of those at least, is noise ("ad-box"; not "share-price").
PLAIN_WORDS = frozenset(
    "area articles bar block bottom box button buttons container form icon icons inner item items left link links list outer panel posts primary right"
    " secondary site slot stories top unit wrap wrapper".split()
)
#: Inside a marked article these are text whatever their class or id.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: An open element of the first name ends where one of the others begins.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "p": BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"},
}
#: Of open elements further out than these, none ends.
BORDERS = frozenset("ul ol table dl div section article main td blockquote".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^>"'])*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LineBlockConfig:
    """window: lines summed.  surge: the sum, in characters, at which the text starts, and below
    which it ends; on a page that never reaches it, the largest sum.  links: the share of a line's characters in
    links from which it counts as a menu, if `window` such lines at least stand in a row."""

    window: int = 3
    surge: int = 80
    links: float = 0.5


@dataclass
class Line:
    text: str
    inside: int  # the number, from 1, of the element that marks the article; 0 outside of any
    linked: bool  # mostly links


def _names_noise(value: str) -> bool:
    """Whether one of the names in a class or id is a noise word, or made of such words and plain ones."""
    for name in value.split():
        words = set(_WORD.findall(name))
        if words & NOISE_WORDS and words <= NOISE_WORDS | PLAIN_WORDS:
            return True
    return False


def _is_noise(name: str, rest: str, inside: bool) -> bool:
    if name in NOISE:
        return True
    if not rest or name in ("html", "body"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            if name not in SCOPE and not (inside and name in TEXT) and _names_noise(value):
                return True
        elif key == "role" and value.strip() in NOISE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines_of(html: str, config: LineBlockConfig = LineBlockConfig()) -> list[Line]:
    """One line for each block that has text outside of noise."""
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()  # of the names on the stack
    borders: list[int] = []  # places on the stack of elements that a block may close, or that it must not look past
    noise = links = scope = articles = 0
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                share = len(" ".join("".join(linked).split())) / len(text)
                out.append(Line(text, articles if scope else 0, share >= config.links))
            pieces.clear()
            linked.clear()

    def pop(to: int) -> None:
        nonlocal noise, links, scope
        while len(stack) > to:
            name, bad = stack.pop()
            opened[name] -= 1
            if borders and borders[-1] == len(stack):
                borders.pop()
            if name in BLOCK:
                flush()
            noise -= bad
            links -= name == "a"
            scope -= name in SCOPE

    def add(raw: str) -> None:
        if raw and not noise:
            text = unescape(raw)
            pieces.append(text)
            if links:
                linked.append(text)

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["close"]:
            if opened[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            for k in reversed(borders):
                if name in CLOSED_BY.get(stack[k][0], ()):
                    pop(k)
                    break
                if stack[k][0] in BORDERS:
                    break
            flush()
        if name == "br":
            add(" ")
        if name in VOID:
            continue
        bad = _is_noise(name, m["rest"], scope > 0)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if not bad:
                add(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if m["rest"].rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in CLOSED_BY or name in BORDERS:
            borders.append(len(stack))
        stack.append((name, bad))
        opened[name] += 1
        noise += bad
        links += name == "a"
        if name in SCOPE:
            articles += not scope
            scope += 1
    flush()
    return out


def weights(lines: list[Line], config: LineBlockConfig = LineBlockConfig()) -> list[int]:
    """The length of each line, or 0: outside of an article where one is marked, and for `window` link lines or more in
    a row where none is.  An article of links only is one if the text outside of it is not longer."""
    inside = sum(len(x.text) for x in lines if x.inside)
    if any(x.inside and not x.linked for x in lines) or inside > 0 and inside >= sum(len(x.text) for x in lines if not x.linked):
        return [len(x.text) if x.inside else 0 for x in lines]
    out: list[int] = []
    for linked, group in groupby(lines, key=lambda x: x.linked):
        row = [len(x.text) for x in group]
        out += [0] * len(row) if linked and len(row) >= config.window else row
    return out


def surge_and_dive(weight: list[int], config: LineBlockConfig = LineBlockConfig()) -> tuple[int, int]:
    """The first line of the first window whose sum surges, and the end of the last one; the same where nothing weighs."""
    total = [0, *accumulate(weight)]
    n = len(weight)
    sums = [total[min(k + config.window, n)] - total[k] for k in range(n)]
    need = min(config.surge, max(sums, default=0))
    if not need:
        return 0, 0
    start = next(k for k in range(n) if sums[k] >= need)
    end = min(n, next(k for k in range(n - 1, -1, -1) if sums[k] >= need) + config.window)
    while not weight[start]:
        start += 1
    while not weight[end - 1]:
        end -= 1
    return start, end


def main_lines(lines: list[Line], config: LineBlockConfig = LineBlockConfig()) -> list[str]:
    """The lines of some weight between the surge and the dive, which move to the edges of the articles they fall in."""
    weight = weights(lines, config)
    start, end = surge_and_dive(weight, config)
    if start < end:
        while start and lines[start].inside and lines[start - 1].inside == lines[start].inside:
            start -= 1
        while end < len(lines) and lines[end - 1].inside and lines[end].inside == lines[end - 1].inside:
            end += 1
    return [x.text for x, w in zip(lines[start:end], weight[start:end], strict=True) if w]


def main_text(html: str | None, config: LineBlockConfig = LineBlockConfig()) -> str:
    return "\n".join(main_lines(lines_of(html or "", config), config))


def extract_pages(pages: DataFrame, config: LineBlockConfig = LineBlockConfig(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text (empty if none) and n_chars, its code points.

    Defined cases: null or empty html has the empty text; a page cut short is read to its end, an
    unfinished tag being dropped; unknown or unclosed elements end with their parent; an unclosed quote
    reaches to the next one; pages of any length are read whole, in time that grows with their length; null ids and
    urls and repeated rows stay as they are; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(h, config) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
