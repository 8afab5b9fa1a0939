"""Main text of web pages by line-block distribution (operator 6).

Markup is stripped into lines, one for each block element.  A line weighs its characters outside
links, or nothing where its elements say that it is no article text (navigation, forms, adverts,
comments and so on, by tag, role or class).  Sums of weights over a sliding window of lines make the
distribution; it surges where the article begins and dives where it ends, and the lines between are kept, of every
surge.  Names are weights only: lines in elements that are named as the article's get as much more as a surge takes, and
lines outside weigh nothing then, unless a run of them weighs more than all that is named.

The scanner passes each page once; quotes and elements that are never closed cost no more than others.

Nulls: a null or empty page gives an empty text; ``page_id`` and ``url`` are carried as they are, ties and repeated
rows too.  Pages are independent rows, whole and of any length; an empty table gives no rows."""

from __future__ import annotations

import html
import re
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose text is never article text
DROPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video nav footer aside form button "
    "select option textarea dialog menu datalist fieldset legend applet map".split()
)
# Elements that end a line
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements without content
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
# Roles and words of class names and ids that mark what is no article text
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion promoted "
    "banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar "
    "comment comments reply replies respond discussion disqus notice notices alert alerts cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager toolbar copyright legal disclaimer hidden skip search form".split()
)
# First words of names that say what a container has, and owners of a header that is the article's
CONTAINERS = frozenset("has with no without layout".split())
OWNERS = frozenset("article entry post story content".split())
# Names of elements that hold the article
HOLDERS = frozenset(
    "article-body articlebody article-content article-text post-content post-body entry-content story-body story-content "
    "main-content maincontent content article post entry story main".split()
)
RAW = re.compile(r"</(script|style|textarea|title|noscript|template|svg|iframe)\b[^>]*>", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote without its other half ends with the tag, so every < is read to an end
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^>]*+)?)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NOWHERE = (0, 0)
#: Elements that end where the next of their sort begins, but for those in an inner one of the others.
ENDING = {"li": ("ul", "ol"), "td": ("tr", "table"), "tr": ("table",), "dd": ("dl",), "dt": ("dl",)}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links; 0 for what is no article text, -1 for links alone
    holder: tuple[int, ...]  # rank, number and then the numbers of outer ones, of the element that holds the article here


def _named(names: str) -> bool:
    """Do class names or ids mark what is no article text?  The first or the last word of a name counts."""
    for name in names.split():
        words = [w.lower() for w in PARTS.findall(name)]
        if words and not WORDS.isdisjoint((words[0], words[-1])):
            own_head = words[0] in OWNERS and words[-1] == "header"
            if len(words) == 1 or not (words[0] in CONTAINERS or own_head):
                return True
    return False


def _element(tag: str, attributes: str) -> tuple[bool, int]:
    """(no article text, rank as holder of the article)"""
    if tag in DROPPED:
        return True, 0
    holds = 3 if tag == "article" else int(tag == "main")
    dropped = False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if tag not in ("html", "body"):
                    dropped |= _named(value)
                    holds = max(holds, 2 * any(x.lower() in HOLDERS for x in value.split()))
            elif key == "role":
                dropped |= value.lower() in ROLES
                holds = max(holds, {"article": 3, "main": 1}.get(value.lower(), 0))
            elif key == "itemprop":
                holds = max(holds, 2 * (value.lower() == "articlebody"))
            elif key == "hidden":
                dropped = True
            elif key == "aria-hidden":
                dropped |= value.lower() == "true"
            else:
                dropped |= "display:none" in value.replace(" ", "").lower()
    return dropped, 0 if dropped else holds


def lines(page: str) -> list[Line]:
    """One line per block with text.  Within a holder only one of higher rank begins another: an
    ``article`` ranks above named elements, those above ``main``."""
    out: list[Line] = []
    stack: list[tuple[str, bool, tuple[int, ...]]] = []  # tag, no article text, holder
    buffer: list[str] = []
    state = {"dropped": 0, "link": 0, "linked": 0, "holders": 0}

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if state["link"]:
                state["linked"] += len(text)

    def end_line() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                weight = 0 if state["dropped"] else max(0, len(text) - state["linked"])
                holder = stack[-1][2] if stack else NOWHERE
                out.append(Line(text, weight or (0 if state["dropped"] else -1), holder))
            buffer.clear()
        state["linked"] = 0

    places: dict[str, list[int]] = {}  # where in the stack each tag is
    blocks: list[int] = []  # and where elements are that end lines
    forms: list[int] = []  # and those forms that are no article text

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def pop_to(size: int) -> None:
        while len(stack) > size:
            tag, dropped, _ = stack.pop()
            places[tag].pop()
            for some in (blocks, forms):
                if some and some[-1] == len(stack):
                    some.pop()
            state["dropped"] -= dropped
            state["link"] -= tag == "a"

    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                end_line()
            if last(tag) >= 0:
                pop_to(last(tag))
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCKS or tag in DROPPED:
            end_line()
            if blocks and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            if last(tag) > max(map(last, ENDING.get(tag, (tag,)))):
                pop_to(last(tag))
        if tag in VOID:
            continue
        dropped, holds = _element(tag, m[3])
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        holder = stack[-1][2] if stack else NOWHERE
        if tag == "header" and holder == NOWHERE:
            dropped = True  # the page's own; one inside the article holds its heading
        if tag == "article" and holds:  # a form around the whole page does not make the article a form
            for i in forms:
                stack[i] = ("form", False, stack[i][2])
                state["dropped"] -= 1
            forms.clear()
        if holds > holder[0]:
            state["holders"] += 1
            holder = (holds, state["holders"], *(holder[1:] if holder[0] else ()))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        if tag == "form" and dropped:
            forms.append(len(stack))
        stack.append((tag, dropped, holder))
        state["dropped"] += dropped
        state["link"] += tag == "a"
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"):
            closing = next((c for c in RAW.finditer(page, at) if c[1].lower() == tag), None)
            at = closing.start() if closing else len(page)
    add(page[at:])
    end_line()
    return out


def spans(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Runs of lines from a surge point, where the sum over the next ``window`` lines first exceeds
    ``surge``, to the dive point, where it falls to nothing."""
    n = len(weights)
    before = [0, *accumulate(weights)]
    sums = [before[min(n, i + window)] - before[i] for i in range(n)]
    out, start = [], None
    for i in range(n + 1):
        if start is None and i < n and weights[i] > 0 and sums[i] > surge:
            start = i
        elif start is not None and (i == n or sums[i] == 0):
            stop = i
            while weights[stop - 1] <= 0:
                stop -= 1
            out.append((start, stop))
            start = None
    return out


def bounds(found: list[Line]) -> set[int]:
    """Lines inside the elements that hold the article.  The outermost are taken; one whose inner holders
    have half of its weight is narrowed to them, and those of less than a quarter of the heaviest go."""
    size: dict[int, int] = {}
    inner: dict[int, set[int]] = {}
    for x in found:
        chain = x.holder[1:] if x.holder[0] else ()
        for k, h in enumerate(chain):
            size[h] = size.get(h, 0) + max(x.weight, 0)
            inner.setdefault(chain[k + 1] if k + 1 < len(chain) else 0, set()).add(h)

    def belonging(outer: int) -> set[int]:
        some = inner.get(outer, set())
        most = max((size[h] for h in some), default=0)
        return {h for h in some if size[h] and size[h] * 4 >= most}

    taken, left = set(), belonging(0)
    while left:
        h = left.pop()
        some = belonging(h)
        if some and 2 * sum(size[x] for x in some) >= size[h]:
            left |= some
        else:
            taken.add(h)
    return {i for i, x in enumerate(found) if x.holder[0] and not taken.isdisjoint(x.holder[1:])}


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    found = lines(page) if page else []
    weights = [max(x.weight, 0) for x in found]
    held = sorted(bounds(found))
    menu = _menus([found[i] for i in held])
    outside, named = list(weights), [0] * len(found)
    for k, i in enumerate(held):
        outside[i] = 0
        named[i] = surge + max(weights[i], 1) if found[i].weight and k not in menu else 0
    most = max((sum(outside[a:b]) for a, b in spans(outside, window, surge)), default=0)
    if any(named) and sum(weights[i] for i in held) >= most:
        weights = named
    else:
        named = [abs(x.weight) for x in found]
    runs = spans(weights, window, surge) or spans(weights, window, 0)
    return " ".join(found[i].text for a, b in runs for i in range(a, b) if named[i])


def _menus(found: list[Line]) -> set[int]:
    """Lines in runs of three or more that are links and nothing else."""
    out: set[int] = set()
    run: list[int] = []
    for k, x in enumerate([*found, Line("", 1, NOWHERE)]):
        if x.weight == -1:
            run.append(k)
        else:
            if len(run) >= 3:
                out.update(run)
            run = []
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
