"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a line for each block of text, and an empty one where a container (a div, a
section, an article and the like) begins or ends. Menus, headers, footers, sidebars, notices, adverts, forms and
comments, told by element or by whole words of class, id and role, leave `WINDOW` empty lines each, and blocks that are
mostly links leave one. The lengths of `WINDOW` consecutive lines are summed. A stretch of text surges at a line
whose sum is above a threshold, with the lines of text directly before it and a heading up to `WINDOW` lines
before, and dives at the next empty line whose sum is at the threshold or below. The threshold is the share `RISE` of the page's
largest sum, at most `STEEP` characters; so short lines beside the text, such as a copyright line in a box of its own, are no stretch.

The stretch with the most text is kept. Elements decide only what else belongs to it: if most of it is in article or
main elements, all lines of text in these, as an advert inside an article does not end it; otherwise the
other stretches in the innermost element around it.

Defined results: null and empty pages, and pages without text, give an empty text. Repeated pages are each a
row. Ties between stretches go to the first. Columns besides page_id, url and html are ignored; null ids and
urls stay null.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import utf8

WINDOW = 3
#: A stretch rises above this share of the largest sum of lengths, or above so many characters if that is less.
RISE, STEEP = 0.2, 86
#: Share of a block's characters inside links from which it is a menu.
LINKED = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements whose content is never text of the page.
SILENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|title|textarea|object|canvas|audio|video|select)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
ASIDE = frozenset("nav aside footer form menu dialog button fieldset".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id or role of what is beside the article.
BESIDE = frozenset(
    """ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination toolbar
    header masthead topbar footer bottombar sidebar sidebox rail aside widget widgets complementary contentinfo
    notice notices cookie cookies consent gdpr alert popup modal overlay dialog
    comment comments commentlist disqus respond replies discussion
    form search login signup subscribe subscription newsletter
    share sharing social related recommended recommendations teaser""".split()
)
#: Words after these in a name, such as comment-list, that leave the meaning as it is.
PLAIN = frozenset(
    "slot box list area section container wrapper wrap block bar links buttons posts articles stories items item group panel unit inner outer holder left right top bottom".split()
)
#: Blocks of text; other elements are containers.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li br hr dt dd tr td th ul ol dl table thead tbody tfoot blockquote pre figure figcaption caption address details summary".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Of these, what inside an article holds its title.
TITLES = frozenset(("header", "masthead"))
#: Words that say that the class names a layout, not the element's own role.
LAYOUT = frozenset(("has", "with", "no", "without"))


def beside(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether the element holds something other than the article."""
    if tag in ASIDE or tag == "header" and not inside_main:
        return True
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            continue
        for word in value.split():
            # the last word names the thing: a top-banner is a banner, related-work is work
            parts = re.findall("[a-z]+", word)
            while len(parts) > 1 and parts[-1] in PLAIN:
                parts.pop()
            if parts and parts[-1] in (BESIDE - TITLES if inside_main else BESIDE) and not LAYOUT & set(parts):
                return True
    return False


class Line(NamedTuple):
    """A line of a page; html and body don't count as elements around it."""

    text: str
    main: int  # number of its article or main element, 0 without
    around: int  # number of the innermost element around it, 0 without; elements are numbered as they open
    heading: bool


def lines(page: str) -> list[Line]:
    """The lines of a page in order."""
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Line], list[int]]:
    """The lines of a page in order, and for each element the one around it. The time is in proportion to the page."""
    page = SILENT.sub("", page)
    out: list[Line] = []
    # open elements: name, beside the article, main element, its name, the element around
    stack: list[tuple[str, bool, int, str, int]] = []
    opened: Counter[str] = Counter()
    outer = [0]
    count, in_link, linked, text = 0, False, 0, []

    def close(container: bool = False) -> None:
        """Ends the line of text, if there is one, and adds an empty one at the edge of a container."""
        nonlocal in_link, linked, text
        tag, hidden, main, _, around = stack[-1] if stack else ("", False, 0, "", 0)
        block = " ".join(entities.unescape("".join(text)).split())
        if block:
            menu = not main and linked >= LINKED * sum(map(len, text))
            out.append(Line("" if hidden or menu else block, main, around, tag in HEADINGS))
        if container and not hidden:
            out.append(Line("", main, around, False))
        in_link, linked, text = False, 0, []

    at = 0
    for m in TAG.finditer(page) if ">" in page else ():
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "a":
            in_link = not m[1]
        edge = tag not in INLINE and tag not in BLOCKS and tag not in VOID
        if m[1]:
            known = opened[tag] > 0
            if known or tag not in INLINE:
                close(edge)
            while known:
                name = stack.pop()[0]
                opened[name] -= 1
                known = name != tag
            continue
        if tag not in INLINE:
            close(edge)
            if stack and stack[-1][0] in ("p", *HEADINGS) and tag not in VOID:
                opened[stack.pop()[0]] -= 1
        _, hidden, main, name, around = stack[-1] if stack else ("", False, 0, "", 0)
        if tag in VOID:
            continue
        apart = not hidden and beside(tag, m[3], main > 0)
        if tag in INLINE and not apart:
            continue
        if apart:
            close()
            out.extend([Line("", main, around, False)] * WINDOW)
        elif tag in MAIN and not hidden and (not main or tag == "article" and name == "main"):
            count += 1
            main, name = count, tag
        if tag not in ("html", "body", "p"):
            outer.append(around)
            around = len(outer) - 1
        stack.append((tag, hidden or apart, main, name, around))
        opened[tag] += 1
    text.append(page[at:])
    close()
    return out, outer


def innermost(rows: list[Line], outer: list[int]) -> range:
    """The numbers of the innermost element around all rows and of those in it.

    Numbers rise as elements open, so this element is also the innermost one around the least and the greatest number.
    """
    low, high = min(r.around for r in rows), max(r.around for r in rows)
    while low != high:
        low, high = min(low, outer[high]), max(low, outer[high])
    # the elements in it have the numbers that follow, as long as the one around them is in it too
    end = low + 1
    while end < len(outer) and outer[end] >= low:
        end += 1
    return range(low, end)


def stretches(rows: list[Line], window: int = WINDOW) -> list[tuple[int, int]]:
    """[first, end) lines of the stretches between surge and dive."""
    sizes = [len(r.text) for r in rows]
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    sums = [total[min(i + window, len(rows))] - total[i] for i in range(len(rows))]
    least = min(STEEP, RISE * max(sums, default=0))
    out, i = [], 0
    while i < len(rows):
        if not sizes[i] or sums[i] <= least:
            i += 1
            continue
        s, low = i, out[-1][1] if out else 0
        while s > low and sizes[s - 1]:
            s -= 1
        for k in range(s - 1, max(low, s - 1 - window) - 1, -1):
            if sizes[k]:
                s = k if rows[k].heading else s
                break
        while s > low and sizes[s - 1]:
            s -= 1
        while i < len(rows) and (sizes[i] or sums[i] > least):
            i += 1
        out.append((s, i))
    return out


def main_text(page: str, window: int = WINDOW) -> str:
    """The text between the surge and the dive with the most text, blocks parted by line feeds."""
    rows, outer = parsed(page)
    found = stretches(rows, window)
    if not found:
        return ""
    first, end = max(found, key=lambda x: sum(len(r.text) for r in rows[slice(*x)]))
    best = [r for r in rows[first:end] if r.text]
    inside = [r for r in best if r.main]
    if 2 * sum(len(r.text) for r in inside) > sum(len(r.text) for r in best):
        mains = {r.main for r in inside}
        return "\n".join(r.text for r in rows if r.text and r.main in mains)
    element = innermost(best, outer)
    # outside all elements the other stretches belong to nothing
    kept = (r for s, e in found for r in rows[s:e] if r.text and (s == first or element.start and r.around in element))
    return "\n".join(r.text for r in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py().decode("utf-8", "replace")) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", utf8("html").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
