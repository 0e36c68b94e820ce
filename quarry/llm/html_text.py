"""Main text of web pages by line-block distribution.

Markup is stripped to blocks of text, one line each. What the markup declares to be something
else (scripts, styles, forms, menus, headers, footers, sidebars, adverts, notices, comments by
readers) leaves empty lines. The text lengths of sliding windows of lines are summed; where the
sums surge main text begins, where they dive it ends, and the lines between are kept. This
is done on every page. What the markup declares to be main text weights the lines: on a page with
article or main elements the lines outside them have no length, and each line in them has at
least that of a surge, since plain lengths would lose the short lines at articles' ends. On other
pages characters in links have no length, and a line next to a run, in the same container as the
run's last line there, is of the run too.

Cases: a null, empty or text-free page gives an empty text; rows that repeat are extracted
each by itself; elements that are never closed end with their parent or with the page; a tag
that never ends reaches to the end of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import column_or_null, each_row, table

#: Lines in a window, the share of the largest window's sum at which text surges, and the fewest
#: characters of a window there. So many are always text, however long the longest block is.
WINDOW, SURGE, LEAST, ENOUGH = 3, 0.2, 60, 80
#: Elements whose content is raw text up to their end tag.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no main text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas audio video map dialog menu xmp noembed noframes input datalist".split()
)
#: Elements that stand within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img output meter progress".split())
#: Words of class, id or role that mark what is no main text.
MARKED = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary banner "
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup share sharing social comment comments disqus respond "
    "related recommended recommendations widget toolbar pagination pager search searchbox login copyright skip-link contentinfo alert".split()
)
#: Parts of a name beside which a word of MARKED still marks what is no main text: share-bar does, share-price doesn't.
PLACES = frozenset(
    "area author avatar bar body bottom box block btn button buttons card cards col container content count date empty entry fixed float form global group head header "
    "icons id inner item items left link links list main meta mobile name outer page panel posts primary replies reply right row secondary section side site slot "
    "small sticky stories story text thread title toggle tools top unit user vertical web wrap wrapper zone".split()
)
#: Parts of a name that make a header or footer one of the text.
OF_TEXT = frozenset("article post entry section content story chapter title card heading".split())
#: A body or an article may carry such words without being one of these; text-level elements only if the word stands alone.
NEVER_MARKED = frozenset(("html", "body", "article", "main"))
ALONE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "td", "th", "tr", "table", "tbody"))
#: Elements that only shape a container's text: the container of a line is the nearest other one.
SHAPES = ALONE | frozenset(("ul", "ol", "li", "dl", "dt", "dd", "thead", "tfoot", "caption", "center", "hgroup", "header", "address"))
# a name, and attributes whose values may be quoted; a quote elsewhere is an ordinary character, as in browsers
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)""",
    re.S,
)
_MARK = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[\s_]+")
#: An open p or li is closed by these starts.
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Line(NamedTuple):
    """A block's text (empty where something was stripped), its characters in links, the article
    or main element around it (0: none) and its container."""

    text: str
    links: int
    article: int
    container: int


def _marks(name: str, attrs: str, in_article: bool) -> bool:
    """Whether class, id or role name something beside the main text."""
    for m in _MARK.finditer(attrs):
        for word in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()):
            if word in MARKED:
                return True
            parts = word.split("-")
            if len(parts) == 1 or name in ALONE or name in INLINE:
                continue
            marked = [p for p in parts if p in MARKED]
            if any(p in OF_TEXT for p in parts) or in_article:  # as a header in an article is the article's
                marked = [p for p in marked if p not in ("header", "footer", "masthead", "banner")]
            if marked and all(p in MARKED or p in PLACES or p in OF_TEXT or p.isdigit() for p in parts):
                return True
    return bool(_HIDDEN.search(attrs))


def lines(page: str) -> list[Line]:
    """The page's blocks in order."""
    out: list[Line] = []
    line: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, article, number
    opened: Counter[str] = Counter()
    dropped = in_links = number = 0
    linked = [0]
    inside: list[int] = []  # the open articles, outermost first
    containers: list[int] = [0]
    pos, n = 0, len(page)

    def text(raw: str) -> None:
        if raw and not dropped:
            line.append(raw)
            if in_links:
                linked[0] += len(raw.strip())

    def flush() -> None:
        if line:
            got = " ".join(html.unescape("".join(line)).split())
            if got:
                out.append(Line(got, min(linked[0], len(got)), inside[0] if inside else 0, inside[0] if inside else containers[-1]))
            line.clear()
        linked[0] = 0

    def stripped() -> None:
        """Empty lines where something was: windows across it are empty."""
        if not out or out[-1].text:
            out.extend([Line("", 0, 0, -1)] * WINDOW)

    def close(to: int) -> None:
        nonlocal dropped, in_links
        while len(stack) > to:
            name, drops, is_article, k = stack.pop()
            opened[name] -= 1
            if name not in INLINE:
                flush()
            dropped -= drops
            if drops and not dropped and name not in INLINE:
                stripped()
            if is_article:
                inside.pop()
                stripped()
            in_links -= name == "a"
            if containers[-1] == k:
                containers.pop()

    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[1]:
            name = m[1].lower()
            if name in ("br", "p") and not opened[name]:
                flush()
            if opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break  # a stray end tag doesn't close the block around it
        elif m[2]:
            name, attrs = m[2].lower(), m[3]
            if name not in INLINE:
                flush()
            if name in _CLOSES_P:
                if opened["p"]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            close(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table"):
                        break
            if name in VOID or (attrs.endswith("/") and name not in RAW):
                continue
            drops = name in DROPPED or (name == "header" and not inside) or (bool(attrs) and name not in NEVER_MARKED and _marks(name, attrs, bool(inside)))
            is_article = name in ("article", "main") and not dropped
            if drops and name not in INLINE:
                flush()
            number += 1
            if is_article:
                stripped()
                inside.append(number)
            if name not in INLINE and name not in SHAPES and name not in ("html", "body"):
                containers.append(number)
            stack.append((name, drops, is_article, number))
            opened[name] += 1
            dropped += drops
            in_links += name == "a"
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                pos = end.start() if end else n
    close(0)
    flush()
    return out


def weights(found: list[Line]) -> list[int]:
    """The lengths that count in the windows' sums."""
    if any(x.article for x in found):
        return [len(x.text) + ENOUGH if x.article else 0 for x in found]
    return [len(x.text) - x.links for x in found]


def distribution(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs [start, end) of lines between surge and dive points of the windows' sums."""
    if not any(sizes):
        return []
    sums = [sum(sizes[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(len(sizes))]
    low = min(ENOUGH, max(SURGE * max(sums), min(LEAST, max(sums))))
    runs, start = [], None
    for i, s in enumerate([*sums, -1]):
        if s >= low and start is None:
            start = i
        elif s < low and start is not None:
            runs.append((start, i))
            start = None
    return runs


def main_text(page: str | None) -> str:
    """The main text of one page; its blocks are lines."""
    found = lines(page or "")
    sizes = weights(found)
    kept: set[int] = set()
    declared = any(x.article for x in found)
    for start, end in distribution(sizes):
        # a window reaches over its run's edges, to lines without length
        while start < end and not sizes[start]:
            start += 1
        while end > start and not sizes[end - 1]:
            end -= 1
        # neighbours in a run's container; not those in the page itself, where anything can stand
        while 0 < start < end and sizes[start - 1] and 0 < found[start].container == found[start - 1].container:
            start -= 1
        while start < end < len(found) and sizes[end] and 0 < found[end].container == found[end - 1].container:
            end += 1
        kept.update(range(start, end))
    if kept and not declared:  # lines between two surges are of the same text
        kept = set(range(min(kept), max(kept) + 1))
    return "\n".join(found[i].text for i in sorted(kept) if found[i].text and (sizes[i] or not declared))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page with its main text. No shuffle."""
    rows = pages.select(column_or_null(pages, id_col, "long"), column_or_null(pages, url_col, "string"), column_or_null(pages, html_col, "string"))

    def run(page_id, url, page):
        text = main_text(page)
        return page_id, url, text, len(text)

    return each_row(rows, "page_id long, url string, text string, n_chars long", run)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
