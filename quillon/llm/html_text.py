"""Main text of web pages by two-pass block rules.

Pass one classifies blocks by length, stop-word density and link density;
pass two lets short, undecided blocks inherit the label of their nearest
decided neighbours.  Where a page has neither article nor main and no block has
the stop words of a language this reads, length and link density decide alone.
Blocks inside menus, page headers, footers, sidebars,
notices, adverts, forms and comments are decided from their markup.

Null and empty pages give empty text.  Markup that is never closed runs to
the end of the page.  Very long pages and attributes are read whole, in time
that grows with their length.  Repeated pages give repeated rows; an empty
table gives an empty result.  Only page_id, url and html are read, whatever
other columns are called.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, map_rows

#: Frequent function words of the languages this reads.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its
    more my no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what
    when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me mes nous on ou par pas plus pour qu que qui sa
    se ses son sont sur tout un une vous
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach
    nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden wie wir zu zum zur
    al como con cuando del el ella ellos en entre era es esta este fue ha han hasta hay la las lo los más me mi muy nos o para pero por que se
    ser si sin sobre su sus también te tiene todo un una unos y ya yo""".split()
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose content is never prose of the page.
OPAQUE = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select button datalist noembed noframes map".split())
RAW = frozenset("script style textarea title noembed noframes iframe".split())
SIDE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail widget widgets menu nav navbar
    navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social comment comments commentlist disqus respond replies related recommended
    recommendations trending pagination pager toolbar search paywall copyright disclaimer tags skip""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

SHORT, GOOD_LENGTH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.25
LINKS, LINKS_INSIDE = 0.25, 0.5

_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile("[\"'>]")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Index of the > that ends the tag at `at`, outside quotes; the first > where no tag ends so, -1 if none.

    dead: the page's opening quotes known to lead to no end, each of which is followed only once.
    """
    first = page.find(">", at)
    if first < 0:
        return -1
    pos, opened = at, []
    while (m := _QUOTE.search(page, pos)) is not None:
        if m[0] == ">":
            return m.start()
        if page[m.start() - 1 : m.start()] != "=" and not page[pos : m.start()].rstrip().endswith("="):
            pos = m.end()  # a stray quote, not an attribute's
            continue
        shut = -1 if m.start() in dead else page.find(m[0], m.end())
        opened.append(m.start())
        if shut < 0:
            break
        pos = shut + 1
    dead.update(opened)
    return first


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    """Whether the element's name or attributes say that it is no part of the article."""
    if tag in SIDE:
        return True
    if tag == "header":
        return not inside
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    words: set[str] = set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words.update(_SPLIT.split(value))
        elif name == "role" and value.strip() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return bool(words & MARKS) or ("header" in words and not inside and not words & {"article", "post", "entry"})


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's blocks in order: text, characters in links, whether within an article or main element, whether decided by markup."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, is boilerplate, is an article
    open_of: dict[str, int] = {}
    bad = inside = linked = 0
    in_link = False
    dead: set[int] = set()
    low = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, linked, inside > 0, bad > 0))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal bad, inside
        name, is_bad, is_article = stack.pop()
        open_of[name] -= 1
        bad -= is_bad
        inside -= is_article
        return name

    pos, end = 0, len(page)
    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            text = page[pos:at]
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        if at == end:
            break
        nxt = page[at + 1 : at + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", at):
                shut = page.find("-->", at + 4)
                pos = end if shut < 0 else shut + 3
            else:
                shut = page.find(">", at)
                pos = end if shut < 0 else shut + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            parts.append("" if closing else "<")
            pos = at + 1
            if closing:
                shut = page.find(">", at)
                pos = end if shut < 0 else shut + 1
            continue
        shut = _tag_end(page, m.end(), dead)
        if shut < 0:
            break
        tag, attrs, pos = m[0].lower(), page[m.end() : shut], shut + 1
        if closing:
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                flush()
            if open_of.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in OPAQUE:
            if attrs.endswith("/") and tag not in RAW:
                continue
            if low is None:
                low = page.lower()
                if len(low) != len(page):  # some letters grow, as U+0130 does
                    low = page.translate(_ASCII_LOWER)
            shut = low.find(f"</{tag}", pos)
            if shut < 0 and tag in ("head", "title", "button", "select", "noscript"):
                continue  # never closed: its content stands in the page
            shut = end if shut < 0 else low.find(">", shut)
            pos = end if shut < 0 else shut + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = "href" in attrs
        if tag in BLOCK:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li" or tag in ("dt", "dd") and stack[-1][0] in ("dt", "dd")):
                pop()
        if tag in VOID or attrs.endswith("/"):
            continue
        is_bad = _boilerplate(tag, attrs, inside > 0)
        if tag in BLOCK or is_bad:
            if is_bad:
                flush()
            stack.append((tag, is_bad, is_article := tag in ("article", "main")))
            open_of[tag] = open_of.get(tag, 0) + 1
            bad += is_bad
            inside += is_article
    flush()
    return out


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """True for the blocks of the main text."""
    first: list[bool | None] = []
    foreign = not any(f[2] for f in found) and max((_stop_density(text) for text, _, _, side in found if not side and len(text) >= SHORT), default=0) < STOP_LOW
    for text, linked, inside, side in found:
        if side:
            first.append(False)
            continue
        density = linked / len(text)
        if density > (LINKS_INSIDE if inside else LINKS):
            first.append(False)
            continue
        if len(text) < SHORT:
            first.append(None if not linked or inside else False)
            continue
        stop = _stop_density(text)
        if inside or foreign:
            first.append(True if stop >= STOP_LOW or len(text) >= GOOD_LENGTH else None)
        elif stop >= STOP_HIGH or stop >= STOP_LOW and len(text) >= GOOD_LENGTH:
            first.append(True)
        else:
            first.append(None if stop >= STOP_LOW else False)
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for way, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, tuple[int, bool] | None] = {True: None, False: None}
        for i in way:
            inside = found[i][2]
            near[i] = last[inside]
            if first[i] is not None and not (inside and found[i][3]):  # what markup takes out of an article says nothing of its rest
                last[inside] = (i, first[i])
    out = []
    for i, label in enumerate(first):
        if label is None:
            a, b = before[i], after[i]
            if a is None and b is None:
                label = found[i][2] or all(x is None or x is False for x in first) and not any(f[2] for f in found)
            elif a is None or b is None:
                label = (a or b)[1]
            elif a[1] == b[1]:
                label = a[1]
            else:
                label = found[i][2] or (a if i - a[0] < b[0] - i else b)[1]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The page's main text; blocks joined by an empty line."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b[0] for b, good in zip(found, labels(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def make():
        def row(page_id, url, page):
            text = main_text(page)
            return page_id, url, text, len(text)

        return row

    kind, ids = id_type(pages, "page_id")
    fields = [("page_id", ids), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    return map_rows(pages, ["page_id", "url", "html"], make, fields, f"page_id {kind}, url string, text string, n_chars bigint")
