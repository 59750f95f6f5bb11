"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element, sums of weights over sliding windows of lines give a curve, and the
text between a surge of that curve and the next dive is kept. Lines of page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments), known from their elements or the names in their class, id and role
attributes, are taken out with the markup, before the windows. A line weighs its letters outside links. Inside an
article or main element it weighs `MARK` letters more. On a page with such elements, a line outside them weighs less,
the larger the share s of all letters that they hold: (1 - s) times its letters less s times MARK, or nothing. So the
curve falls to zero beyond an article that holds the text of its page, and stays up where the mark is on a mere teaser.

The scan is linear in the length of a page, whatever is unclosed in it.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu button select textarea dialog noscript template svg iframe object head title label fieldset".split())
RAW = frozenset("script style noscript template svg iframe object textarea title".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}
#: Words in class, id and role attributes that mark furniture.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer footer form header login menu masthead modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

WINDOW, SURGE, MARK = 3, 60, 40

_EDGE = re.compile("[>\"']")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(f"</{name}", re.I | re.A)


def tokens(page: str):
    """(kind, start, end, name, attributes) of all markup: kind "open", "close", "cdata" or "other".

    A tag ends at the first > outside quotes. Where none comes any more, it and all later tags end at the next > of any
    kind; without one, the rest of the page is text. A comment without an end takes the rest of the page.
    """
    at, last, quoted, sections = 0, page.rfind(">"), True, True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield "other", at, end, "", ""
        elif sections and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            if end < 0:
                sections = False
                continue
            end += 3
            yield "cdata", at, end, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.index(">", at) + 1
            yield "other", at, end, "", ""
        else:
            tag = _TAG.match(page, at)
            if not tag:
                at += 1
                continue
            end = tag.end()
            while quoted:
                edge = _EDGE.search(page, end)
                if edge and edge[0] == ">":
                    end = edge.end()
                    break
                end = page.find(edge[0], edge.end()) + 1 if edge else 0
                if not end:
                    quoted = False
            if not quoted:
                end = page.index(">", tag.end()) + 1
            yield "close" if page[at + 1] == "/" else "open", at, end, tag[1].lower(), page[tag.end() : end - 1]
        at = end


def _decoded(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", text))


def _is_furniture(name: str, attrs: str) -> bool:
    if name in FURNITURE:
        return True
    if name in ("article", "main", "body", "html") or not attrs:
        return False
    return any(w in NAMES for _, v in _ATTR.findall(attrs) for w in _NAME.findall(v.lower()))


def lines(page: str) -> list[tuple[str, int, bool, int]]:
    """A (text, letters outside links, furniture?, depth of article elements) for each block with text."""
    out, parts = [], []  # parts: (text, in a link)
    stack: list[tuple[str, bool]] = []
    open_: Counter = Counter()
    bad = inside = links = 0

    def flush():
        if parts:
            text = _SPACE.sub(" ", _decoded("".join(t for t, _ in parts))).strip()
            if text:
                out.append((text, sum(len(t.strip()) for t, a in parts if not a), bad > 0, inside))
            parts.clear()

    def pop(to: int):
        nonlocal bad, inside
        while len(stack) > to:
            name, odd = stack.pop()
            open_[name] -= 1
            bad -= odd
            inside -= name in ("article", "main") and not odd

    at = 0
    for kind, start, end, name, attrs in tokens(page):
        if start < at:
            continue
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if kind == "cdata":
            parts.append((html.escape(page[start + 9 : end - 3]), links > 0))
        if not name:
            continue
        if name == "a":
            links = int(kind == "open")
            continue
        if name == "br":  # a line break is white space inside its block
            parts.append((" ", links > 0))
            continue
        if name in BLOCKS or name in FURNITURE:
            flush()
        if kind == "close":
            if open_[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name in RAW:
            close = _end_of(name).search(page, at)
            at = close.start() if close else len(page)
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        if name in BLOCKS or name in FURNITURE:
            odd = _is_furniture(name, attrs)
            stack.append((name, odd))
            open_[name] += 1
            bad += odd
            inside += name in ("article", "main") and not odd
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return out


def weights(letters: list[int], marked: list[bool]) -> list[float]:
    """What each line adds to the windows (see above)."""
    held = sum(n for n, m in zip(letters, marked, strict=True) if m)
    share = held / max(1, sum(letters)) if any(marked) else 0.0
    return [n + MARK if m else max(0.0, (1 - share) * n - share * MARK) for n, m in zip(letters, marked, strict=True)]


def kept_lines(weight: list[float], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines to keep. block(i) is the weight of lines i to i + window - 1.

    A range starts at a surge, a line where block reaches `surge`, and ends before the dive, the next line where block is
    zero; lines of no weight at its ends go. Without any surge, it starts where block is largest (the first such line).
    """
    n, total = len(weight), [0.0]
    for w in weight:
        total.append(total[-1] + w)
    block = [total[min(i + window, n)] - total[i] if any(weight[i : i + window]) else 0.0 for i in range(n)]
    if max(block, default=0) < surge:
        surge = max(block, default=0)
    out, i = [], 0
    while i < n:
        if not block[i] or block[i] < surge:
            i += 1
            continue
        j = i
        while j < n and block[j]:
            j += 1
        a, z = i, j
        while not weight[a]:
            a += 1
        while not weight[z - 1]:
            z -= 1
        out.append((a, z))
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The kept blocks, joined by an empty line."""
    if not page:
        return ""
    rows = [(text, n, depth > 0) for text, n, furniture, depth in lines(page) if not furniture]
    marked = [r[2] for r in rows]
    weight = weights([r[1] for r in rows], marked)
    some = any(marked)
    # a line of no weight between kept ones belongs to the text (a paragraph in a link), unless it is outside the article
    return "\n\n".join(rows[k][0] for a, z in kept_lines(weight, window, surge) for k in range(a, z) if weight[k] or not some)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html, ...).

    Null or empty html gives the empty text, a page without markup its own text in one block; repeated rows and null ids
    are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
