"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's length counts only where
text can be content: lines of menus, headers, footers, sidebars, notices, adverts, forms
and comments count as gaps, and on pages with an article or main element so does all
outside of it. What is such an element is told by its tag, its role, or a whole name in
its class or id (`site-footer`, not `share-of-market`); a name that merely has such a word
in it only takes the weight of links from its lines, so that link lists under it dive. Sums over sliding windows of lines then rise at a surge point and fall to
nothing at a dive point; all lines between them are kept, however short.

On pages without an article or main element, gaps of skipped elements are closed first where
both sides lie in the same container (or one side lies in the skipped element's own container
and the other further down in it). Short stretches beside a kept one in the same container are
kept, and so are headings right before a kept stretch, even if they are wholly links.

Null or empty pages give an empty text; broken markup (unclosed tags, cut-off pages) is
read as far as it goes. Each page is one row of work: nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window that make a surge on pages without an article or main element.
SURGE_CHARS = 80

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|title|head|math|canvas)\b(?P<rawattrs>[^>]*+)>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMED = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Blocks that hold other blocks; all others, such as paragraphs and lists, belong to the one around them.
CONTAINERS = frozenset("article center div main section td th".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button select search label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr"
    " notice notices alert announcement sidebar sidebars sidenav aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar"
    " footer colophon comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations"
    " newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager search skip copyright contentinfo"
    " complementary".split())

#: Words that name a place or a box and say nothing about what is in it.
LAYOUT_WORDS = frozenset(
    "site page main global top bottom left right side inner outer box container wrapper wrap holder slot area bar block list item items link links"
    " button buttons icon icons inline sticky fixed mobile desktop primary secondary col column row content posts articles stories form field"
    " text unit module panel region".split())


def _hidden(attrs: str) -> bool:
    """Whether an attribute hides the element; the word in other values or in longer class names says nothing."""
    for name, a, b, c in NAMED.findall(attrs):
        name, value = name.lower(), (a or b or c).strip().lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true"):
            return True
        if (name == "class" and "hidden" in value.split()) or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def _marked(attrs: str) -> int:
    """2: the element is no article text: it is hidden, or a whole name in class, id or role says so (all of its
    words do, or name mere layout). 1: some name only has such a word in it, which by itself says nothing. 0: none."""
    if not attrs:
        return 0
    if MAY_HIDE.search(attrs) and _hidden(attrs):
        return 2
    level = 0
    for _, a, b, c in ATTR.findall(attrs):
        for name in (a or b or c).split():
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
            if words & CHROME_WORDS:
                level = max(level, 2 if words <= CHROME_WORDS | LAYOUT_WORDS else 1)
    return level


def _events(html: str) -> list[tuple]:
    """("text", s), ("open", name, attrs), ("close", name) in page order, without raw elements."""
    out, at, endless = [], 0, set()
    while m := TOKEN.search(html, at):
        if m.start() > at:
            out.append(("text", html[at: m.start()]))
        at = m.end()
        if raw := m["raw"]:
            if not m["rawattrs"].endswith("/"):
                end = None if raw.lower() in endless else re.compile(rf"</{raw}\b[^>]*>", re.I).search(html, at)
                if end is None:
                    endless.add(raw.lower())  # no later search can find one
                if end:
                    at = end.end()
                elif raw.lower() in ("script", "style", "textarea"):
                    at = len(html)
            out.append(("gap",))
        elif name := m["name"]:
            out.append(("close", name.lower()) if m["close"] else ("open", name.lower(), m["attrs"] or ""))
    if at < len(html):
        # A tag that is cut off at the end of the page is no text.
        tail = re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", html[at:])
        out.append(("text", tail))
    return out


def _partners(events: list[tuple]) -> dict[int, int]:
    """Position of the closing tag of each opened element, by name; unclosed ones are missing."""
    found, stacks = {}, {}
    for i, e in enumerate(events):
        if e[0] == "open" and e[1] not in VOID and not e[2].endswith("/"):
            stacks.setdefault(e[1], []).append(i)
        elif e[0] == "close" and stacks.get(e[1]):
            found[stacks[e[1]].pop()] = i
    return found


GAP = ("", 0, None, 0)
#: The container of what lies in no other.
ROOT = -1


def _join(lines: list[tuple], gaps: list[tuple[int, int, int]], closed: dict[int, int]) -> list[tuple]:
    """`lines` without the gaps of skipped elements inside one container. closed: where containers, which nest, end."""
    merged: list[tuple[int, int, list]] = []
    for a, b, parent in gaps:
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b, [*merged[-1][2], parent])
        else:
            merged.append((a, b, [parent]))
    out, at = [], 0
    for a, b, parents in merged:
        out += lines[at:a]
        at = b
        if a == 0 or b == len(lines):
            continue
        x, y = lines[a - 1][2], lines[b][2]
        if x is None or y is None:
            out += lines[a:b]
            continue
        around = lambda p: p <= x and p <= y and closed[p] >= max(closed.get(x, 0), closed.get(y, 0))  # noqa: B023, E731
        if x != y and not all(p != ROOT and p in (x, y) and around(p) for p in parents):
            out += lines[a:b]
    return out + lines[at:]


def lines_of(html: str) -> list[tuple]:
    """Lines of text with the length that counts in the distribution, the containers around them and the level
    of a heading; length 0 marks a gap."""
    events = _events(html)
    partner = _partners(events)
    bodies = [(i, partner.get(i, len(events))) for i, e in enumerate(events) if e[0] == "open" and e[1] in ("article", "main") and _marked(e[2]) < 2]
    starts = sorted(i for i, _ in bodies)
    skip: list[tuple[int, int]] = []
    faint: list[tuple[int, int]] = []
    for i, e in enumerate(events):
        if e[0] != "open" or i not in partner or e[1] in ("html", "body", "main"):
            continue
        mark = 2 if e[1] in CHROME_TAGS else _marked(e[2])
        if mark == 2 and bisect_right(starts, i) == bisect_left(starts, partner[i]):
            skip.append((i, partner[i]))
        elif mark == 1:
            faint.append((i, partner[i]))
    covered, ends = [], []  # the skipped elements' starts, and how far any of them reaches so far
    for a, b in skip:
        covered.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    regions = [r for r in bodies if not (k := bisect_left(covered, r[0])) or ends[k - 1] <= r[0]]
    lines: list[tuple] = []
    gaps: list[tuple[int, int, int]] = []
    opened = {b: a for a, b in partner.items() if events[a][1] in CONTAINERS}
    path, open_, closed = [ROOT], {ROOT}, {}
    level, gap_from = 0, (0, ROOT)
    buffer: list[str] = []
    state = {"links": 0, "chars": 0}
    inside, depth, link, doubt = 0, 0, 0, 0
    region_edges: dict[int, int] = {}
    for a, b in regions:
        region_edges[a] = region_edges.get(a, 0) + 1
        region_edges[b] = region_edges.get(b, 0) - 1
    skip_edges: dict[int, int] = {}
    for a, b in skip:
        skip_edges[a] = skip_edges.get(a, 0) + 1
        skip_edges[b] = skip_edges.get(b, 0) - 1

    faint_edges: dict[int, int] = {}
    for a, b in faint:
        faint_edges[a] = faint_edges.get(a, 0) + 1
        faint_edges[b] = faint_edges.get(b, 0) - 1

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            if depth or (regions and not inside):
                lines.append(GAP)
            else:
                # Links count as text inside an article, but where a name casts doubt on them.
                lines.append((text, len(text) if regions and not doubt else max(0, len(text) - state["links"]), path[-1], level))
        buffer.clear()
        state["links"] = 0

    for i, e in enumerate(events):
        edge = i in region_edges or i in skip_edges
        if edge or i in faint_edges or (e[0] != "text" and (e[0] == "gap" or e[1] in BLOCKS)):
            flush()
        doubt += faint_edges.get(i, 0)
        if edge:
            inside += region_edges.get(i, 0)
            before, depth = depth, depth + skip_edges.get(i, 0)
            if before == 0 and depth:
                gap_from = (len(lines), path[-1])
            if (before == 0) != (depth == 0) or i in region_edges:
                lines += [GAP] * WINDOW
            if before and depth == 0:
                gaps.append((gap_from[0], len(lines), gap_from[1]))
        if e[0] == "text":
            buffer.append(e[1])
            if link:
                state["links"] += len(e[1])
        elif e[0] == "open":
            if e[1] in CONTAINERS and i in partner:
                path.append(i)
                open_.add(i)
            elif e[1] in HEADINGS and i in partner:
                level = HEADINGS[e[1]]
            link += e[1] == "a" and i in partner
            if e[1] == "br":
                buffer.append(" ")
        elif e[0] == "close" and e[1] == "a":
            link = max(0, link - 1)
        elif e[0] == "close" and opened.get(i) in open_:
            while path[-1] != ROOT and (path[-1] in open_):
                last = path.pop()
                open_.discard(last)
                closed[last] = i
                if last == opened[i]:
                    break
        elif e[0] == "close" and e[1] in HEADINGS:
            level = 0
    flush()
    closed |= {p: len(events) + len(path) - k for k, p in enumerate(path)}  # never closed: by depth
    return _join(lines, gaps, closed) if not regions else [*lines, ("*", -1, None, 0)]


def distribution(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the lengths of each line and the following window - 1."""
    total, out = 0, [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        out[i] = total
    return out


def spans(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges up to a dive point (window sum 0) that hold a surge (window sum of `surge` or more)."""
    sums, found, i = distribution(lengths, window), [], 0
    while i < len(sums):
        if lengths[i] == 0:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end] > 0:
            end += 1
        if max(sums[i:end]) >= surge:
            found.append((i, end))
        i = end
    return found


def _kept(lines: list[tuple], lengths: list[int]) -> list[tuple[int, int]]:
    """Line ranges of a page without an article element: stretches with a surge, short ones beside them in the
    same container, and the headings that lead to them."""
    every = spans(lengths, 1)
    surging = set(spans(lengths, min(SURGE_CHARS, max(distribution(lengths)))))
    keep = [r in surging for r in every]
    beside = [bool(lines[a[1] - 1][2]) and lines[a[1] - 1][2] == lines[b[0]][2] for a, b in zip(every, every[1:])]
    for k, near in enumerate(beside):
        keep[k + 1] |= near and keep[k]
    for k, near in reversed(list(enumerate(beside))):
        keep[k] |= near and keep[k + 1]
    out = []
    for (a, b), stays in zip(every, keep):
        if stays:
            level = 7
            while a > 0 and 0 < lines[a - 1][3] < level and lengths[a - 1] == 0:
                a, level = a - 1, lines[a - 1][3]
            out.append((a, b))
    return out


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, one per line."""
    if not html:
        return ""
    lines = lines_of(html)
    structured = bool(lines) and lines[-1][1] == -1
    if structured:
        lines.pop()
    lengths = [x[1] for x in lines]
    if not any(lengths):
        return ""
    kept = spans(lengths, 1) if structured else _kept(lines, lengths)
    return "\n".join(lines[i][0] for a, b in kept for i in range(a, b) if lines[i][0])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the html replaced by its main text and the text's length in code points."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower(), "n_chars")]
    schema = pages.select(*kept, F.lit("").alias(text), F.lit(0).cast("bigint").alias("n_chars")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, text, "n_chars"])

    return pages.select(*kept, html).mapInArrow(kernel, schema)


def op1_line_blocks(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
