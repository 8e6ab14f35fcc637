"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one a block element. A line's weight is the
length of its text; lines of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, and lines that are mostly link text,
weigh nothing. Weights are summed over a sliding window of lines: where the
sums surge the main text begins, where they dive to nothing it ends, and
the lines between are kept. Marks of main text add weight; they don't
exclude other lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|audio|video)\b(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BREAKS = frozenset(("br", "hr"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("nav header footer aside form menu dialog button head".split())
#: Words of a class or id that mark an element of any kind as none of the text.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer"
    " comment comments disqus cookie cookies consent notice notices gdpr popup modal newsletter subscribe pagination pager hidden".split()
)
#: Words that a paragraph of the text may bear too: they mark boxes only.
_BOX_WORDS = frozenset(
    "promotion side aside widget header banner foot reply replies respond discussion alert overlay subscription signup login share sharing social related recommended toolbar search".split()
)
_BOXES = frozenset("div section ul ol dl table tbody fieldset figure details center dir".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Elements that a new one of these (or any block, for p) ends without an end tag.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}


@dataclass(frozen=True)
class Distribution:
    """Lines in a window, the sum of unmarked text that makes a surge, and how often marked text counts."""

    window: int = 3
    surge: int = 86
    marked: int = 2


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is to be left out, and whether it marks the main text."""
    skip, main = name in _SKIPPED, name in ("article", "main")
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                parts = set(re.split(r"[\s_-]+", value))
                skip |= not main and (not parts.isdisjoint(_WORDS) or (name in _BOXES and not parts.isdisjoint(_BOX_WORDS)))
            elif key == "role":
                skip |= value in _ROLES
                main |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                skip = name not in ("html", "body")
    return skip, main


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, length of link text, within marked main text) of each block, in page order; skipped blocks are empty lines."""
    out: list[tuple[str, int, bool]] = []
    piece: list[str] = []
    links = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, skipped from here, main from here
    places: dict[str, list[int]] = {}  # of each name in the stack
    blocks: list[int] = []  # places of block elements in the stack
    skipping = mains = anchors = 0

    def end() -> None:
        nonlocal links
        text = " ".join(unescape("".join(piece)).split()) if piece else ""
        if text:
            out.append((text, links, mains > 0))
        piece.clear()
        links = 0

    def pop(at: int) -> None:
        nonlocal skipping, mains, anchors
        while len(stack) > at:
            name, skip, main = stack.pop()
            places[name].pop()
            if name in _BLOCKS:
                blocks.pop()
                end()
            skipping -= skip
            mains -= main
            anchors -= name == "a"

    def say(text: str) -> None:
        nonlocal links
        if skipping:
            return
        piece.append(text)
        if anchors:
            links += len(text.strip())

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            found = places[name][-1] if places.get(name) else -1
            if found >= 0 and (name in _BLOCKS or not blocks or blocks[-1] < found):
                pop(found)
            elif name in _BLOCKS:
                end()
            continue
        if name in _BREAKS and not skipping:
            piece.append(" ")
        if name in _BLOCKS:
            end()
            if blocks and stack[blocks[-1]][0] in (*_CLOSES.get(name, ()), "p"):
                pop(blocks[-1])
        if name in _VOID or m[4].endswith("/"):
            continue
        skip, main = _marks(name, m[4])
        if skip and not skipping and name in _BLOCKS:
            out.append(("", 0, False))
        places.setdefault(name, []).append(len(stack))
        if name in _BLOCKS:
            blocks.append(len(stack))
        stack.append((name, skip, main and not skip))
        skipping += skip
        mains += main and not skip
        anchors += name == "a"
    if at < len(html):
        say(re.sub(r"<[a-zA-Z/!][^<]*\Z", "", html[at:]))
    pop(0)
    end()
    return out


def main_text(html: str | None, how: Distribution = Distribution()) -> str:
    """The kept lines joined by one space; null or empty pages give an empty text.

    Lines that the page marks (article, main) count ``how.marked`` times and
    surge whatever their length, so short articles stay whole. The marked
    lines together and each region of other lines then compete: what weighs
    less than half of the heaviest goes. On pages that mark nothing all
    regions stay, and all lines with weight where none surges.
    """
    if not html:
        return ""
    found = lines(html)
    weight = [len(t) * (how.marked if inside else 1) if inside or 2 * link < len(t) else 0 for t, link, inside in found]
    near = lambda i: sum(weight[k] for k in range(i, min(i + how.window, len(found))) if found[k][2] == found[i][2] or not weight[k])
    sums = [near(i) for i in range(len(weight))]

    def surges(least: int) -> list[tuple[int, int]]:
        regions, i = [], 0
        while i < len(sums):
            inside = found[i][2]
            if weight[i] and (inside or sums[i] >= least):
                j = i
                while j < len(sums) and sums[j] and (found[j][2] == inside or not weight[j]):
                    j += 1
                regions.append((i, j))
                i = j
            else:
                i += 1
        return regions

    regions = surges(how.surge) or surges(1)
    total = [sum(weight[a:b]) for a, b in regions]
    marks = sum(t for t, (a, _) in zip(total, regions, strict=True) if found[a][2])
    if marks:
        total = [marks if found[a][2] else t for t, (a, _) in zip(total, regions, strict=True)]
        regions = [r for r, t in zip(regions, total, strict=True) if 2 * t >= max(total)]
    return " ".join(found[k][0] for a, b in regions for k in range(a, b) if weight[k])


def extract(pages: DataFrame, how: Distribution = Distribution(), html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (code points) of its main text.

    Each row is worked on by itself; repeated rows stay, a null or empty
    page has an empty text, an empty table gives an empty one. A column of
    the input called text or n_chars is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    given = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias("html"))
    schema = given.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), how) for h in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"]
            )

    return given.mapInArrow(run, schema)
