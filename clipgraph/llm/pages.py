"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First, blocks are decided by where they stand
(menus, footers, forms and the like are out), by the share of their words in links, by their length
and by the share of stop words. Short blocks stay open; in the second pass they take the label of
the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: frequent function words of some languages
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can could for from had has have he her his if in into is it its more no not
of on one or our out she so some than that the their them then there these they this to up was we were what when which who will
with would you your
aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im
in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nous on ou par
pas plus pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous
al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero
por porque que se ser si sin sobre son su sus también te tiene todo tu un una uno y ya
""".split())
# fixed values: element names
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section select summary table tbody
td tfoot th thead title tr ul
""".split())
OUT_TAGS = frozenset("aside button datalist dialog footer form head header label menu nav object option select title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: parts of class and id names that mark what is not the article
OUT_NAMES = frozenset("""
ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byads comment comments commentlist consent cookie
cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
pagination pager popup promo promoted promotion related recommended replies reply respond share sharing sidebar signup social
sponsor sponsored subscribe subscription teaser toolbar widget widgets
""".split())
# fixed values: first and last parts of names that only say what an element has around it or lacks
ABOUT = frozenset("has is no not with without".split())
LACKS = frozenset("free less".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")


def out_name(attributes: str) -> bool:
    """Whether a class, id or role names something that is not the article; ``with-sidebar`` or ``ad-free`` do not."""
    for value in _NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in ABOUT and parts[-1] not in LACKS and not OUT_NAMES.isdisjoint(parts):
                return True
    return False


@dataclass
class Rules:
    """Limits of the block rules; lengths in characters."""

    short: int = 70
    long: int = 200
    links: float = 0.5
    few_links: float = 0.2
    stop_low: float = 0.1
    stop_high: float = 0.25


@dataclass
class Block:
    text: str
    links: float
    out: bool
    area: int
    heading: bool


def blocks(html: str) -> list[Block]:
    """Blocks in page order; ``out`` marks excluded places, ``area`` the article or main element they are in (0: none).

    The text of an excluded inline element is passed over, and the block around it goes on.
    """
    found: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []
    out, area, areas, skip = False, 0, 0, False
    pieces: list[str] = []
    linked = 0
    in_link = 0
    heading = False
    breaks = 0

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, min(1.0, linked / len(text)), out, area, heading))
        pieces, linked = [], 0

    def enter() -> None:
        nonlocal out, area, skip
        out, area, skip = stack[-1][1:] if stack else (False, 0, False)

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at and not skip:
            piece = unescape(html[at : token.start()])
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
            if not piece.isspace():
                breaks = 0
        at = token.end()
        name = token.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if token.group(2) else 1
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                pieces.append(" ")
            continue
        is_block = name in BLOCK_TAGS
        if is_block:
            close()
            in_link = 0
            breaks = 0
            if name[0] == "h" and name[1:].isdigit():
                heading = not token.group(2)
            elif heading:
                heading = False
        if name in VOID_TAGS:
            continue
        attributes = token.group(4) or ""
        if token.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not is_block and any(entry[0] in BLOCK_TAGS for entry in stack[i + 1 :]):
                        break  # a stray end of an inline element doesn't close blocks
                    del stack[i:]
                    enter()
                    break
        elif attributes.rstrip().endswith("/") and not is_block:
            continue
        else:
            if is_block and stack and stack[-1][0] == "p":
                stack.pop()
                enter()
            named = "=" in attributes and name not in ("html", "body", "main") and out_name(attributes)
            hides = named or "hidden" in attributes.lower().split() or (
                name in OUT_TAGS and not (name == "header" and area))
            if is_block or hides or name in OUT_TAGS:
                if name in ("article", "main") and not area and not out and not hides:
                    areas += 1
                    stack.append((name, out, areas, skip))
                else:
                    # an inline element is only left out of its block, a block is out as a whole
                    inline = hides and not is_block
                    stack.append((name, out or (hides and is_block), area, skip or inline))
                enter()
    if at < len(html) and not skip:
        piece = unescape(html[at:])
        pieces.append(piece)
        if in_link:
            linked += len(piece.strip())
    close()
    return found


def label(page: list[Block], rules: Rules) -> list[bool]:
    """Which blocks are main text."""
    has_area = any(b.area and not b.out for b in page)
    first: list[bool | None] = []
    for b in page:
        first.append(_first_pass(b, has_area, rules))
    return [_second_pass(i, first, page, has_area) if d is None else d for i, d in enumerate(first)]


def _first_pass(b: Block, has_area: bool, rules: Rules) -> bool | None:
    """True or False where decided, None for short blocks."""
    if b.out or (has_area and not b.area):
        return False
    if b.links > rules.links:
        return False
    if has_area:
        # the place speaks for the block; only length leaves it open
        return None if len(b.text) < rules.short else True
    if "\N{COPYRIGHT SIGN}" in b.text:
        return False
    if len(b.text) < rules.short:
        return False if b.links > 0 else None
    words = [w.lower() for w in _WORD.findall(b.text)]
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= rules.stop_high and b.links <= rules.few_links:
        return True
    if density >= rules.stop_low:
        return True if len(b.text) > rules.long and b.links <= rules.few_links else None
    return False if b.links > rules.few_links or len(b.text) <= rules.long else None


def _second_pass(i: int, first: list[bool | None], page: list[Block], has_area: bool) -> bool:
    """Label of an open block from the nearest decided ones of its area; a tie goes to the following one for headings."""
    def near(step: int) -> tuple[int, bool] | None:
        j = i + step
        while 0 <= j < len(page) and page[j].area == page[i].area:
            if first[j] is not None and not page[j].out:
                return abs(j - i), bool(first[j])
            j += step
        return None

    before, after = near(-1), near(1)
    if before is None and after is None:
        return has_area  # nothing is decided around it: the article element speaks for it
    if before is None or after is None:
        return (before or after)[1]
    if before[1] == after[1]:
        return before[1]
    if page[i].heading:
        return after[1]
    return before[1] if before[0] <= after[0] else after[1]


def main_text(html: str | None, rules: Rules | None = None) -> tuple[str, int, int]:
    """Main text, number of blocks, and number of blocks kept."""
    page = blocks(html or "")
    kept = [b.text for b, good in zip(page, label(page, rules or Rules()), strict=True) if good]
    return "\n".join(kept), len(page), len(kept)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Rules | None = None) -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_kept) for every page.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a line break in page order.

    * Null and empty html, and pages without main text: empty text, 0 characters.
    * Broken markup: an unclosed comment, script or tag runs to the end of the page; other
      unclosed elements end with their parent. Repeated rows are kept. Empty table: no rows.
    * Other columns are not read.

    A row at a time, without a shuffle; a page is read once from front to back.
    """

    @F.pandas_udf("text string, n_blocks long, n_kept long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([main_text(h, rules) for h in batch], columns=["text", "n_blocks", "n_kept"])

    found = df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{url}`").alias("__u"), of(F.col(f"`{html}`")).alias("__c"))
    return found.select(
        F.col("__k").alias(key), F.col("__u").alias(url), F.col("__c.text").alias("text"),
        F.length("__c.text").cast("long").alias("n_chars"), "__c.n_blocks", "__c.n_kept")
