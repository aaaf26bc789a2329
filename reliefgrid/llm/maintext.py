"""Main text of web pages by two passes of block rules.

First pass, each block on its own. Elements that say that they are not the article are bad: menus, headers, footers,
sidebars, forms, and containers named as adverts, notices, comments and the like. Any other block is judged by its
link density, its length and the share of stop words: link lists are bad, long blocks with enough stop words good, others
stay undecided. No element makes a block good. Second pass: an undecided block takes the label of its nearest decided neighbours, near
in the tree of elements first and in the order of the page second: a short paragraph belongs with the others in its
container, not with the footer that follows. Between a good and a bad one that are as near it is good if nearly good by itself.

Stop words are learned, whatever the languages: the words that stand on at least ``STOP_SHARE`` of all pages. A page
that has nearly none of them is in a language that the table doesn't show, and is judged by links and lengths alone. On a
page without a good block the undecided ones are all that there is, and count as good.

Results: a null page is empty, and a page without main text gives the empty string; every row of the
table gives one row, repeated or without id as it is; other columns are not looked at.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.blocks import Block, blocks
from reliefgrid.runtime import cut

MAX_LINK_DENSITY = 0.3
#: Characters: below, a block is undecided; above the second, it is decided by its stop words.
SHORT, LONG = 70, 200
#: Share of stop words of a good block, and that of a page below which its language is unknown.
STOP_GOOD, STOP_KNOWN = 0.1, 0.05
#: A word is a stop word if it stands on this share of the pages; there are at most so many times the words of a page.
STOP_SHARE = 0.02
#: Words: runs of letters, as they are counted and looked up.
WORD = re.compile(r"[^\W\d_]+")
BAD_TAGS = frozenset("nav footer aside form menu select button fieldset dialog search option legend head".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|newsletter|"
    r"subscribe|subscription|signup|login|comment|comments|commentlist|disqus|respond|replies|reply|sidebar|side-bar|widget|widgets|menu|navbar|navigation|nav|"
    r"breadcrumb|breadcrumbs|masthead|footer|colophon|share|sharing|social|related|recommended|pagination|pager|toolbar|contentinfo|complementary)(?:$|[\s_-])"
)
#: Names that mean the page's own parts only outside the article.
PAGE_NAMES = re.compile(r"(?:^|[\s_-])(?:header|top|topbar|hero)(?:$|[\s_-])")
#: Names that are never an article's, even inside it; other bad names may be its subject there.
NEVER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|sponsor\w*|cookie\w*|consent|gdpr|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|"
    r"sidebar|side-bar|breadcrumbs?|pagination|pager|navbar)(?:$|[\s_-])"
)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])")
MAIN_TAGS = frozenset(("article", "main"))
GOOD, BAD, SHORT_BLOCK, NEAR = 1, 0, 2, 3


def stop_words(pages: DataFrame, html_col: str = "html", share: float = STOP_SHARE) -> frozenset[str]:
    """The words that stand on at least ``share`` of the pages with text, counted over all of them."""
    page = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", " ")
    found = F.array_remove(F.array_distinct(F.split(F.lower(page), r"[^\p{L}\p{M}]+")), "")
    # the empty word stands once on each page that has any, so that one reading gives the number of pages too
    words = pages.select(found.alias("_w")).filter(F.size("_w") > 0).select(F.explode(F.concat("_w", F.array(F.lit("")))).alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("_n")))
    row = counts.filter("word = ''").first()
    least = max(2.0, share * (row["_n"] if row else 0))
    # each page has a limited number of words, so few can stand on that many pages
    return frozenset(r["word"] for r in counts.filter((F.col("word") != "") & (F.col("_n") >= least)).select("word").collect())


def _excluded(b: Block) -> tuple[bool, bool, bool]:
    """Is the block part of something that is no article; does a name cast doubt on it; does it lie inside an article element?"""
    inside = doubt = False
    for tag, names in b.path:
        if tag in MAIN_TAGS:
            inside = True
        if tag in BAD_TAGS or (tag == "header" and not inside):
            return True, doubt, inside
        if tag in ("body", "html") or not names:
            continue
        if tag in MAIN_TAGS:
            if COMMENT_NAMES.search(names):
                return True, doubt, inside
        elif BAD_NAMES.search(names) or (not inside and PAGE_NAMES.search(names)):
            if not inside or NEVER_NAMES.search(names):
                return True, doubt, inside
            doubt = True
    return False, doubt, inside


def _stops(text: str, stop: frozenset[str]) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = WORD.findall(text.lower())
    return sum(map(stop.__contains__, words)), len(words)


def _share(stops: int, words: int) -> float:
    return stops / words if words else 0.0


def stop_share(text: str, stop: frozenset[str]) -> float:
    return _share(*_stops(text, stop))


def first_pass(b: Block, stop: frozenset[str] | None) -> int:
    """Label of a block by itself; without ``stop`` words by links and length alone."""
    return _label(b, _excluded(b), None if stop is None else stop_share(b.text, stop))


def _label(b: Block, where: tuple[bool, bool, bool], share: float | None) -> int:
    """The same from the place of the block and its share of stop words."""
    out, doubt, inside = where
    if out:
        return BAD
    if b.link_chars > MAX_LINK_DENSITY * len(b.text):
        # in an article element a list may be of links
        return SHORT_BLOCK if inside and not doubt else BAD
    if not inside and b.text.startswith(("©", "(c)")):
        return BAD
    if len(b.text) < SHORT:
        return BAD if doubt else SHORT_BLOCK
    good = share is None or share >= STOP_GOOD
    if doubt:
        return GOOD if good else BAD
    if not good:
        return SHORT_BLOCK  # a table, a list of names, an advert: as its neighbours say
    return GOOD if len(b.text) >= LONG else NEAR


def _common(a: Block, b: Block) -> int:
    n = 0
    for x, y in zip(a.nodes, b.nodes):
        if x != y:
            break
        n += 1
    return n


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Undecided blocks inherit from the nearest decided block: the most elements in common, then the fewest blocks between."""
    n, out = len(labels), list(labels)
    if GOOD not in labels:
        return [GOOD if v in (SHORT_BLOCK, NEAR) else v for v in labels]
    for step in (1, -1):
        # of the decided blocks passed so far, those that may be nearest: deeper ones first, the last of equal depth
        side = "left" if step == 1 else "right"
        held: list[tuple[int, int]] = []  # (elements shared with the current block, index)
        best: list[tuple[int, int] | None] = [None] * n
        order = range(n) if step == 1 else range(n - 1, -1, -1)
        before = None
        for k in order:
            if before is not None:
                depth = _common(found[before], found[k])
                kept: list[tuple[int, int]] = []
                for d, i in held:
                    d = min(d, depth)
                    while kept and kept[-1][0] <= d:
                        kept.pop()
                    kept.append((d, i))
                held = kept
            best[k] = held[0] if held else None
            if labels[k] in (GOOD, BAD):
                # nearer in order than all others, and as deep as the block itself
                held = [(d, i) for d, i in held if d > len(found[k].nodes)] + [(len(found[k].nodes), k)]
            before = k
        if side == "left":
            left = best
    for k, v in enumerate(labels):
        if v in (GOOD, BAD):
            continue
        near = [(-p[0], abs(p[1] - k), labels[p[1]]) for p in (left[k], best[k]) if p is not None]
        near.sort()
        if len(near) == 2 and near[0][:2] == near[1][:2] and near[0][2] != near[1][2]:
            out[k] = GOOD if v == NEAR else BAD
        else:
            out[k] = near[0][2]
    return out


def main_text(page: str | None, stop: frozenset[str] = frozenset()) -> str:
    found = blocks(page or "")
    places = [_excluded(b) for b in found]
    counts = [(0, 0) if p[0] else _stops(b.text, stop) for b, p in zip(found, places)]
    known = _share(sum(c[0] for c in counts), sum(c[1] for c in counts)) >= STOP_KNOWN
    labels = second_pass(found, [_label(b, p, _share(*c) if known else None) for b, p, c in zip(found, places, counts)])
    return " ".join(b.text for b, v in zip(found, labels) if v == GOOD)


def extract(html: Column, stop: frozenset[str] = frozenset()) -> Column:
    """Main text of a page as a column."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page, stop))

    return run(F.coalesce(html.cast("string"), F.lit("")))


def main_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; stop words are learned from all of them first."""
    stop = stop_words(pages, html_col)
    return pages.select("page_id", "url", extract(F.col(html_col), stop).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
