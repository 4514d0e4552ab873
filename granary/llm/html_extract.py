"""Main-text extraction from HTML by line-block distribution.

A page is cut into lines at block-level tags. Every line has a weight: its text
length outside links, nothing in a menu, header, footer, sidebar, notice,
advert, form or reader comment, half in a part whose name only starts like one
of these (related-work, share-your-story). Sums of the weights over a sliding
window of lines give the distribution; text starts to count at a surge (the sum
passes the threshold) and stops at a dive (the sum falls to nothing).

An article element is evidence of its own: any text in it is a surge. Lines
beside it weigh a quarter, and their surge must pass the article's fullest
window, so that teasers marked as articles do not hide the main text.

Defined results: null, empty or text-free html gives the empty string; an empty
table gives no rows; rows keep their multiplicity; extra columns are ignored;
very long pages and lines are read in one linear scan; a page whose markup ends
early gives what stands before its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

WINDOW = 3
SURGE = 86

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_P = BLOCKS - {"br", "button", "option"}
SKIPPED = frozenset("aside button datalist dialog footer form head header menu nav search select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split())
# What page authors call the parts that are not the article, in class and id; words that
# say how such a part is laid out or what it lists; names that are never the start of an article's own part.
PARTS = frozenset((
    "ad|ads|advert|adverts|advertisement|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|"
    "cookies|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|"
    "overlay|pager|pagination|popup|promo|promotion|related|respond|replies|search|share|sharing|sidebar|signup|skip|social|"
    "sponsor|sponsored|subscribe|toolbar|widget|widgets"
).split("|"))
LAYOUT = frozenset(
    "area articles author bar block body bottom box btn button buttons card cards col column container content count date "
    "entry form icon icons image inline inner item items label left link links list main media message meta network networks "
    "news outer page panel post posts primary right row secondary section slot small stories text thread title top unit "
    "wide wrap wrapper".split()
)
ALWAYS = frozenset("ad ads advert adverts advertisement adsense cookie cookies consent disqus gdpr sponsored".split())
NEGATIONS = frozenset("has with no without".split())
STRONG, WEAK = 2, 1
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|iframe|object|template|textarea|title|svg|math|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)>?"
    r"|<[!?/][^>]*>?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _named(value: str) -> int:
    """How far a class or id tells that its element is not the article."""
    words = [word for word in re.split(r"[-_\d]+", value) if word]
    if not words or words[0] in NEGATIONS:
        return 0
    if words[0] not in PARTS:
        return STRONG if words[-1] in PARTS else 0
    head = next((word for word in reversed(words[1:]) if word not in LAYOUT), words[0])
    return STRONG if words[0] in ALWAYS or head in PARTS else WEAK


def _evidence(name: str, attributes: str) -> int:
    """STRONG, WEAK or 0: how far an element's tag and attributes tell that it is not the article."""
    if name in SKIPPED:
        return STRONG
    found = 0
    if not attributes or name in ("html", "body", "main", "article"):
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"' ").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return STRONG
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return STRONG
        if key == "role" and value in ROLES:
            return STRONG
        if key in ("class", "id"):
            found = max([found, *map(_named, value.split())])
    return found


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    against: int  # STRONG, WEAK or 0
    article: bool  # inside an article element


def lines_of(html: str) -> Iterator[Line]:
    open_: list[tuple[str, int, int]] = []  # name; evidence against and article depth outside of it
    against = article = link = at = linked = 0
    parts: list[str] = []

    def line() -> Iterator[Line]:
        nonlocal parts, linked
        if parts and (text := " ".join("".join(parts).split())):
            yield Line(text, min(linked, len(text)), against, article > 0)
        parts, linked = [], 0

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            parts.append(text := unescape(html[at : token.start()]))
            linked += len(text.strip()) if link else 0
        at = token.end()
        raw, closing, name, attributes = token.groups()
        if raw or not name:
            if raw and raw.lower() not in ("svg", "math"):
                yield from line()
            continue
        name = name.lower()
        if name in BLOCKS:
            yield from line()
        if name == "a":
            link = 0 if closing else 1
        if closing:
            k = len(open_) - 1
            while k >= 0 and open_[k][0] != name:
                k -= 1
            if k >= 0:
                against, article = open_[k][1:]
                del open_[k:]
            continue
        if name == "body":
            open_, against, article = [], 0, 0
        if name in CLOSE_P and open_ and open_[-1][0] == "p" or name == "li" and open_ and open_[-1][0] == "li":
            against, article = open_.pop()[1:]
        found = _evidence(name, attributes)
        if name not in VOID and (name in BLOCKS or found):
            open_.append((name, against, article))
            against = max(against, found)
            article += name in ("article", "main")
    if at < len(html):
        parts.append(unescape(html[at:]))
    yield from line()


def regions(weights: list[float], window: int, surge: float) -> list[bool]:
    """Which lines stand between a surge of the window sums and the dive behind it."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    inside, found = False, []
    for total in sums:
        inside = (inside or total >= surge) and total > 0
        found.append(inside)
    return found


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    lines = list(lines_of(html)) if html else []
    attested = [line.article and line.against < STRONG for line in lines]
    weights = [(0, 1 / 2, 1)[STRONG - line.against] * (len(line.text) - line.linked) for line in lines]
    fullest = lambda of: max((sum(of[i : i + window]) for i in range(len(of))), default=0)
    if any(attested):
        own = fullest([weight * of for weight, of in zip(weights, attested)])
        beside = [0 if of else weight / 4 for weight, of in zip(weights, attested)]
        least = max(surge, own)
    else:
        # Without an article, a surge is what the fullest window can show at most.
        beside = weights
        least = min(surge, fullest(weights)) or surge
    kept = []
    for line, of, inside in zip(lines, attested, regions(beside, window, least)):
        prose = 2 * (len(line.text) - line.linked) >= len(line.text)
        if line.against < STRONG and (of and (prose or not line.against) or not of and inside and prose):
            kept.append(line.text)
    return " ".join(kept)


def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of column html in column into (replaced if there)."""
    return pages.withColumn(into, F.pandas_udf(_main_texts, "string")(F.coalesce(F.col(html), F.lit(""))))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
