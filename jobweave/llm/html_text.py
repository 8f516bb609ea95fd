"""Main text of web pages by nearest-URL page differencing.

A page is read as lines: the text of its blocks in page order, each with the zone its
markup gives it: inside the article, free, or page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments by element, role, class or id). Pages are
dealt out and sorted by host, path and id, so that a page meets its nearest URLs in the
same task; of its two neighbours the one whose path agrees longer is its partner. Their
lines, furniture too, are aligned by longest common subsequence, and what both share is
deleted, unless it stands inside the article: a passage that two articles share is text.
Free lines are decided by this alone, whether the page has an article or not. Furniture
that the partner does not share is deleted by its markup.

Every page is in one range of (host, path, id) and only adjacent pages meet, so a host
with a third of all pages is spread over a third of the tasks. A first pass over the urls
alone finds the first and last key of every range; these two are all that the driver
holds of a range. Pages with the last key of a range are also sent to the next one, as
neighbours only, and those with the first key to the one before, so that the number of
partitions does not change any result.

Defined results: null and empty html, and pages without text, give the empty text and 0
characters. Null urls have an empty host and path. Repeated pages are neighbours, and
keep their articles. Truncated markup is read as far as it goes. Extra columns are not
used. Pages of one key are in the order of a hash of their html. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.session import shuffle_width

FREE, ARTICLE, FURNITURE = 0, 1, 2
SKIPPED = frozenset("script style noscript template iframe svg object textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu button head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alert|sidebar|side-bar|menu|navbar|nav|"
    r"navigation|breadcrumbs?|header|footer|masthead|comments?|replies|share|sharing|social|related|newsletter|subscribe|signup|login|"
    r"popup|modal|overlay|widget|pagination|pager|disclaimer|copyright)(?:$|[\s_-])",
    re.I,
)
# Closing one of these ends open paragraphs and list items inside it; opening a block ends an open paragraph.
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tag_end(page: str, at: int) -> int:
    """Position after the ``>`` that ends the tag at ``at``; quoted values may hold one. The end of the page if there is none."""
    i, n = at, len(page)
    while i < n:
        close = page.find(">", i)
        if close < 0:
            return n
        one, two = page.find('="', i, close), page.find("='", i, close)
        quote = min(q for q in (one, two, close) if q >= 0)
        if quote == close:
            return close + 1
        end = page.find(page[quote + 1], quote + 2)
        if end < 0:
            return close + 1
        i = end + 1
    return n


@dataclass
class Open:
    tag: str
    zone: int


def zone_of(tag: str, attributes: str, above: int) -> int:
    if above == FURNITURE:
        return FURNITURE
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    role = values.get("role", "").lower()
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if tag == "article" or tag == "main" or role in ("main", "article"):
        # An article among the reader comments is a comment.
        return FURNITURE if FURNITURE_NAME.search(names) else ARTICLE
    if tag in FURNITURE_TAGS and not (tag == "header" and above == ARTICLE) or role in FURNITURE_ROLES or tag in SKIPPED:
        return FURNITURE
    if names != " " and tag not in ("html", "body") and FURNITURE_NAME.search(names):
        return FURNITURE
    if "hidden" in values or HIDDEN.search(values.get("style", "")) or values.get("aria-hidden") == "true":
        return FURNITURE
    return above


def read_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Text and zone of every block of a page, in page order."""
    page = page or ""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[Open] = []
    parts: list[str] = []
    zone, at, n = FREE, 0, len(page)

    def flush() -> None:
        if parts:
            line = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if line:
                lines.append(line)
                zones.append(zone)
            parts.clear()

    while at < n:
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(page, start + 1)
        if not m:
            if page.startswith(("<!", "<?"), start):
                at = tag_end(page, start)
            else:
                parts.append("<")
                at = start + 1
            continue
        at, tag = tag_end(page, start), m[1].lower()
        if page[start + 1] == "/":
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    zone = stack[-1].zone if stack else FREE
                    break
            continue
        if tag in SKIPPED:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE or tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        while stack and (stack[-1].tag == "p" or stack[-1].tag == tag == "li"):
            stack.pop()
        zone = stack[-1].zone if stack else FREE
        zone = zone_of(tag, page[m.end() : at], zone)
        stack.append(Open(tag, zone))
    flush()
    return lines, zones


def line_names(lines: list[str], zones: list[int]) -> list[tuple[bytes, int]]:
    """Lines to align by: hash of zone and text, and the how-manyth such line of the page it is."""
    seen: dict[bytes, int] = {}
    out = []
    for line, zone in zip(lines, zones):
        name = hashlib.blake2b(b"%d" % zone + line.encode("utf-8", "replace"), digest_size=8).digest()
        seen[name] = seen.get(name, 0) + 1
        out.append((name, seen[name]))
    return out


def common_lines(mine: list, other: list) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence; every name occurs once in each, so it is a longest rising run."""
    place = {name: k for k, name in enumerate(other)}
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(mine)
    for k, name in enumerate(mine):
        j = place.get(name)
        if j is None:
            continue
        slot = bisect_left(ends, j)
        before[k] = at[slot - 1] if slot else -1
        if slot == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[slot], at[slot] = j, k
    out, k = set(), at[-1] if at else -1
    while k >= 0:
        out.add(k)
        k = before[k]
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z made lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def agreement(a: str, b: str) -> int:
    """How many characters two paths have in common at their start."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


@dataclass
class Page:
    row: tuple
    host: str
    path: str
    lines: list[str]
    zones: list[int]
    names: list
    ghost: bool


def main_text(page: Page, before: Page | None, after: Page | None) -> str:
    near = [p for p in (before, after) if p is not None and p.host == page.host]
    partner = max(near, key=lambda p: agreement(p.path, page.path), default=None)
    shared = common_lines(page.names, partner.names) if partner else set()
    kept = [line for k, (line, zone) in enumerate(zip(page.lines, page.zones)) if zone == ARTICLE or (zone == FREE and k not in shared)]
    return "\n".join(kept)


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (page_id, url, host, path, html, ghost) -> (page_id, url, text) of those that are no ghosts, each beside its neighbours."""
    before: Page | None = None
    now: Page | None = None
    ids, urls, texts = [], [], []

    def put(page: Page, after: Page | None) -> None:
        if page.ghost:
            return
        ids.append(page.row[0])
        urls.append(page.row[1])
        texts.append(main_text(page, before, after))

    for batch in batches:
        kind = batch.column("page_id").type
        columns = [batch.column(c) for c in ("page_id", "url", "host", "path", "html", "ghost")]
        for k in range(batch.num_rows):
            page_id, url, host, path, source, ghost = (c[k].as_py() for c in columns)
            lines, zones = read_lines(source)
            page = Page((page_id, url), host, path, lines, zones, line_names(lines, zones), ghost)
            if now is not None:
                put(now, page)
            before, now = now, page
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
            ids, urls, texts = [], [], []
    if now is not None:
        put(now, None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def range_borders(keys: DataFrame, width: int) -> tuple[list[str], list[str]]:
    """First and last key of each of at most ``width`` ranges of the column key, in order."""
    ranges = keys.repartitionByRange(width, "key").groupBy(F.spark_partition_id().alias("range"))
    rows = ranges.agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("first").collect()
    return [r["first"] for r in rows], [r["last"] for r in rows]


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html", ranges: int | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page; ``ranges`` is the number of tasks, else the width of shuffles."""
    # The sign between the parts comes before all others, so keys sort by host, then path, then id.
    key = F.concat_ws("\0", host_of(F.col(url)), path_of(F.col(url)), F.col(id_column).cast("string"))
    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url).alias("url"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col(source).alias("html"),
        key.alias("key"),
    )
    width = ranges or shuffle_width(pages.sparkSession)
    firsts, lasts = range_borders(rows.select("key"), width)

    @F.pandas_udf("array<int>")
    def places(column: pd.Series) -> pd.Series:
        """Own range of each key, then those that need it as a neighbour."""
        out = []
        for k in column:
            own = bisect_right(firsts, k) - 1
            out.append([own, *([own - 1] if own and k == firsts[own] else []), *([own + 1] if own + 1 < len(lasts) and k == lasts[own] else [])])
        return pd.Series(out)

    kind = rows.schema["page_id"].dataType.simpleString()
    dealt = rows.withColumn("places", places("key")).select("*", F.posexplode("places").alias("nth", "range")).drop("places")
    dealt = dealt.withColumn("ghost", F.col("nth") > 0).drop("nth")
    beside = dealt.repartitionById(width, "range").sortWithinPartitions("range", "key", F.xxhash64("html"))
    return beside.mapInArrow(difference, f"page_id {kind}, url string, text string").select(
        F.col("page_id").alias(id_column), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )
