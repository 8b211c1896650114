"""HTML extraction by nearest-URL page differencing."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
LAST = re.compile(r"<(?:!|\?)")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas noembed noframes xmp head".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav footer aside form menu dialog select button".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that keep their place on the stack; the end of others is not waited for, so unclosed ones do no harm.
HELD = BLOCK - frozenset("p li dt dd td th tr tbody thead tfoot option hr h1 h2 h3 h4 h5 h6 html body".split()) | frozenset(("span",))
#: Words in class, id or role that mark what surrounds an article.
SIGNS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related recommended comment comments disqus respond replies widget pagination pager toolbar masthead contentinfo complementary search login alert".split())
#: First words of class names that tell what a wrapper has, not what it is.
STATES = frozenset("has no with without is".split())

MAIN, OTHER, AROUND_ZONE = 1, 0, -1
#: Added to the zone of a line that many pages of the host hold at the same place.
FRAMED = 4
MASK = (1 << 64) - 1


def _marked(attrs: str) -> bool:
    for m in NAMED.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name not in ("class", "id", "role"):
            continue
        for words in map(WORDS.findall, value.split()):
            if words and words[0] not in STATES and not SIGNS.isdisjoint(words):
                return True
    return False


def text_lines(html: str) -> tuple[list[str], list[int]]:
    """The blocks of text of a page in order, with white space made single spaces, and the zone of each:
    inside the article or main element, around it (menus, footers, forms, adverts, comments), or other."""
    lines: list[str] = []
    zones: list[int] = []
    held: list[tuple[str, int]] = []  # open elements, each with the zone inside it
    zone, parts, at = OTHER, [], 0
    open_now: Counter = Counter()  # how many of each name are held
    endless: set[str] = set()  # elements whose end is nowhere behind this place
    last = html.rfind(">")  # no tag begins behind it

    def close() -> None:
        if parts:
            line = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if line:
                lines.append(line)
                zones.append(zone)

    while True:
        m = TOKEN.search(html, at) if at <= last else None
        if m is None:
            # behind the last > only an unfinished comment or declaration is no text
            end = LAST.search(html, at)
            parts.append(html[at : end.start()] if end else html[at:])
            close()
            return lines, zones
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if name == "head" or ends:
                continue  # what a head holds as text is in elements of this kind itself
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            if end is None:
                endless.add(name)
            if end is None and name in ("script", "style"):
                close()
                return lines, zones
            at = end.end() if end else at
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
        elif name == "br":
            parts.append(" ")
        if name not in HELD or name in VOID or attrs.endswith("/") and not ends:
            continue
        if ends:
            if not open_now[name]:
                continue
            while True:
                gone, _ = held.pop()
                open_now[gone] -= 1
                if gone == name:
                    break
        else:
            inside = zone
            if name == "main":
                inside = MAIN  # there is one, whatever wraps it
            elif zone != AROUND_ZONE:
                if name in AROUND or name == "header" and zone != MAIN or _marked(attrs):
                    inside = AROUND_ZONE
                elif name == "article":
                    inside = MAIN
            if inside != zone:
                close()
            held.append((name, inside))
            open_now[name] += 1
        new = held[-1][1] if held else OTHER
        if new != zone:
            close()
            zone = new


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of ``a``, whether a longest common subsequence with ``b`` holds it.

    Equal ends are matched first and lines that the other page lacks are left out (neither changes the
    length), so the table covers only what is in doubt; large tables are halved (Hirschberg).
    """
    out = [False] * len(a)
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < min(end_a, end_b) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        out[end_a] = True
    ids: dict[str, int] = {}
    both = set(a[lo:end_a]) & set(b[lo:end_b])
    x = [(i, ids.setdefault(a[i], len(ids))) for i in range(lo, end_a) if a[i] in both]
    y = np.array([ids[s] for s in b[lo:end_b] if s in both], np.int64)

    def lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.zeros(len(v) + 1, np.int64)
        for k in u:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (v == k)))
        return row

    def align(rows: list[tuple[int, int]], v: np.ndarray) -> None:
        if not rows or not len(v):
            return
        if len(rows) == 1:
            if (v == rows[0][1]).any():
                out[rows[0][0]] = True
            return
        half = len(rows) // 2
        u = np.array([k for _, k in rows], np.int64)
        down, up = lengths(u[:half], v), lengths(u[half:][::-1], v[::-1])[::-1]
        cut = int((down + up).argmax())
        align(rows[:half], v[:cut])
        align(rows[half:], v[cut:])

    align(x, y)
    return out


def _near(path: str, other: str) -> int:
    """Length of the common beginning of two paths."""
    n = min(len(path), len(other))
    return next((i for i in range(n) if path[i] != other[i]), n)


def _places(host: str, lines: list[str], zones: list[int]) -> list[tuple[int, int]]:
    """Two keys for each line: what it says at its place from the beginning, and from the end, of the lines of its zone on this host."""
    n, at, out = Counter(zones), Counter(), []
    salt = blake2b(host.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    for s, z in zip(lines, zones, strict=True):
        k = int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8, key=salt).digest(), "little") ^ (z & 3)
        ends = (2 * at[z], 2 * (n[z] - 1 - at[z]) + 1)
        out.append(tuple(((k ^ (e + 1) * 0x9E3779B97F4A7C15) & MASK) - (1 << 63) for e in ends))
        at[z] += 1
    return out


def _beside(lines: list[str], zones: list[int]) -> list[int]:
    """For each line a number in 0..127 of the page's longest other line outside menus and the like: copies of a page have the same."""
    longest = sorted({s for s, z in zip(lines, zones, strict=True) if z != AROUND_ZONE}, key=lambda s: (-len(s), s))[:2]
    code = [blake2b(s.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] % 128 for s in longest] + [0, 0]
    return [code[1] if longest and s == longest[0] else code[0] for s in lines]


def is_copy(page: tuple, other: tuple, copy_share: float) -> bool:
    """Whether a page (lines, zones, framed) shares more than ``copy_share`` of its own text with another.

    Lines that many pages of the host hold at the same place are no page's own: thin pages in a large frame are no
    copies of each other. Pages without own text are copies of each other only.
    """
    own = [s for s, z, f in zip(*page, strict=True) if z != AROUND_ZONE and not f]
    size = sum(map(len, own))
    if not size:
        return not any(z != AROUND_ZONE and not f for z, f in zip(*other[1:], strict=True))
    both = set(other[0])
    if sum(len(s) for s in own if s in both) <= copy_share * size:
        return False  # what the alignment holds cannot be more
    shared = shared_lines(page[0], other[0])
    return sum(len(s) for s, z, f, x in zip(*page, shared, strict=True) if z != AROUND_ZONE and not f and x) > copy_share * size


def pairs(pages: list[tuple], paths: list[str], copy_share: float) -> list[int | None]:
    """For each page of a host in order of path, the nearest page that is no copy of it (the one before it on a tie).

    Past a copy the walk goes on where that copy's own walk ended, so it is short in large groups of copies.
    """
    n = len(pages)
    ends: list[list[int]] = []
    for step in (-1, 1):
        end = [0] * n
        for i in range(n) if step < 0 else range(n - 1, -1, -1):
            j = i + step
            while 0 <= j < n and is_copy(pages[i], pages[j], copy_share):
                j = end[j]
            end[i] = j
        ends.append(end)
    out = []
    for i, two in enumerate(zip(*ends, strict=True)):
        near = [(_near(paths[i], paths[j]), -k, j) for k, j in enumerate(two) if 0 <= j < n]
        out.append(max(near)[2] if near else None)
    return out


def main_text(lines: list[str], zones: list[int], pair: list[str] | None, copy_share: float, framed: list[bool] | None = None) -> tuple[list[str], int]:
    """What stays of a page, given the lines of its nearest page, and how many lines the differencing deleted.

    ``framed`` tells the lines that many pages of the host hold at the same place. A shared line in an article
    or main element goes if it is one of them; other shared lines go in any case.
    """
    framed = framed or [False] * len(lines)
    shared = [False] * len(lines)
    if pair:
        shared = shared_lines(lines, pair)
        # pages that share most of their text are copies of each other and tell nothing about the frame around it
        size = sum(len(s) for s, z in zip(lines, zones, strict=True) if z != AROUND_ZONE)
        same = sum(len(s) for s, z, x in zip(lines, zones, shared, strict=True) if z != AROUND_ZONE and x)
        if same > copy_share * size:
            shared = [False] * len(lines)
    gone = [x and (z != MAIN or f) for x, z, f in zip(shared, zones, framed, strict=True)]
    size = Counter()
    for s, z, x in zip(lines, zones, gone, strict=True):
        size[z] += 0 if x else len(s)
    # an article that holds less than the text around it is a teaser, and the page's text is both
    best = (MAIN,) if MAIN in zones and size[MAIN] >= size[OTHER] else (MAIN, OTHER)
    return [s for s, z, x in zip(lines, zones, gone, strict=True) if z in best and not x], sum(gone)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block: int = 2_000, copy_share: float = 0.5, frame_share: float = 0.25, frame_least: int = 3, edge: int = 32) -> DataFrame:
    """The main text of each page: page_id, url, text, n_shared (lines deleted because the paired page has them).

    Pages of one host are ordered by URL path; each is paired with the page that is
    no copy of it and whose path begins most like its own (the one before it on a tie). A copy shares more than
    ``copy_share`` of the text that is not the host's frame. The lines of the two are aligned by longest common
    subsequence and the shared lines deleted.
    Inside an article or main element repeated passages may be text, so a shared line there goes only if at
    least ``frame_share`` of the host's pages (and ``frame_least`` pages) hold it at the same place, counted from
    the beginning or the end of the element. Where what stays of the article is less than what stays around it,
    both are the text; else only the article. Menus, headers, footers, asides, forms, and elements whose class, id or role names an
    advert, notice, comment and the like are left out of the text, but take part in the alignment.
    White space inside a block becomes one space; blocks are joined by an empty line.

    Null or empty html, or one without text: an empty text. A null or unparsable url: host and path are empty.
    Repeated rows come back as often as they came. A page alone on its host has no pair. An empty table gives
    an empty table. Pages are dealt by ranges of (host, path, id) of about ``block`` pages, so a hot host spreads
    over many tasks in order; a range also sees the pages beyond its ends, as far as ``edge`` different ones of
    the next range, and a walk past copies ends there. A task holds the pages of one host in its range.
    """
    host = lambda c: F.coalesce(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = lambda c: F.coalesce(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, key, bit = [], [], []
            for one, name, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, zones = text_lines(code or "")
                mine = {k: b for ks, z, b in zip(_places(name, found, zones), zones, _beside(found, zones), strict=True) if z != AROUND_ZONE for k in ks}
                key.extend(mine)
                bit.extend(mine.values())
                h.extend([one] * len(mine))
            bits = np.array(bit, np.int64)
            halves = [np.where(bits >> 6 == k, np.int64(1) << (bits & 63), 0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, key, *halves)], names=["h", "key", "low", "high"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, row, part, beyond = [], [], [], [], []
            for i, (code, name, at, frame) in enumerate(zip(*(batch.column(j).to_pylist() for j in (2, 3, 5, 6)), strict=True)):
                found, zones = text_lines(code or "")
                frame = set(frame or ())
                marked = [z + FRAMED * (not frame.isdisjoint(ks)) for z, ks in zip(zones, _places(name, found, zones), strict=True)] if frame else zones
                mine = max(bisect_right(lows, at) - 1, 0)
                near = [mine - 1] * (mine > 0 and at <= heads[mine]) + [mine + 1] * (mine + 1 < len(lows) and at >= tails[mine])
                for k in (mine, *near):
                    row.append(i)
                    part.append(k)
                    beyond.append(k != mine)
                    texts.append(found)
                    marks.append(marked)
            row = pa.array(row, pa.int64())
            made = [pa.array(texts, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int8())), pa.array(part, pa.int64()), pa.array(beyond, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(row) for j in (0, 1, 3, 4, 5)), *made], names=["id", "url", "host", "path", "at", "lines", "zones", "part", "beyond"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = head = None
        first: set[int] = set()
        last: dict[int, str] = {}  # where each content was seen last, in that order
        for batch in batches:
            for at, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = at if low is None else low
                if len(first) < edge:
                    first.add(code)
                    head = at
                last.pop(code, None)
                last[code] = at
                if len(last) > 4 * edge:
                    last = dict(list(last.items())[-edge:])
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (low, head, list(last.values())[-edge:][0])], names=["low", "head", "tail"])

    slim = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    slim = slim.withColumn("at", F.concat("host", F.lit("\x00"), "path", F.lit("\x00"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    kind = slim.schema["id"].dataType.simpleString()
    # ranges of about ``block`` pages in order of host and path: where each begins, and which pages its neighbours see
    n = -(-pages.count() // block)
    order = slim.select("at", F.xxhash64("html").alias("code")).repartitionByRange(max(n, 1), "at").sortWithinPartitions("at")
    found = sorted(tuple(r) for r in order.mapInArrow(edges, "low string, head string, tail string").collect())
    lows, heads, tails = ([r[i] for r in found] for i in range(3))
    # what many pages of a host hold at the same place: two numbers a line are counted, and only the frequent ones go on
    sizes = slim.groupBy(F.xxhash64("host").alias("s_h")).agg(F.count("*").alias("pages")).where(F.col("pages") >= frame_least)
    held = slim.select(F.xxhash64("host").alias("h"), "host", "html").mapInArrow(places, "h long, key long, low long, high long").groupBy("h", "key").agg((F.bit_count(F.bit_or("low")) + F.bit_count(F.bit_or("high"))).alias("set"))
    # the number of different pages from the share of 128 bits that they leave unset
    held = held.withColumn("n", F.when(F.col("set") == 128, F.lit(1e9)).otherwise(F.round(-128 * F.log1p(-F.col("set") / 128)))).where(F.col("n") >= frame_least)
    held = held.join(sizes, (F.col("h") == F.col("s_h")) & (F.col("n") >= frame_share * F.col("pages")))
    held = small_side(held.groupBy(F.col("h").alias("f_h")).agg(F.collect_list("key").alias("frame")), 20_000)
    lines = slim.join(held, F.xxhash64("host") == F.col("f_h"), "left").select("id", "url", "html", "host", "path", "at", "frame")
    lines = lines.mapInArrow(read, f"id {kind}, url string, host string, path string, at string, lines array<string>, zones array<tinyint>, part long, beyond boolean")
    dealt = lines.repartition(max(n, 1), "part").sortWithinPartitions("part", "at").select("id", "url", "part", "host", "path", "lines", "zones", "beyond")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[2:4]):
            group = list(group)
            read = [(r[5], [(z + 1) % FRAMED - 1 for z in r[6]], [z + 1 >= FRAMED for z in r[6]]) for r in group]
            kept = []
            for r, page, pair in zip(group, read, pairs(read, [r[4] for r in group], copy_share), strict=True):
                if not r[7]:
                    found, gone = main_text(*page[:2], None if pair is None else read[pair][0], 1, page[2])
                    kept.append((r[0], r[1], "\n\n".join(found), gone))
            if kept:
                made = [pa.array(v, t) for v, t in zip(zip(*kept, strict=True), (*types, pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["id", "url", "text", "n_shared"])

    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]]
    return dealt.mapInArrow(differ, f"id {kind}, url string, text string, n_shared long").withColumnRenamed("id", page_id)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
