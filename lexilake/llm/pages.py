"""Main text of web pages by nearest-URL page differencing.

Each page is read into text lines (blocks between block-level tags), each with the zone it stands in: the marked
article, furniture (navigation, header, footer, sidebar, notice, advert, form, comments by tag, role or class), or
the open body. Pages of one host are sorted by URL path; a page is paired with whichever sorted neighbour has the
longer path prefix in common. Their lines are aligned by longest common subsequence and shared lines are deleted.

The body is the marked article where there is one, else the open lines; shared lines are deleted from either. Two
things differencing alone gets wrong are put right: furniture goes though no other page has it (adverts differ from
page to page), as do open lines beside a marked article (inside an article a class such as share-price, with a word
for a topic and another beside it, is no mark: only lists of links and shared lines go there); and copies of a page sit next to each other. Where the
nearest page shares more than half of the body, only lines that the page on the other side has too are deleted. If
that leaves less than COPY_REST of the body, all of these are copies, not evidence of furniture, and delete nothing.

Plan. What is shuffled is the lines, compressed, and one hash a line for the neighbours. Pages are dealt by ranges of
(host, path, page_id), cut at bounds from a sample, so a large host spreads over tasks. A range's first and last page
meet the next range's through a table of both, two pages a range, held by every task.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import json
import os
import re
from collections.abc import Callable

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.common import bounded_batches, partitions

TASK_ROWS = 20_000
TABLE_BITS = 1 << 27  # of the rows kept to align two pages
DOUBTFUL, ARTICLE, OPEN, FURNITURE = 3, 2, 1, 0  # no line is doubtful: a block so marked is of the article unless it is a list of links
COPY_REST = 0.1  # a page of whose body less than this is its own has copies for neighbours

# fixed values: HTML names
RAW = "script style noscript template svg math iframe object canvas select textarea title"
RAW_TEXT = "script style textarea title"
SELF_CLOSING = "svg math"
BLOCKS = "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
NESTED = "article aside blockquote body button details dialog div dl fieldset figure footer form header label main menu nav ol section table ul"
FURNITURE_TAGS = "nav footer aside form button dialog menu label fieldset head"
FURNITURE_ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"
FURNITURE_WORDS = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets"
TOPIC_WORDS = "banner copyright disclaimer header legal notice notices promotion related respond share sharing social"

_RAW, _BLOCK, _NEST = (frozenset(x.split()) for x in (RAW, BLOCKS, NESTED))
_TAGS, _ROLES, _WORDS, _TOPICS = (frozenset(x.split()) for x in (FURNITURE_TAGS, FURNITURE_ROLES, FURNITURE_WORDS, TOPIC_WORDS))
_TEXT, _EMPTY = (frozenset(x.split()) for x in (RAW_TEXT, SELF_CLOSING))
_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _RAW}
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s>]*)"  # a quote opens a value only after =; one that is never closed is part of the word
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?+")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _zone(name: str, attributes: str, within: int, in_article: bool) -> int:
    """Zone of an element's content, given that of what holds it."""
    if within == FURNITURE:
        return FURNITURE
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [{w.lower() for w in _TOKEN.findall(x)} for x in (found.get("class", "") + " " + found.get("id", "")).split()]
    words, marks = set().union(*names), [x for x in names if x & _WORDS]
    role = found.get("role", "").lower()
    if name in _TAGS or role in _ROLES or "hidden" in found or (name == "header" and not in_article):
        return FURNITURE
    main = name in ("article", "main") or role == "main" or found.get("itemprop") == "articleBody"
    if words & _WORDS and name not in ("body", "html") and not (main and not in_article and not words & {"comment", "comments", "related", "ad", "promo"}):
        topic = in_article and all(x & _WORDS <= _TOPICS and x - _WORDS for x in marks)  # related-work, share-price
        return DOUBTFUL if topic else FURNITURE
    return ARTICLE if main else within


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each non-empty block of a page, in order; references decoded, white space single."""
    out: list[tuple[int, str]] = []
    text, link, stack = [], 0, [("", OPEN)]
    html = html or ""
    in_link, unclosed = False, set()

    def flush():
        nonlocal text, link
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            zone = stack[-1][1]
            if zone in (OPEN, DOUBTFUL) and link > 0.8 * sum(map(len, text)):
                zone = FURNITURE  # a list of links
            elif zone == DOUBTFUL:
                zone = ARTICLE  # differencing decides
            out.append((zone, line))
        text, link = [], 0

    def add(piece: str):
        nonlocal link
        if piece:
            text.append(piece)
            if in_link:
                link += len(piece)

    at = 0
    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _RAW and not m[1]:
            if name in _EMPTY and m[3].endswith("/"):
                continue
            end = None if name in unclosed else _END[name].search(html, at)
            if end:
                at = end.end()
            elif name in _TEXT:
                at = len(html)
            else:
                unclosed.add(name)  # only the tag goes; no later one is closed either
            continue
        if name == "a":
            in_link = not m[1]
        elif name == "br":
            text.append(" ")
        elif name in _BLOCK:
            flush()
            in_link = False
        if name in _NEST or name == "head":
            if not m[1]:
                if name == "body":
                    stack[1:] = []
                stack.append((name, _zone(name, m[3], stack[-1][1], any(x[1] == ARTICLE for x in stack))))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
    add(html[at:])
    flush()
    return out


def _row(v: int, own: list[int], masks: dict[int, int], full: int) -> int:
    """The bit-parallel row v after the lines own: bit j is 0 where the subsequence grows at line j of the other."""
    for x in own:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _masks(b: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    return masks


def _growth(own: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of own with each first part of b."""
    v = _row((1 << len(b)) - 1, own, _masks(b), (1 << len(b)) - 1)
    return list(itertools.accumulate((c == "0" for c in reversed(f"{v:0{len(b)}b}")), initial=0)) if b else [0]


def _common_places(a: list[int], b: list[int], at: int, out: set[int]) -> None:
    """Adds at + the places in a of a longest common subsequence with b. Where a table of all rows would be large, a
    is halved and b parted where the halves' subsequences are longest together."""
    while a and b and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        first, second = _growth(a[:half], b), _growth(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: first[j] + second[len(b) - j])
        _common_places(a[:half], b[:cut], at, out)
        a, b, at = a[half:], b[cut:], at + half
    masks, full = _masks(b), (1 << len(b)) - 1
    rows = [full]
    for x in a:
        rows.append(_row(rows[-1], [x], masks, full))
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.add(at + i)


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in own of a longest common subsequence with other, by bit-parallel rows of at most TABLE_BITS together."""
    a = z = 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        a += 1
    while z < min(len(own), len(other)) - a and own[-1 - z] == other[-1 - z]:
        z += 1
    out = {*range(a), *range(len(own) - z, len(own))}
    mine, theirs = own[a : len(own) - z], other[a : len(other) - z]
    there, here = set(theirs), set(mine)
    places = [i for i, x in enumerate(mine) if x in there]
    found: set[int] = set()
    _common_places([mine[i] for i in places], [x for x in theirs if x in here], 0, found)
    return out | {a + places[i] for i in found}


def main_text(lines: list[tuple[int, str]], shared: set[int], beside: Callable[[], set[int] | None] = lambda: None) -> tuple[str, int]:
    """(text, number of lines that differencing deleted).

    shared: places of the lines shared with the nearest page. beside() gives those shared with the page on the other
    side, None where there is none; it is asked only where the nearest page may be a copy.
    """
    marked = any(z == ARTICLE for z, _ in lines)
    body = {i: len(t) for i, (z, t) in enumerate(lines) if z == (ARTICLE if marked else OPEN)}
    size, left = sum(body.values()), sum(n for i, n in body.items() if i not in shared)
    if 2 * left < size:
        other = beside()
        if other is not None:
            shared = shared & other
            left = sum(n for i, n in body.items() if i not in shared)
        if left < COPY_REST * size:
            shared = set()
    keep = [lines[i][1] for i in body if i not in shared]
    return " ".join(keep), len(shared)


def _hashes(lines: list[tuple[int, str]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - 2**63 for _, t in lines]


def _key(host: str, path: str, page_id: int | None) -> tuple:
    """Spark's order of (host, path, page_id): bytes, nulls first."""
    return host.encode(), path.encode(), page_id is not None, page_id or 0


def _reader(bounds: list[tuple]):
    """Reads pages; part: the place of the page's key among the bounds. Pages without a host need no order."""

    def read(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            pages = [page_lines(x.as_py()) for x in b.column(5)]
            keys = zip(*(b.column(j).to_pylist() for j in (2, 3, 0, 4)), strict=True)
            part = [bisect.bisect_right(bounds, _key(h, p, i)) if h else row % (len(bounds) + 1) for h, p, i, row in keys]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j) for j in range(5)), pa.array(part, pa.int32()), pa.array([pack.compress(json.dumps(p, ensure_ascii=False).encode("utf-8", "surrogatepass")) for p in pages], pa.binary()), pa.array([_hashes(p) for p in pages], pa.list_(pa.int64()))],
                ["page_id", "url", "host", "path", "row", "part", "lines", "own"],
            )

    return read


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def _differ(edges: dict[int, tuple[tuple, tuple]]):
    """Compares pages in order of (part, key). edges: (page_id, host, path, own) of each part's first and last page."""
    parts = sorted(edges)

    def pages(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("part", "page_id", "host", "path", "own", "lines", "url")), strict=True)

    def compared(batches):
        open_, out = zstandard.ZstdDecompressor(), []
        before = now = None
        for after in itertools.chain(pages(batches), [None]):
            if now:
                part, page_id, host, path, own, lines, url = now
                k = bisect.bisect_left(parts, part)
                left = before[1:5] if before and before[0] == part and before[2] else edges[parts[k - 1]][1] if k else None
                k = bisect.bisect_right(parts, part)
                right = after[1:5] if after and after[0] == part else edges[parts[k]][0] if k < len(parts) else None
                left, right = (x if x and host and x[1] == host else None for x in (left, right))
                near, far = left, right
                if right and (not left or _common(path, right[2]) > _common(path, left[2])):
                    near, far = right, left
                beside = lambda own=own, far=far: shared_lines(own, far[3]) if far else None
                text, gone = main_text(json.loads(open_.decompress(lines).decode("utf-8", "surrogatepass")), shared_lines(own, near[3]) if near else set(), beside)
                out.append((page_id, url, text, len(text), gone, near and near[0]))
                if len(out) == 512:
                    yield _results(out)
                    out = []
            before, now = now, after
        yield _results(out)

    return compared


def _results(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["page_id", "url", "text", "n_chars", "n_shared", "neighbour"])


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut the pages with a host into about so many parts, from a sample of about 100 keys a part."""
    share = min(1.0, 100.0 * parts / max(1, keys.count()))
    sample = sorted(_key(*r) for r in keys.select("host", "path", "page_id").sample(share, 42).collect())
    return sorted({sample[len(sample) * j // parts] for j in range(1, parts)} if sample else ())


def _edges(rows: DataFrame, keys: DataFrame, bounds: list[tuple]) -> dict[int, tuple[tuple, tuple]]:
    """(page_id, host, path, own) of the first and last page of each part, at most one part more than bounds."""

    def dealt(batches):
        for b in batches:
            part = [bisect.bisect_right(bounds, _key(*k)) for k in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["host", "path", "page_id", "url", "part"])

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), pa.array([_hashes(page_lines(x.as_py())) for x in b.column(4)], pa.list_(pa.int64()))], ["part", "last", "page_id", "url", "own"])

    key = F.struct("host", "path", "page_id", "url")
    ends = keys.select("host", "path", "page_id", "url").mapInArrow(dealt, "host string, path string, page_id long, url string, part int").groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("z")).collect()
    if not ends:
        return {}
    wanted = keys.sparkSession.createDataFrame([(r["part"], last, k["page_id"], k["url"]) for r in ends for last, k in ((False, r["a"]), (True, r["z"]))], "part int, last boolean, p long, u string")
    # of rows that share page_id and url, the first and last in the order of the pages
    met = rows.join(F.broadcast(wanted), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")))
    html = F.struct("row", "html")
    met = met.groupBy("part", "last", "page_id", "url").agg(F.min(html).alias("a"), F.max(html).alias("z"))
    met = met.select("part", "last", "page_id", "url", F.when(F.col("last"), F.col("z.html")).otherwise(F.col("a.html")).alias("html"))
    own = {(r["part"], r["last"]): r["own"] for r in met.mapInArrow(read, "part int, last boolean, page_id long, url string, own array<long>").collect()}
    return {r["part"]: tuple((k["page_id"], k["host"], k["path"], own[r["part"], last]) for last, k in ((False, r["a"]), (True, r["z"]))) for r in ends}


def extract_pages(pages: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars, n_shared, neighbour.

    Null html is empty and gives an empty text. Pages without a url, or alone on their host, have no neighbour;
    their zones decide alone. Repeated rows stay rows. neighbour is the page_id of the page compared with.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 512)
    shape = "page_id long, url string, host string, path string, row long, part int, lines binary, own array<long>"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.xxhash64(F.col("html").cast("string")).alias("row"),
        F.col("html").cast("string").alias("html"),
    )
    keys = rows.where("host <> ''").select("host", "path", "page_id", "url")
    tasks = max(partitions(spark), -(-pages.count() // task_rows))
    bounds = _bounds(keys, 4 * tasks)
    dealt = rows.mapInArrow(_reader(bounds), shape).repartition(tasks, "part").sortWithinPartitions("part", "host", "path", "page_id", "url", "row")
    return dealt.mapInArrow(_differ(_edges(rows, keys, bounds)), "page_id long, url string, text string, n_chars long, n_shared long, neighbour long")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
