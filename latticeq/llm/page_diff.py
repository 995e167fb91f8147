"""Main text of web pages by differencing each page with its nearest pages of the same host.

Pages of a host with equal lines are one page, at the first place, and get one verdict, so that a run of copies hides no neighbour. Pages are
ordered by host and URL path, and each is paired with the page before and after it. The text lines (blocks) of two pages are aligned
by their longest common subsequence; lines shared with the nearer page are template and go. Markup bounds the verdict: navigation, headers,
footers, sidebars, forms, adverts, notices and comments are never text, and what an article holds besides them always is. A neighbour that
shares most of a page's text is a copy of it, or both are thin pages of one template. The lines that differ tell which: they are the text, and
what is shared is template, if the page on the other side has the same lines and others in their place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Elements that end a block of text, that hold other elements, and that are never text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
HOLDERS = frozenset("article aside button details dialog div dl fieldset figure footer form head header main menu nav ol section select table textarea title ul".split())
CHROME = frozenset("aside button dialog fieldset footer form head menu nav select textarea title".split())
#: Words that mark what is not text, if a class, id or role is made of them and of PLACES alone: "ad", "site-nav", "comment_list", but not "no-sidebar".
MARKS = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer login menu modal nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("area article bar bottom box center block container content entry footer form global header holder inner left links list main menu outer page post posts primary right row secondary section signup site text top wrap wrapper".split())
#: The rest of a tag; a quoted value may hold any character, if an attribute can end behind it.
_REST = r"""((?:(?>=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>]))*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*){_REST}>|<[!?/][^>]*>|<[a-zA-Z!/?][^>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_PART = re.compile(r"[^a-z0-9]+")

PLAIN, ARTICLE = 0, 1
#: A neighbour that shares more of the characters than this is a copy, or a page as thin.
COPY_SHARE = 0.8


def marked(attributes: str) -> bool:
    """Whether a class, an id or the role of a tag says that the element is not text."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in "".join(values).split():
                parts = [x for x in _PART.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x and not x[0].isdigit()]
                if not MARKS.isdisjoint(parts) and all(x in MARKS or x in PLACES for x in parts):
                    return True
    return False


def blocks(source: str | None) -> list[tuple[int, str]]:
    """Role and text of each block of a page that its markup does not rule out, in order; white space is one blank, references are decoded."""
    found: list[tuple[int, str]] = []
    open_: list[tuple[str, bool]] = []  # holders and whether they rule their text out
    pieces: list[str] = []
    source = source or ""

    def flush() -> None:
        if pieces:
            own = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if own and not any(out for _, out in open_):
                found.append((ARTICLE if any(name in ("article", "main") for name, _ in open_) else PLAIN, own))

    last = 0
    for token in _TOKEN.finditer(source):
        if token.start() > last:
            pieces.append(source[last : token.start()])
        last = token.end()
        if not token[3]:
            continue
        name = token[3].lower()
        if name == "br":
            pieces.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if name == "body" and not token[2]:
            open_.clear()
        if name not in HOLDERS:
            continue
        if token[2]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if at is not None:
                del open_[at:]
        elif not token[4].endswith("/"):
            within = any(held in ("article", "main") for held, _ in open_)
            chrome = name in CHROME or name == "header" and not within
            open_.append((name, chrome or name not in ("article", "main", "body") and marked(token[4])))
    pieces.append(source[last:])
    flush()
    return found


def common_lines(one: list[int], other: list[int]) -> list[int]:
    """For each line of one, its partner in a longest common subsequence with other, or -1."""
    partner = [-1] * len(one)
    low, most = 0, min(len(one), len(other))
    while low < most and one[low] == other[low]:
        partner[low] = low
        low += 1
    high, end = len(one), len(other)
    while high > low and end > low and one[high - 1] == other[end - 1]:
        high, end = high - 1, end - 1
        partner[high] = end
    known = set(one[low:high]) & set(other[low:end])
    a, b = ([k for k in range(low, to) if lines[k] in known] for lines, to in ((one, high), (other, end)))
    for i, k in _longest([one[k] for k in a], [other[k] for k in b]):
        partner[a[i]] = b[k]
    return partner


#: Bits that the rows of a longest common subsequence take at most; longer pages are halved.
ROOM = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each number of lines of a, bits: those at 0 among the first k count the longest common subsequence with the first k lines of b."""
    masks: dict[int, int] = {}
    for k, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << k
    row = full = (1 << len(b)) - 1
    yield row
    for line in a:
        met = row & masks.get(line, 0)
        row = (row + met | row - met) & full
        yield row


def _longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit-parallel rows; what is too large for ROOM is halved where both halves' lengths sum to the most."""
    n, m = len(a), len(b)
    if n > 1 and n * m > ROOM:
        half = n // 2
        for ahead in _rows(a[:half], b):
            pass
        for back in _rows(a[half:][::-1], b[::-1]):
            pass
        lost = [f"{x:0{m}b}" for x in (ahead, back)]
        value, best, cut = m - back.bit_count(), -1, 0
        for k in range(m + 1):
            if value > best:
                best, cut = value, k
            if k < m:
                value += (lost[0][m - 1 - k] == "0") - (lost[1][k] == "0")
        return _longest(a[:half], b[:cut]) + [(i + half, k + cut) for i, k in _longest(a[half:], b[cut:])]
    rows = list(_rows(a[::-1], b[::-1]))
    length = lambda i, k: m - k - (rows[n - i] & (1 << m - k) - 1).bit_count()
    out: list[tuple[int, int]] = []
    i = k = 0
    while i < n and k < m:
        if a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        elif length(i + 1, k) == length(i, k):
            i += 1
        else:
            k += 1
    return out


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def kept_blocks(roles: list[int], sizes: list[int], partners: list[tuple[list[int], int]]) -> list[bool]:
    """Which blocks stay. partners: for each neighbour, nearest first, the partner of each block or -1, and how many blocks it has.

    A block of an article stays. Any other goes if the nearest neighbour has it that is no copy; where both are near copies, if both have it, and
    each of the three pages has a block that the others lack.
    """
    most = COPY_SHARE * sum(sizes)
    own = [x for x in partners if sum(size for size, at in zip(sizes, x[0], strict=True) if at >= 0) <= most]
    if own:
        shared = [at >= 0 for at in own[0][0]]
    elif len(partners) == 2 and all(any(at < 0 for at in places) and n > sum(at >= 0 for at in places) for places, n in partners):
        shared = [a >= 0 and b >= 0 for a, b in zip(partners[0][0], partners[1][0], strict=True)]
    else:
        shared = [False] * len(roles)
    return [role == ARTICLE or not gone for role, gone in zip(roles, shared, strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html); blocks are joined by an empty line.

    A null or empty html gives an empty text, a null url the host '' and path ''. Pages of one path are ordered by page_id; pages of a
    host with equal lines are one page with one verdict; of two neighbours with equal beginnings of the path, the one before counts as nearer;
    repeated rows give their text each, however long. An empty table gives an empty table; other columns are left out. Only hashes of lines are sorted and
    ranked, by a range sort and partition counts, so that a large host is spread over many tasks; texts move once, to meet the verdict.
    """
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                texts = pa.array(["\n".join(text for _, text in own) for own in found], pa.string())
                roles = pa.array(["".join(str(role) for role, _ in own) for own in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), part.column(1), texts, roles], ["key", "page_id", "url", "text", "roles"])

    split = source.mapInArrow(parsed, "key bigint, page_id bigint, url string, text string, roles string")
    each = F.when(F.col("roles") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)://([^/?#]*)", 1)), F.lit("")).alias("host")
    path = F.coalesce(F.regexp_extract("url", r"(?s)://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path")
    split = split.withColumn("list", F.xxhash64(host, "text", "roles"))
    hashed, sizes_ = F.transform(each, lambda x: F.xxhash64(x)).alias("lines"), F.transform(each, lambda x: F.length(x)).alias("sizes")
    lines = stored(split.select("list", "key", "page_id", host, path, hashed, sizes_, "roles", F.monotonically_increasing_id().alias("row")))
    first_of = lines.groupBy("list").agg(F.min(F.struct("path", "page_id", "key", "row")).alias("x")).select("x.row")
    lines = lines.join(first_of, "row", "leftsemi").drop("row")
    order = ["host", "path", "page_id", "key"]
    ordered = lines.repartitionByRange(shuffle_width(pages.sparkSession), *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {row["part"]: row["count"] for row in ordered.groupBy("part").count().collect()}  # a row per partition
    first = np.cumsum([0, *(sizes[k] for k in sorted(sizes))]).tolist()
    offset = F.create_map(*(F.lit(int(x)) for k, at in zip(sorted(sizes), first, strict=False) for x in (k, at)))[F.col("part")] if sizes else F.lit(0)
    ranked = ordered.select("list", (offset.cast("bigint") + F.col("place")).alias("rank"), "host", "path", "lines", "sizes", "roles")
    page = F.struct("host", "path", "lines")
    before, after = (ranked.select((F.col("rank") + step).alias("rank"), page.alias(name)) for step, name in ((1, "before"), (-1, "after")))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                keep = []
                for row in part.to_pylist():
                    others = [x for x in (row["before"], row["after"]) if x is not None and x["host"] == row["host"]]
                    others.sort(key=lambda x: -_prefix(x["path"], row["path"]))  # stable: the page before wins ties
                    partners = [(common_lines(row["lines"], x["lines"]), len(x["lines"])) for x in others]
                    keep.append("".join("01"[x] for x in kept_blocks([int(x) for x in row["roles"]], row["sizes"], partners)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keep, pa.string())], ["list", "keep"])

    paired = ranked.join(before, "rank", "left").join(after, "rank", "left").select("list", "host", "path", "lines", "sizes", "roles", "before", "after")
    verdicts = paired.mapInArrow(judged, "list bigint, keep string")
    kept = F.filter(each, lambda x, i: F.substring(F.col("keep"), i + 1, 1) == "1")
    return split.join(verdicts, "list", "left").select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
