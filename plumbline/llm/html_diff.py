"""Main text of web pages: nearest-URL differencing, with the page's own marks of what is article and what isn't.

A page is cut into text lines, one for each block element. Pages are sorted by host, URL path and id; each is paired with
the neighbour whose path is nearer, the pair's lines are aligned by longest common subsequence, and lines they share are
deleted: what pages of a site have in common isn't any page's text.

A line is known by its text. A line inside an element that the page marks as menu, advert, footer and so on is known by its
place instead, the names and classes of the elements around it, so menus with words of their own align as well. Shared
lines inside a marked article stay: neighbours may hold copies of one article or quote the same passage. What alignment
leaves of marked menus and the like goes in the end, and of a page that marks its article all that lies outside it.

A host of many pages is split by path into chunks, each with copies of the pages before and after it, so that neighbours
don't depend on how rows are dealt out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import bounded_batches, schema_with
from .url_filter import host_of, path_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLASS = re.compile(r"\bclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
SPACE = re.compile(r"\s+")
# Element names of HTML, by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
MAIN = frozenset(("article", "main"))
SKIPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg math object canvas audio video dialog menu title xmp noembed noframes".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs comment comments commentlist respond disqus footer masthead share sharing social related newsletter subscribe popup modal toolbar pagination pager skip".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Pages in a chunk of a host; more where all pages would make more than CHUNKS chunks.
CHUNK_PAGES = 256
CHUNKS = 10_000
#: Pages in an output batch.
OUT_ROWS = 256
# What a line is part of.
HIDDEN, PLAIN, ARTICLE = 0, 1, 2


def _skips(name: str, attributes: str, in_main: bool) -> bool:
    if name in SKIPPED or (name == "header" and not in_main):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and any(w in SKIPPED_WORDS for part in value.split() for w in (part, *re.split(r"[-_]+", part)[:1])):
            return True
        if (key == "role" and value.strip() in SKIPPED_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def page_lines(source: str) -> list[tuple[int, object, str]]:
    """The lines of a page in order: what each is part of, what it is known by, and its text (none if hidden)."""
    lines: list[tuple[int, object, str]] = []
    parts: list[str] = []
    hidden = False  # whether skipped text stands before the next break
    stack: list[tuple[str, bool, int]] = []  # open elements, whether each is skipped, and a number for the path to it
    open_names: dict[str, int] = {}
    skipped = main = 0

    def flush() -> None:
        nonlocal hidden
        if not skipped:
            line = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if line:
                lines.append((ARTICLE if main else PLAIN, line, line))
        if hidden:
            lines.append((HIDDEN, stack[-1][2] if stack else 0, ""))
            hidden = False

    def pop() -> str:
        nonlocal skipped, main
        e, s, _ = stack.pop()
        open_names[e] -= 1
        skipped -= s
        main -= e in MAIN and not s and not skipped
        return e

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        end = m.start() if m else n
        if end > at:
            if skipped:
                hidden = hidden or not source[at:end].isspace()
            else:
                parts.append(entities.unescape(source[at:end]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            if not skipped:
                parts.append("\n")
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            if open_names.get(name):
                while pop() != name:
                    pass
        elif name not in VOID and not m[3].endswith("/"):
            s = bool(skipped) or _skips(name, m[3], main > 0)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                if not s:
                    parts.append(entities.unescape(source[at : close.start() if close else n]) if name in ("textarea", "title") else "")
                at = close.end() if close else n
                continue
            if name == "p" and not skipped and open_names.get("p"):
                for _ in range(_paragraph(stack)):
                    pop()
            stack.append((name, s, hash((stack[-1][2] if stack else 0, name, _class(m[3])))))
            open_names[name] = open_names.get(name, 0) + 1
            skipped += s
            main += name in MAIN and not s
    while stack and skipped:
        pop()
    flush()
    return lines


def _class(attributes: str) -> str:
    found = CLASS.search(attributes) if attributes else None
    return found[0] if found else ""


def _paragraph(stack: list[tuple[str, bool, int]]) -> int:
    """How many open elements end where a paragraph begins: an open paragraph and what is left open in it, unless other
    blocks or skipped elements are."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            return 0 if any(s for _, s, _ in stack[k:]) else len(stack) - k
        if stack[k][0] in BLOCK:
            return 0
    return 0


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of a and each start of b: len(b) + 1 numbers, from one bit row of b."""
    place: dict[object, int] = {}
    for k, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & place.get(x, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer((full & ~row).to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def shared(a: list, b: list) -> set[int]:
    """The places in a of a longest common subsequence of a and b, in memory linear in both.

    Shared starts and ends and what only one side has are set aside first. Then a is halved, b is cut where both halves
    have most in common (Hirschberg's algorithm), and so on down to single lines.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    only = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    left = [k for k in range(head, len(a) - tail) if a[k] in only]
    todo = [(left, [x for x in b[head : len(b) - tail] if x in only])]
    while todo:
        places, other = todo.pop()
        if not places or not other:
            continue
        if len(places) == 1:
            found.update(places if a[places[0]] in other else ())
            continue
        k = len(places) // 2
        first, second = places[:k], places[k:]
        j = int(np.argmax(_row([a[p] for p in first], other) + _row([a[p] for p in reversed(second)], other[::-1])[::-1]))
        todo += [(first, other[:j]), (second, other[j:])]
    return found


def main_text(page: list[tuple[int, object, str]], other: list[tuple[int, object, str]] | None) -> list[str]:
    """The texts of page's lines without those shared with other, which is the page nearest to it, if there is one."""
    gone = shared([key for _, key, _ in page], [key for _, key, _ in other]) if other else set()
    marked = any(part == ARTICLE for part, _, _ in page)
    return [text for k, (part, _, text) in enumerate(page) if part == ARTICLE or (part == PLAIN and not marked and k not in gone)]


def _texts(page: list[tuple[int, object, str]]) -> list[str]:
    return [text for part, _, text in page if part != HIDDEN]


def _chunked(rows: DataFrame) -> DataFrame:
    """rows (page_id, host, path, ...) with chunk and guest: hosts of many pages are split by (path, page_id).

    A page at a chunk's edge also appears in the chunk beyond, as a guest. Only URLs and ids are read to find where to
    cut: the cuts come from a sample and decide nothing but the chunks' sizes. There are about CHUNKS chunks in split hosts
    at most, so the broadcast tables have as many cuts and twice as many edges.
    """
    light = rows.select("host", F.struct("path", "page_id").alias("at"))
    total = rows.sparkSession.createDataFrame([], "n long") if rows.isEmpty() else light.agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(CHUNK_PAGES), F.ceil(F.col("total") / CHUNKS))
    large = light.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total.withColumnRenamed("n", "total"))).where((F.col("n") > 2 * size) & (F.col("host") != ""))
    large = large.select("host", F.ceil(F.col("n") / size).alias("chunks"), F.greatest(F.lit(1), F.floor(size / 16)).alias("step"))
    sample = light.join(F.broadcast(large), "host").where(F.pmod(F.xxhash64("at"), F.col("step")) == 0)
    ordered = F.array_sort(F.collect_set("at"))
    picked = sample.groupBy("host", "chunks").agg(ordered.alias("s"))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.col("chunks") - 1, F.lit(1))), lambda k: F.get("s", F.floor(k * F.size("s") / F.col("chunks")).cast("int")))
    cuts = written(picked.select("host", F.array_distinct(F.filter(cuts, F.isnotnull)).alias("cuts")), "cuts")

    def chunk(df: DataFrame, at: Column) -> DataFrame:
        return df.join(F.broadcast(cuts), "host", "left").withColumn("chunk", F.coalesce(F.size(F.filter("cuts", lambda c: c <= at)), F.lit(0))).drop("cuts")

    split = chunk(light.join(F.broadcast(cuts.select("host")), "host", "left_semi"), F.col("at"))
    ends = split.groupBy("host", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("host").orderBy("chunk")
    ends = ends.select("host", "chunk", F.when(F.lag("chunk").over(w).isNotNull(), F.struct(F.col("first").alias("at"), F.lag("chunk").over(w).alias("to"))).alias("back"), F.when(F.lead("chunk").over(w).isNotNull(), F.struct(F.col("last").alias("at"), F.lead("chunk").over(w).alias("to"))).alias("forth"))
    ends = ends.select("host", F.explode(F.array_compact(F.array("back", "forth"))).alias("e")).select("host", "e.at.path", "e.at.page_id", "e.to")
    guests = written(ends, "edges")
    placed = chunk(rows, F.struct("path", "page_id"))
    edge = (rows["host"] == guests["host"]) & rows["path"].eqNullSafe(guests["path"]) & rows["page_id"].eqNullSafe(guests["page_id"])
    copies = rows.join(F.broadcast(guests), edge).select(*(rows[c] for c in rows.columns), F.col("to").alias("chunk"), F.lit(True).alias("guest"))
    return placed.select(*rows.columns, "chunk", F.lit(False).alias("guest")).unionByName(copies)


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (lines joined by an empty line), and n_chars, its code points.

    Character references are decoded, white space inside a block is one space. A null, empty or text-free page has an
    empty text. A page's neighbours are the pages before and after it in the order of host, path, page_id and html; the one
    that shares more of the path's start is its partner (the earlier one of equal ones). A neighbour with the same texts is
    a copy and no partner, so repeated rows keep their text. Pages without a host, and a host's only page, have no partner
    and lose only what their marks say. How rows are dealt out changes nothing.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    schema = schema_with(rows.select("page_id", "url"), "text string, n_chars long")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []  # the last two pages: id, url, where (host and chunk), path, guest, lines
        done: list[tuple] = []
        kinds: list[pa.DataType] = []

        def judge(before: tuple | None, page: tuple, after: tuple | None) -> None:
            if not page[4]:
                text = "\n\n".join(main_text(page[5], _partner(before, page, after)))
                done.append((page[0], page[1], text, len(text)))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64()]
            for k in range(batch.num_rows):
                i, u, host, chunk, path, guest, source = (c[k].as_py() for c in batch.columns)
                window.append((i, u, (host, chunk) if host else None, path, guest, page_lines(source)))
                if len(window) > 1:
                    judge(window[-3] if len(window) > 2 else None, window[-2], window[-1])
                    window = window[-2:]
                if len(done) >= OUT_ROWS:
                    yield flush()
        if window:
            judge(window[-2] if len(window) > 1 else None, window[-1], None)
        if done:
            yield flush()

    located = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    order = ["host", "chunk", "path", "page_id", F.xxhash64("html"), "html"]
    dealt = _chunked(located).select("page_id", "url", "host", "chunk", "path", "guest", "html")
    # pages without a host have no neighbours: their ids spread them
    spread = F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id", "url"), F.lit(CHUNKS))).otherwise(F.col("chunk"))
    # chunks are few beside partitions, and of unequal bytes: twice the usual number of partitions evens them out
    parts = 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bounded_batches(dealt).repartition(parts, "host", spread).sortWithinPartitions(*order).mapInArrow(paired, schema)


def _partner(before: tuple | None, page: tuple, after: tuple | None) -> list[tuple[int, object, str]] | None:
    """The lines of the nearer neighbour of the page's host that isn't a copy of it."""

    def near(other: tuple | None) -> int:
        if other is None or other[2] != page[2] or page[2] is None or _texts(other[5]) == _texts(page[5]):
            return -1
        n = 0
        while n < min(len(other[3]), len(page[3])) and other[3][n] == page[3][n]:
            n += 1
        return n

    first, second = near(before), near(after)
    if max(first, second) < 0:
        return None
    return (before if first >= second else after)[5]
