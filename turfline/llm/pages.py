"""Main text of web pages by differencing each page with its nearest page.

Pages are paired by URL path within their host. A page becomes lines, one for each
block element. Lines outside an article element are aligned with the paired page's
by longest common subsequence, and shared lines are deleted. Elements that are never
main text (menus, forms, adverts, ...) are left out by tag, class or id; lines of an
article element are not differenced, since a copied article would go with them. All other lines
that the paired page lacks stay; tags decide about them only where there is no page to pair with.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.store import global_rank, map_arrow, stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_APART = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head nav footer aside form button menu dialog".split())
#: Words of a class, id or role that mark what is no main text.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies footer masthead "
    "menu modal nav navbar navigation newsletter notice popup promo related share sidebar social sponsored subscribe".split())


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(level, text) of each line: 2 in an article, 1 in main, 0 elsewhere. References are decoded
    and white space is one space; what is never main text is left out."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    open_tags: list[tuple[str, bool, int]] = []  # name, hidden, level
    hidden, level = False, 0

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append((level, line))

    def close(at: int) -> None:
        nonlocal hidden, level
        del open_tags[at:]
        hidden, level = open_tags[-1][1:] if open_tags else (False, 0)

    def text(raw: str) -> None:
        if raw and not hidden:
            parts.append(entities.unescape(raw) if "&" in raw else raw)

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if name in BLOCKS:
                flush()
            found = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
            if found is not None:
                close(found)
            continue
        if name in BLOCKS:
            flush()
            open_p = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == "p"), None)
            if open_p is not None:
                close(open_p)
            if name == "li" and open_tags and open_tags[-1][0] == "li":
                close(len(open_tags) - 1)
        elif name == "br":
            text(" ")
        if name in VOID:
            continue
        marks = {w for g in _NAMED.findall(m[4] or m[7] or "") for w in _APART.split("".join(g).lower())} & MARKS if name not in ("html", "body") else ()
        article = name in ("article", "main") and not marks and not any(t in NEVER or t == "section" and h for t, h, _ in open_tags)
        drop = bool(marks) or name in NEVER or name == "header" and level == 0
        level = max(level, {"article": 2, "main": 1}.get(name, 0) if not drop else 0)
        hidden = drop or hidden and not article
        open_tags.append((name, hidden, level))
    text(page[at:])
    flush()
    return out


def unshared(own: list[str], other: list[str]) -> list[bool]:
    """False for the lines of ``own`` on a longest common subsequence with ``other``.

    A row of the table is a bit set over ``other``. One row in every run of about the square root of the
    lines is kept, and the rows of a run are made again when the way back passes it."""
    ids: dict[str, int] = {}
    for i, line in enumerate(other):
        ids[line] = ids.get(line, 0) | 1 << i
    full = (1 << len(other)) - 1

    def after(row: int, line: str) -> int:
        if line not in ids:
            return row
        hit = row & ids[line]
        return ((row + hit) | (row - hit)) & full

    run = isqrt(len(own)) + 1
    starts, row = [], full
    for i, line in enumerate(own):
        if i % run == 0:
            starts.append(row)
        row = after(row, line)
    left, j = [True] * len(own), len(other)
    for k in range(len(starts) - 1, -1, -1):
        rows = [starts[k]]
        for line in own[k * run:(k + 1) * run]:
            rows.append(after(rows[-1], line))
        for i in range(len(rows) - 2, -1, -1):
            below, mask = rows[i], (1 << j) - 1
            length = j - (rows[i + 1] & mask).bit_count()
            if length > j - (below & mask).bit_count():  # the line adds one to the common length
                left[k * run + i] = False
                hits = ids[own[k * run + i]] & mask
                while True:
                    at = hits.bit_length() - 1
                    if at - (below & ((1 << at) - 1)).bit_count() == length - 1:
                        break
                    hits ^= 1 << at
                j = at
    return left


def unlike(lines: list[str], own: list[bool], other: list[str] | None) -> list[str]:
    """The lines of the article and, of those outside it, the ones that the other page lacks; without
    another page the lines of the article, or all if there is none."""
    if other is None:
        return [t for t, mine in zip(lines, own) if mine] if any(own) else lines
    kept = iter(unshared([t for t, mine in zip(lines, own) if not mine], other))
    return [t for t, mine in zip(lines, own) if mine or next(kept)]


#: Rows of a run of ranks that one task goes through.
RANKS = 1024


def _other_ranks(ranked: DataFrame) -> DataFrame:
    """_rank, _last, _next: the nearest ranks before and after whose host or hash differs.

    Each block of ranks is windowed by itself; only one row per block is windowed without a key.
    """
    before = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col("_host").alias("_bh"), F.col("_hash").alias("_bx"), F.lit(True).alias("_is"))
    new = F.col("_is").isNull() | ~F.col("_host").eqNullSafe(F.col("_bh")) | ~F.col("_hash").eqNullSafe(F.col("_bx"))
    marked = ranked.join(before, "_rank", "left").select("_rank", F.expr(f"_rank div {RANKS}L").alias("_block"), F.when(new, F.col("_rank")).alias("_new"))
    marked = stored(marked, "marked")
    order = Window.orderBy("_block")
    blocks = marked.groupBy("_block").agg(F.min("_new").alias("_l"), F.max("_new").alias("_h")).select(
        "_block", F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_h"),
        F.min("_l").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_l"))
    inside = Window.partitionBy("_block").orderBy("_rank")
    out = marked.withColumns({
        "_at": F.max("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_to": F.min("_new").over(inside.rowsBetween(1, Window.unboundedFollowing))}).join(F.broadcast(blocks), "_block")
    return out.select("_rank", (F.coalesce("_at", "_h") - 1).alias("_last"), F.coalesce("_to", "_l").alias("_next"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; blocks are joined by an empty line.

    A null or empty html gives an empty text. Every page is differenced with its nearest page: of its visible
    lines outside the article element (outside main, if it has no article), those on the common subsequence go
    and the others stay, in page order with the article's. A page whose host has no other page, and one with a
    null url, is not differenced; of the article, main, or else all lines are its text. The nearest page is the
    neighbour in path order with the longer common path, the next one if both are as near; ties in
    path go by page_id, then by a hash of the lines. Neighbours with equal lines are passed over, so
    copies do not delete each other. All visible lines of the nearest page count, also those outside
    its article. An empty frame gives an empty frame.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_, texts, own = [], [], []
            for page in batch.column(2).to_pylist():
                got = page_lines(page)
                best = max((n for n, _ in got), default=0)
                texts.append([t for _, t in got])
                own.append([n == best > 0 for n, _ in got])
                open_.append(not all(own[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(open_, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(own, pa.list_(pa.bool_()))],
                names=["page_id", "url", "open", "lines", "own"])

    parsed = map_arrow(rows, lines, "page_id long, url string, open boolean, lines array<string>, own array<boolean>")
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    parsed = parsed.withColumns({"_host": host, "_path": path, "_hash": F.xxhash64("lines"), "_page": F.monotonically_increasing_id()})
    parsed = stored(parsed, "lines", compression="zstd")  # the lines are written once, and ranked without them
    order = [F.col("url").isNull(), F.coalesce("_host", F.lit("")), F.coalesce("_path", F.lit("")), F.col("page_id"), F.col("_hash")]
    ranked = global_rank(parsed.select("_page", "page_id", "url", "open", "_host", "_path", "_hash"), order)
    # only what is differenced looks for a neighbour, and only its lines and its neighbour's are passed on
    differenced = F.expr("open and url is not null")
    loose = ranked.where(differenced)
    spots = ranked.where("url is not null").select("_rank", "_host", "_path")
    near = _other_ranks(ranked.select("_rank", "_host", "_hash"))

    def beside(rank: str, name: str) -> DataFrame:
        return spots.select(F.col("_rank").alias(rank), F.col("_host").alias(f"_h{name}"), F.col("_path").alias(f"_p{name}"))

    common = lambda a, b: F.size(F.filter(  # noqa: E731  parts of the path that both begin with
        F.sequence(F.lit(1), F.size(F.split(a, "/"))), lambda i: F.slice(F.split(a, "/"), F.lit(1), i) == F.slice(F.split(b, "/"), F.lit(1), i)))
    found = loose.select("_rank", "_host", "_path").join(near, "_rank")
    found = found.join(beside("_next", "n"), "_next", "left").join(beside("_last", "b"), "_last", "left")
    after = F.when(F.col("_hn") == F.col("_host"), common(F.col("_path"), F.col("_pn")))
    before = F.when(F.col("_hb") == F.col("_host"), common(F.col("_path"), F.col("_pb")))
    other = F.when(after.isNull() & before.isNull(), F.lit(None)).when(
        F.coalesce(after, F.lit(-1)) >= F.coalesce(before, F.lit(-1)), F.col("_next")).otherwise(F.col("_last"))
    pairs = found.select(F.col("_rank"), other.cast("long").alias("_other")).where("_other is not null")
    pages_of = ranked.select("_rank", "_page")
    pairs = pairs.join(pages_of, "_rank").join(pages_of.select(F.col("_rank").alias("_other"), F.col("_page").alias("_beside")), "_other")
    pairs = stored(pairs.select("_page", "_beside"), "pairs")
    best = F.when(F.exists("own", lambda x: x), F.filter("lines", lambda t, i: F.get("own", i))).otherwise(F.col("lines")).alias("lines")  # of an article, of main, or all
    whole = parsed.where(~F.coalesce(differenced, F.lit(False))).select("page_id", "url", best)
    alone = parsed.where(differenced)
    cut = alone.select("page_id", "url", best)
    if not pairs.isEmpty():
        mine = alone.join(pairs, "_page", "left").select("page_id", "url", "lines", "own", "_beside")
        partners = parsed.join(pairs.select(F.col("_beside").alias("_page")).distinct(), "_page", "left_semi")
        paired = mine.join(partners.select(F.col("_page").alias("_beside"), F.col("lines").alias("_lines")), "_beside", "left")

        def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [unlike(*page) for page in zip(*[c.to_pylist() for c in batch.columns[2:]])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.list_(pa.string()))], names=["page_id", "url", "lines"])

        cut = map_arrow(paired.select("page_id", "url", "lines", "own", "_lines"), difference, "page_id long, url string, lines array<string>")
    out = whole.unionByName(cut).withColumn("text", F.array_join("lines", "\n\n"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
