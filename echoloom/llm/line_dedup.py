"""Line dedup by site-relative frequency.

For each host, a line's share is the number of the host's pages that hold it divided by the
host's pages. Lines whose share exceeds the boilerplate ratio are dropped from the host's pages.
Counting shuffles one (host, line hash) row per distinct line of a page and combines on the map
side, so a host with a third of all pages is spread by its lines. A line can be boilerplate only
if it is on a fixed share of the pages, so a host has at most (lines per page / ratio) such lines.
The few boilerplate lines go to the pages as one list per host, by a broadcast whose size is
checked, else by a join on the host whose large partitions adaptive execution splits.

With `steps` the ratio falls with the number of words of a line. Lines of a step without a ratio are
boilerplate from `min_pages` pages on; a host may have any number of them, so they go to the
pages that hold them as one list per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import frozen, let, spare

RATIO = 0.05
MIN_PAGES = 3
#: (least words, ratio) of lines. On sf0.1 (500 pages a host) 146 pairs of host and line under ten words lie above, 50 under fifty, 21 of fifty or more.
STEPS = ((0, 0.02), (10, 0.01), (50, 0.0))
BROADCAST_LINES = 100_000
#: Lines of a text that are compared with its bad lines at once.
CHUNK = 1024


def lines_of(text: Column) -> Column:
    """Lines between newlines; a NULL text has none."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Trimmed lines are compared by one hash of 64 bits of the line and its length."""
    plain = F.trim(line)
    return F.xxhash64(plain, F.length(plain))


def _words(line: Column) -> Column:
    return F.size(F.split(F.trim(line), r"\s+"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, steps: tuple[tuple[int, float], ...] = ()) -> DataFrame:
    """(host, h, pages, share, limit) of lines on more than `limit` of their host's pages.

    limit is `ratio`, or that of the last of `steps` whose words the line has. Every page counts a line
    once; blank lines never count; a NULL host is a host of its own; a line must be on `min_pages`
    pages at least. NULL texts count as pages without lines.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    limits = [float(lower) for _, lower in sorted(steps)]

    def step(line: Column) -> Column:
        """How many of the steps begin at or below the line's words."""
        return sum((F.when(_words(line) >= least, 1).otherwise(0) for least, _ in sorted(steps)), F.lit(0))

    filled = F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.struct(line_key(x).alias("h"), step(x).alias("step")))

    def keys(marked: Column) -> Column:
        """Distinct keys, step by step: sets of plain numbers are hashed, sets of structs are not."""
        def mine(k: int, limit: float) -> Column:
            held = F.array_distinct(F.transform(F.filter(marked, lambda m: m["step"] == k) if steps else marked, lambda m: m["h"]))
            return F.transform(held, lambda h: F.struct(h.alias("h"), F.lit(limit).alias("limit")))

        return F.concat(*[mine(k, limit) for k, limit in enumerate([float(ratio), *limits])])

    seen = rows.select("host", F.explode(let(filled, keys)).alias("l")).groupBy("host", F.col("l.h").alias("h"), F.col("l.limit").alias("limit"))
    often = seen.agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    joined = often.join(totals.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    out = joined.withColumn("share", F.col("pages") / F.col("total")).where(F.col("share") > F.col("limit"))
    return out.select("host", "h", "pages", "share", "limit")


def _page_lists(pages: DataFrame, host: str, text: str, found: DataFrame, least: int) -> DataFrame:
    """(host, page, lines): for each text of a host, by its key, the lines of `found` it holds."""
    long_ones = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: _words(x) >= least), line_key))
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).select("host", line_key(F.col("text")).alias("page"), long_ones.alias("lines"))
    held = rows.select("host", "page", F.explode("lines").alias("line"))
    bad = found.select(F.col("host").alias("__host"), F.col("h").alias("__line"))
    met = held.join(bad, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line")))
    return met.groupBy("host", "page").agg(F.collect_set("line").alias("lines"))


def _without(lines: Column, bad: Column) -> Column:
    """The lines whose key is not in `bad`, CHUNK at a time: a chunk looks through its own bad lines only."""
    def chunk(part: Column, own: Column) -> Column:
        return let(F.array_intersect(F.transform(part, line_key), own), lambda mine: F.filter(part, lambda x: ~F.array_contains(mine, line_key(x))))

    def cut(own: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CHUNK).cast("int"))
        whole = F.flatten(F.transform(parts, lambda i: chunk(F.slice(lines, i * CHUNK + 1, CHUNK), own)))
        return F.when(F.size(own) == 0, lines).otherwise(whole)

    return let(F.array_intersect(F.transform(lines, line_key), bad), cut)


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES, dropped: str | None = None, steps: tuple[tuple[int, float], ...] = (),
) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`; rows, order of lines and other columns stay.

    A page that had nothing but boilerplate keeps its row with an empty text; a NULL text stays
    NULL; repeated rows are pages of their own. With `dropped`, a column of that name counts the
    lines taken out, in place of one that `pages` may have. For `steps` see `boilerplate`.
    """
    rows_in = pages.count()
    found = frozen(boilerplate(pages, host, text, ratio, min_pages, steps), rows_in)
    bad, key, number = spare(pages, "bad_lines"), spare(pages, "bad_host"), dropped or spare(pages, "dropped_lines")
    shared = found.where(F.col("limit") > 0) if steps else found
    lists = shared.groupBy("host").agg(F.collect_set("h").alias(bad)).withColumnRenamed("host", key)
    if shared.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    joined = pages.join(lists, F.col(host).eqNullSafe(F.col(key)), "left")
    free = [least for least, lower in steps if lower <= 0]
    if free:
        more, own, page = spare(pages, "page_lines"), spare(pages, "page_host"), spare(pages, "page_key")
        held = frozen(_page_lists(pages, host, text, found.where(F.col("limit") <= 0), min(free)), rows_in)
        lists = held.select(F.col("host").alias(own), F.col("page").alias(page), F.col("lines").alias(more))
        if (held.agg(F.sum(F.size("lines"))).first()[0] or 0) <= broadcast_lines:
            lists = F.broadcast(lists)
        joined = joined.join(lists, F.col(host).eqNullSafe(F.col(own)) & (line_key(F.col(text)) == F.col(page)), "left").drop(own, page)
        both = F.concat(*(F.coalesce(F.col(c), F.array().cast(joined.schema[more].dataType)) for c in (bad, more)))
        joined = joined.withColumn(bad, F.when(F.col(bad).isNotNull() | F.col(more).isNotNull(), both)).drop(more)
    kept = let(lines_of(F.col(text)), lambda lines: _without(lines, F.col(bad)))
    changed = F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(bad).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col(text))) - F.size(kept))
    out = joined.withColumn(number, count.cast("long")) if dropped else joined
    return out.withColumn(text, changed).drop(bad, key)
