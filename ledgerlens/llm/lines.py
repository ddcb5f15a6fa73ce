"""Dropping lines that repeat across the pages of a site, in DataFrame functions only.

A line is boilerplate on a host if the pages that hold it are more than `ratio` of the host's pages.
So that the ratio of a host with few pages is no accident, `prior_pages` pages without the line are
added to every total: with 0.05 and 40, three pages of nine are enough, two are not, and on a host of
500 pages it takes 28. There is no other limit. Every page counts a line once, however often it repeats
there. White space lines are never counted and never dropped; other lines are compared exactly, by a
64-bit hash within their host. All lines of a page that are boilerplate go, the rest stays in order.

Null texts stay null and still count as pages. Pages of the null host belong to no site and stay as
they are. Repeated rows are separate pages. An empty table stays empty.

A page of L distinct lines adds L to the counts of its host, so a host has fewer than (average L) /
ratio boilerplate lines: they fit into one array per host. Counting aggregates before the shuffle, so
neither a frequent line nor a large host meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import as_row, field, unpack
from ledgerlens.session import materialise

RATIO, PRIOR_PAGES = 0.05, 40
NOT_BLANK = r"[^\x20\x09-\x0D]"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.when(line.rlike(NOT_BLANK), F.xxhash64(line))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """(site, keys): the hashes of the boilerplate lines of each host that has some."""
    pages = docs.select(host.alias("site"), text.alias("text")).where("site is not null")
    held = pages.select("site", F.explode(F.array_distinct(F.transform(lines(F.col("text")), line_key))).alias("key"))
    counts = held.where("key is not null").groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    frequent = counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * (F.col("pages") + prior_pages))
    return materialise(frequent.groupBy("site").agg(F.sort_array(F.collect_list("key")).alias("keys")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """All rows and columns of `docs` with the text cut, n_lines and n_dropped (such columns are replaced)."""
    site = field(host).cast("string")
    found = boilerplate(docs, site, field(text), ratio, prior_pages).select(F.col("site").alias("of"), "keys")
    joined = docs.select(as_row(docs), site.alias("site"), lines(field(text)).alias("lines")) \
        .join(found, F.col("site") == F.col("of"), "left")
    # The page's own share of its host's keys first, by hashing: few keys are left for each line to be compared with.
    own = joined.withColumn("own", F.when(F.col("keys").isNotNull(), F.array_intersect(F.transform("lines", line_key), "keys")))
    dropped = lambda line: F.coalesce(F.array_contains("own", line_key(line)), F.lit(False))
    kept = F.when(F.coalesce(F.size("own"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda line: ~dropped(line)))
    with_kept = own.withColumn("kept", kept)
    return unpack(with_kept, docs.columns, {
        text: F.array_join("kept", "\n"),
        "n_lines": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")),
        "n_dropped": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")),
    })
