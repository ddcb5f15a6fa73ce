"""Connected components of a link table, by alternating large and small stars.

Each step is a grouped minimum and a join, so no task holds a component and no vertex collects its
neighbours. Every step's links are written below the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, turned into links to the smallest vertex that a vertex is linked with."""
    if large:  # for each vertex: its larger neighbours are linked to its smallest neighbour, itself included
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # for each vertex: itself and its smaller neighbours are linked to the smallest of them
        least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        around = links.join(least, F.col("a") == F.col("u"))
        moved = around.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex with a link; the label is the smallest vertex of its component.

    `links` has columns a and b of one orderable type; nulls, loops and repeats are ignored.
    """
    now = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        count = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(count) == mark:
            break
        mark = tuple(count)
        now = materialise(_star(_star(now, large=True), large=False))
    # All links are now from a vertex to its label.
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("label")) \
        .unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct())
