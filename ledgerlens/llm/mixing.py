"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources in code point order, the null source last, weigh 5, 2, 1, repeating. Together they are to
give `share` times all words; a source never gives more than `most` times its own, and what it
cannot give is reshared by weight. Every document of a source is expected `target / size` times.
Documents of a source stand in a row by size, the expected copies are added up along the row, one
random offset per source is added, and a document is taken once for each whole number its stretch
of the sum crosses. As neighbours in the row are about equally long, the words taken differ from
the target by no more than the longest document of the source.

Null and empty texts have size 0; they take places in the row and no words. The null source is a
source of its own. Repeated rows are separate rows. A source without words has target 0 and is not
taken. An empty table stays empty. The row order is that of an even range partitioning of the whole
table, so a source with most of the rows is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import as_row, field, unpack
from ledgerlens.operators.ordered import POSITION, with_position
from ledgerlens.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(name: Column, seed: str) -> Column:
    """Value in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed + ":"), name), "UTF-8")), 1, 8), 16, 10).cast("double") \
        / float(1 << 32)


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds weight and target to one row per source (`source`, `source_size`, `first`).

    Each round is one aggregate over the sources: those whose share by weight exceeds what they can
    give are capped, and the rest is shared anew, until no more are capped.
    """
    placed = with_position(sources, ["first"], unique=True)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = materialise(placed.withColumn(
        "weight", F.element_at(cycle, (F.col(POSITION) % len(weights) + 1).cast("int"))).drop(POSITION))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("source_size")
        n, given, open_weight = placed.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (share * total - most * given) / open_weight, n
    return placed.withColumn("target", F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")))


def copies_at(place: Column, rate: Column, offset: Column, most: float) -> Column:
    """Integers that `place * rate + offset` passes on the way to the next place, `ceil(most)` at most.

    Whole part and rest are added up apart: far along a large source, a sum of both would round up.
    """
    def passed(at: Column) -> Column:
        whole = F.floor(at * rate)
        return whole + F.floor(at * rate - whole + offset)

    place = place.cast("double")
    return F.least(passed(place + 1) - passed(place), F.lit(math.ceil(most))).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: str = SEED, size: Column | None = None) -> DataFrame:
    """All rows and columns of `docs` with size, source_size, target and copies (such columns are replaced).

    `size` is the number of words of `text` unless given. The columns of `docs` travel through the sort,
    so those that are not needed afterwards are best left out. `most` bounds the copies of a document:
    none is taken more than `ceil(most)` times.
    """
    rows = docs.select(
        as_row(docs), (words(field("text")) if size is None else size).alias("size"), field("source").cast("string").alias("source"),
        field("source").isNull().alias("no_source"), field("doc_id").cast("string").alias("id"))
    rows = rows.withColumn("tie", F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce("id", F.lit(""))), "UTF-8"))).drop("id")
    placed = with_position(rows, ["no_source", "source", "size", "tie"])
    sources = materialise(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(POSITION).alias("first")))
    targets = source_targets(sources, weights, share, most).select(
        F.col("source").alias("of"), "source_size", "first", "target")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = seeded(F.coalesce("source", F.lit("")), seed)
    copies = copies_at(F.col(POSITION) - F.col("first"), rate, offset, most)
    return unpack(joined, docs.columns, {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies})


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as often as it is taken."""
    names = [field(c) for c in columns]
    return (
        mixed.where(F.col("copies") > 0)
        .select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copies"))
        .select(*names)
    )
