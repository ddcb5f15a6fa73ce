"""Row order over a whole table, without ever sorting one large group in one task.

A window partitioned by a business key puts every row of that key into one task, and a window
with no key puts the whole table there. The helpers here give each row its place in a total
order and cut the order into equal blocks, so that a frame of a few neighbouring rows can be
evaluated in tasks of equal size whatever the key distribution is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.session import materialise

POSITION = "_position"
BLOCK = "_block"
OWN = "_own"
BLOCK_ROWS = 100_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def with_position(df: DataFrame, order_cols: Sequence[str], unique: bool = False) -> DataFrame:
    """Add `_position`: 0, 1, 2, … in the order of `order_cols` over the whole table.

    The table is range partitioned, so the sort is spread evenly. `unique` promises that no two
    rows agree on `order_cols`; without it an arrival number, fixed by a first write, splits any
    number of equal rows over several partitions. Positions are written out before their offsets
    are counted, because a second range partitioning would cut at other places.
    """
    order = list(order_cols)
    if not unique:
        df = materialise(df.withColumn("_arrival", F.monotonically_increasing_id()))
        order.append("_arrival")
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    # One row per partition of the write above.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    row_in_part = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(POSITION, F.col("_offset") + row_in_part)
        .drop("_part", "_offset", "_at", "_arrival")
    )


def in_blocks(positioned: DataFrame, before: int, after: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut the order into blocks of `rows` rows and lend each block the rows its frames reach.

    A row is copied into every block holding a row at most `before` places after it or `after`
    places ahead of it. `_own` marks the one copy that belongs to the block.
    """
    p = F.col(POSITION)
    first = F.greatest(F.floor((p - after) / rows), F.lit(0))
    last = F.floor((p + before) / rows)
    return (
        positioned.withColumn(BLOCK, F.explode(F.sequence(first, last)))
        .withColumn(OWN, F.col(BLOCK) == F.floor(p / rows))
    )


def block_window():
    return Window.partitionBy(BLOCK).orderBy(POSITION)


def own_rows(blocked: DataFrame, keep_position: bool = False) -> DataFrame:
    """Drop the borrowed rows and the helper columns."""
    helpers = [BLOCK, OWN] + ([] if keep_position else [POSITION])
    return blocked.where(OWN).drop(*helpers)


def neighbour(c: Column, offset: int, same: Sequence[str] = ()) -> Column:
    """Value of `c` at `offset` rows (−1 before, 1 after) when that row agrees on `same`."""
    w = block_window()

    def shift(x: Column) -> Column:
        return F.lead(x, offset).over(w) if offset > 0 else F.lag(x, -offset).over(w)

    if not same:
        return shift(c)
    here = F.struct(*[F.col(k) for k in same])
    return F.when(shift(here) == here, shift(c))
