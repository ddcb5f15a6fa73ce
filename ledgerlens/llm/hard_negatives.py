"""Hard negatives for contrastive training, scored by Strassen's multiplication on integer tiles.

Vectors become integers, floor(256 x). Anchors and candidates are cut into tiles of bounded size, and
every pair of an anchor tile and a candidate tile is one piece of work on the cluster: its integer inner
products are one product of two int64 matrices. `strassen` forms it from seven products of half size
instead of eight, recursively, padding odd sides with zeros; sums and differences of integers are exact,
so no score is rounded. The product is formed in strips, and each strip gives bounded heaps, one per anchor (its
positives) or one per anchor and window (its negatives). Heaps of strips are merged in the task, heaps
of tiles by Spark, which keeps the first few per heap before and after its shuffle.

Positives need only tiles of one label, so the first pass deals rows by label and a frequent label over
as many tiles as it fills. Negatives meet all tiles.

Higher scores come first, ties go to the smaller id (a null id last), then to the smaller label and
vector. Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors
of unlike length are compared as if the shorter one ended in zeros; an empty vector scores 0. Rows whose
integers have a squared length of 2^55 or more take no part either, because their scores do not fit a
long (components near 100,000). Rows that repeat an id or a whole row are rows of their own. An anchor
without other rows of its label, or a positive with no row in its window, gives no rows; a positive of
negative score has an empty window. An empty table gives no rows. Columns besides the three named ones
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import field
from ledgerlens.session import materialise

SCALE = 256
ANCHOR_TILE, CANDIDATE_TILE = 4096, 4096
STRIP = 512          # a strip of anchors times a strip of candidates is multiplied at a time
STRASSEN_BASE = 32   # sides at or below are multiplied directly
MAX_SQUARE = 1 << 55
EMPTY = -(1 << 62)   # below every score
HEAP = "anchor long, slot int, score long, row long, id long"


def strassen(a: np.ndarray, b: np.ndarray, base: int = STRASSEN_BASE) -> np.ndarray:
    """The product of two int64 matrices of any shape that fit together."""
    m, d = a.shape
    n = b.shape[1]
    if min(m, d, n) <= base:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, d % 2)))
    b = np.pad(b, ((0, d % 2), (0, n % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, base)
    p2 = strassen(a21 + a22, b11, base)
    p3 = strassen(a11, b12 - b22, base)
    p4 = strassen(a22, b21 - b11, base)
    p5 = strassen(a11 + a12, b22, base)
    p6 = strassen(a21 - a11, b11 + b12, base)
    p7 = strassen(a12 - a22, b21 + b22, base)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer rows."""
    d = min(anchors.shape[1], candidates.shape[1])  # what only one side has meets zeros
    return strassen(np.ascontiguousarray(anchors[:, :d]), np.ascontiguousarray(candidates[:, :d].T))


Heap = tuple[np.ndarray, np.ndarray]  # per line the scores of its entries, best first, and their row numbers


def heap_of(score: np.ndarray, fits: np.ndarray, rows: np.ndarray, size: int) -> Heap:
    """The first `size` fitting columns of each line; `rows` ascend, so of equal scores the leftmost comes first."""
    left = np.where(fits, score, EMPTY)
    lines = np.arange(len(score))
    best = np.full((len(score), size), EMPTY)
    found = np.full((len(score), size), -1, np.int64)
    for n in range(min(size, score.shape[1])):
        first = left.argmax(axis=1)
        best[:, n] = left[lines, first]
        found[:, n] = np.where(best[:, n] == EMPTY, -1, rows[first])
        left[lines, first] = EMPTY
    return best, found


def merge_heaps(one: Heap, other: Heap) -> Heap:
    """The heap of everything that was offered to either; both have the same lines and size."""
    best, found = (np.concatenate(pair, axis=1) for pair in zip(one, other))
    first = np.lexsort((found, -best), axis=1)[:, :one[0].shape[1]]
    return np.take_along_axis(best, first, 1), np.take_along_axis(found, first, 1)


def quantised(table: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, label, vector) of the rows that take part; `row` tells repeated rows apart.

    `row` counts in the order of id, label and vector, so that it breaks ties the same way on any
    partitioning.
    """
    x = field(vector_col)
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < 2.0 ** 27))
    square = F.aggregate("vector", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    rows = (
        table.where(x.isNotNull() & finite)
        .select(field(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"))
        .where(F.col("label").isNotNull() & (square < float(MAX_SQUARE)))
    )
    # The arrival number spreads any number of equal rows; their order changes no result.
    order = [F.asc_nulls_last("id"), F.asc("label"), F.asc("vector"), F.asc("arrival")]
    rows = rows.withColumn("arrival", F.monotonically_increasing_id())
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("row", F.monotonically_increasing_id()).drop("arrival"))


def _cells(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_tiles: Column, row_tiles: Column):
    """Both sides once for every tile of the other side, ready to be grouped together."""
    anchors = anchors.toDF(*anchors.columns)  # columns of their own, as both sides come from one table
    left = anchors.select("*", F.pmod(F.xxhash64(F.lit("a"), "row"), anchor_tiles).cast("int").alias("anchor_tile"),
                          F.explode(F.sequence(F.lit(0), (row_tiles - 1).cast("int"))).alias("row_tile"))
    right = rows.select("*", F.pmod(F.xxhash64(F.lit("r"), "row"), row_tiles).cast("int").alias("row_tile"),
                        F.explode(F.sequence(F.lit(0), (anchor_tiles - 1).cast("int"))).alias("anchor_tile"))
    cell = [*keys, "anchor_tile", "row_tile"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell))


def _heaps(here: pa.Table, there: pa.Table, slots: int, size: int, fits) -> pa.Table:
    """Heaps of all anchors and slots of one tile pair; `fits(slot, anchors, candidates, scores)` says who may enter.

    Candidates come in the order of their row numbers, which follow id, label and vector.
    """
    parts = []
    if here.num_rows and there.num_rows:
        there = there.take(np.argsort(there["row"].to_numpy(), kind="stable"))
        rows, left, right = there["row"].to_numpy(), _matrix(here["vector"]), _matrix(there["vector"])
        for at in range(0, len(left), STRIP):
            mine = here.slice(at, STRIP)
            heaps: list[Heap | None] = [None] * slots
            for to in range(0, len(right), STRIP):
                theirs = there.slice(to, STRIP)
                score = scores(left[at:at + STRIP], right[to:to + STRIP])
                for slot in range(slots):
                    new = heap_of(score, fits(slot, mine, theirs, score), rows[to:to + STRIP], size)
                    heaps[slot] = new if heaps[slot] is None else merge_heaps(heaps[slot], new)
            for slot, (best, found) in enumerate(heaps):
                line, n = np.nonzero(found >= 0)
                row = found[line, n]
                parts.append(pa.table({
                    "anchor": mine["row"].to_numpy()[line], "slot": np.full(len(line), slot, np.int32),
                    "score": best[line, n], "row": row, "id": there["id"].take(np.searchsorted(rows, row))}))
    empty = pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in ("anchor", "slot", "score", "row", "id")})
    return pa.concat_tables([empty, *parts])


def _merged(found: DataFrame, size: int) -> DataFrame:
    """The first `size` of every heap over all tiles."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def positives(anchors: DataFrame, rows: DataFrame, count: int, anchor_tile: int = ANCHOR_TILE,
              row_tile: int = CANDIDATE_TILE) -> DataFrame:
    """(anchor, slot, score, row, id, rank): the first `count` other rows of the anchor's label."""
    tiles = lambda df, size, name: df.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("long").alias(name))
    sizes = tiles(anchors, anchor_tile, "anchor_tiles").join(tiles(rows, row_tile, "row_tiles"), "label")
    a, r = anchors.join(sizes, "label"), rows.join(sizes, "label")

    def nearest(here: pa.Table, there: pa.Table) -> pa.Table:
        return _heaps(here, there, 1, count, lambda slot, mine, theirs, score:
                      mine["row"].to_numpy()[:, None] != theirs["row"].to_numpy()[None, :])

    cells = _cells(a, r, ["label"], F.col("anchor_tiles"), F.col("row_tiles"))
    return _merged(cells.applyInArrow(nearest, HEAP), count)


def negatives(anchors: DataFrame, rows: DataFrame, low: int, high: int, slots: int, count: int, totals: tuple[int, int],
              anchor_tile: int = ANCHOR_TILE, row_tile: int = CANDIDATE_TILE) -> DataFrame:
    """(anchor, slot, score, row, id, rank) for anchors with `windows`, an array of positive scores.

    A row of another label is in the window of positive score p if low p <= 100 score <= high p.
    """
    def hardest(here: pa.Table, there: pa.Table) -> pa.Table:
        def in_window(slot: int, mine: pa.Table, theirs: pa.Table, score: np.ndarray) -> np.ndarray:
            # No window holds anything for a positive score of -1, which stands for a missing one.
            p = np.array([w[slot] if slot < len(w) else -1 for w in mine["windows"].to_pylist()])[:, None]
            other = mine["label"].to_numpy()[:, None] != theirs["label"].to_numpy()[None, :]
            return other & (low * p <= 100 * score) & (100 * score <= high * p)

        return _heaps(here, there, slots, count, in_window)

    tiles = [F.lit(max(1, -(-n // size))).cast("long") for n, size in zip(totals, (anchor_tile, row_tile))]
    return _merged(_cells(anchors, rows, [], *tiles).applyInArrow(hardest, HEAP), count)


def mine(table: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         anchor_tile: int = ANCHOR_TILE, row_tile: int = CANDIDATE_TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition over `id`, `label` an expression over the table's columns.
    """
    rows = quantised(table, label, id_col, vector_col)
    anchors = rows.where(is_anchor)
    totals = (anchors.count(), rows.count())
    found = materialise(positives(anchors, rows, n_positives, anchor_tile, row_tile))
    windows = found.groupBy("anchor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda w: w["score"]).alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor", "row"), "row")
    hard = negatives(asked, rows, low, high, n_positives, n_negatives, totals, anchor_tile, row_tile)
    pairs = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    return (
        pairs.join(hard.select("anchor", "slot", "rank", F.col("id").alias("negative_id"),
                               F.col("score").alias("negative_score")), ["anchor", "slot"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
