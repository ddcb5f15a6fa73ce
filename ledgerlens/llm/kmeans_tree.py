"""Approximate nearest neighbours by largest inner product, with a hierarchical k-means tree.

The top of the tree is fitted in the driver on a bounded sample: every node splits its vectors by k-means
into `branching` children until a leaf holds `leaf_vectors` of the sample. All rows are then put into the
leaf that they reach by going to the nearest child. Leaves that more than `leaf_rows` rows reach are split
on in tasks of their own, each by a bounded sample of its rows, until no leaf is larger; so leaves do not
grow with the table. Two things end that early: a leaf whose sample has too few different vectors, and a
tree of `tree_bytes`, which is what every task holds. Leaves that stay large are searched whole, in blocks.

A query walks the tree best bin first: a priority queue holds the open nodes, and the one with the largest
inner product of query and centre, plus a multiple of the node's radius, comes next. Leaves are visited in
that order. How many, and which multiple, is calibrated: for some queries the exact neighbours are found by
going through all rows, and visits are widened until the wanted recall is reached on them; the multiple that
needs the fewest is kept. With all leaves visited the search is exact. A query whose leaves hold too few rows
walks on until they hold as many as asked for besides its own.

Queries and rows meet leaf by leaf. A leaf with many rows or many queries is cut into blocks, and each
pair of blocks is one bounded piece of work that keeps the best few per query.

Null, zero and non-finite vectors, vectors of another length than most, and rows without an id take no
part. Rows that repeat an id, or a whole row, are rows of their own: each is a candidate for the others,
and each is a query if its id is one, so such a query id has several lists. Inside, a row is known by a
number that follows id and vector. Scores are inner products in double precision; ties go to the smaller
id, then to the smaller vector. With fewer candidates than asked for, all are returned. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import field, unit_hash
from ledgerlens.session import materialise

SAMPLE = 20_000
BRANCHING, LEAF_VECTORS = 8, 64
LEAF_ROWS, SPLIT_SAMPLE = 1024, 4096
TREE_BYTES = 64 << 20  # 131,072 nodes of 64 numbers
SLACKS = (0.0, 0.5, 1.0)
CALIBRATION_QUERIES, RECALL = 100, 0.97
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Tree:
    """Node 0 is the root. `children[n]` are node numbers, empty for a leaf; `leaf[n]` its number or -1.

    `radii[n]` is the root mean square distance of the vectors a node was fitted on from its centre.
    """

    centers: np.ndarray
    radii: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row of `x`."""
        at = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            open_rows = open_rows[self.leaf[at[open_rows]] < 0]
            for node in np.unique(at[open_rows]):
                rows = open_rows[at[open_rows] == node]
                at[rows] = self.children[node][_nearest(x[rows], self.centers[self.children[node]])]
        return self.leaf[at]

    def walk(self, query: np.ndarray, slack: float = 0.0) -> Iterator[int]:
        """Leaf numbers, best bin first."""
        reach = slack * float(np.sqrt(query @ query))
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            children = self.children[node]
            worth = self.centers[children] @ query + reach * self.radii[children]
            for w, child in zip(worth.tolist(), children.tolist()):
                heapq.heappush(queue, (-w, child))

    def grafted(self, subtrees: dict[int, "Tree"]) -> "Tree":
        """This tree with the leaves at the given nodes replaced; leaves are numbered anew, nodes keep theirs."""
        centers, radii, children = [self.centers], [self.radii], list(self.children)
        for node, sub in sorted(subtrees.items()):
            shift = len(children) - 1  # the root of `sub` is the node itself
            children[node] = sub.children[0] + shift
            children += [c + shift for c in sub.children[1:]]
            centers.append(sub.centers[1:])
            radii.append(sub.radii[1:])
        ends = np.array([len(c) == 0 for c in children])
        return Tree(np.concatenate(centers), np.concatenate(radii), children, np.where(ends, np.cumsum(ends) - 1, -1))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1) - 2 * (x @ centers.T)).argmin(axis=1)


def _radius(x: np.ndarray) -> float:
    return float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster number of each row; empty clusters are left out of the numbering."""
    centers = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = _nearest(x, centers)
        held = np.unique(own)
        centers = np.stack([x[own == c].mean(axis=0) for c in held])
    return np.unique(_nearest(x, centers), return_inverse=True)[1]


def fit_tree(sample: np.ndarray, branching: int = BRANCHING, leaf_vectors: int = LEAF_VECTORS, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    centers, radii, children, leaf = [x.mean(axis=0)], [_radius(x)], [np.zeros(0, np.int64)], [-1]
    waiting, leaves = [(0, np.arange(len(x)))], 0
    while waiting:
        node, rows = waiting.pop()
        own = np.zeros(len(rows), np.int64)
        if len(rows) > leaf_vectors:
            own = _kmeans(x[rows], min(branching, -(-len(rows) // leaf_vectors)), rng)
        if own.max() == 0:
            leaf[node] = leaves
            leaves += 1
            continue
        numbers = np.arange(own.max() + 1) + len(centers)
        children[node] = numbers
        for c, number in enumerate(numbers):
            part = rows[own == c]
            centers.append(x[part].mean(axis=0))
            radii.append(_radius(x[part]))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            waiting.append((int(number), part))
    return Tree(np.stack(centers), np.array(radii), children, np.array(leaf))


def best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best rows of one block for each query: (query_ids, ids, scores), the query's own row left out.

    Of equal vectors only the k + 1 smallest ids can be among them. The product decides who is near,
    with a margin for its rounding; the scores are then added up row by row, so equal vectors score alike.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.ravel()
    sorted_by_kind = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[sorted_by_kind], kind[sorted_by_kind])
    keep = np.sort(sorted_by_kind[np.arange(len(kind)) - first <= k])
    ids, vectors = ids[keep], vectors[keep]
    product = queries @ vectors.T
    product[query_ids[:, None] == ids[None, :]] = -np.inf
    found = ([], [], [])
    n = min(k, len(ids))
    floor = np.partition(product, len(ids) - n, axis=1)[:, len(ids) - n]
    margin = 1e-9 * (np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0.0) + 1e-300)
    for i in range(len(queries)):
        near = np.flatnonzero((product[i] >= floor[i] - margin[i]) & np.isfinite(product[i]))
        score = np.einsum("ij,j->i", vectors[near], queries[i])
        top = np.lexsort((ids[near], -score))[:k]
        found[0].append(np.full(len(top), query_ids[i]))
        found[1].append(ids[near[top]])
        found[2].append(score[top])
    return tuple(np.concatenate(f) if f else np.zeros(0) for f in found)


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(row, id, vector) of the rows that take part, and the length of the vectors; `row` follows id and vector."""
    v = F.col("vector")
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    limit = F.lit(float("inf")).cast(kind)
    rows = table.select(field(id_col).cast("long").alias("id"), field(vector_col).alias("vector")).where("id is not null")
    sound = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(v, lambda x: x != 0))
    common = sound.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 0
    # The arrival number spreads any number of equal rows; their order changes no result.
    order = ["id", "vector", "arrival"]
    placed = sound.where(F.size(v) == d).withColumn("arrival", F.monotonically_increasing_id())
    return materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("row"), "id", "vector")), d


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "query_id long, id long, score double"


def _exact(indexed: DataFrame, queries: list, d: int, k: int) -> DataFrame:
    """The k nearest of a bounded list of queries among all rows, with the leaf each lies in."""
    shared = indexed.sparkSession.sparkContext.broadcast(
        (np.array([q["id"] for q in queries], np.int64), np.array([q["vector"] for q in queries], np.float64)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch["id"].to_numpy(zero_copy_only=False), batch["leaf"].to_numpy(zero_copy_only=False)
                q, i, s = best(ids, _matrix(pa.chunked_array([batch["vector"]]), d), query_ids, vectors, k)
                leaves = leaf[np.argsort(ids)][np.searchsorted(np.sort(ids), i)]
                yield pa.RecordBatch.from_pydict({"query_id": q.astype(np.int64), "id": i.astype(np.int64), "score": s,
                                                  "leaf": leaves.astype(np.int32)})

    return _ranked(indexed.mapInArrow(scored, RESULT + ", leaf int"), k)


def _truth(indexed: DataFrame, queries: list, d: int, k: int) -> dict[int, list[int]]:
    """Leaves of the exact neighbours of each calibration query."""
    truth: dict[int, list[int]] = {}
    for r in _exact(indexed, queries, d, k).collect():  # k rows for each calibration query
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    return truth


def _visits(tree: Tree, queries: list, truth: dict[int, list[int]], recall: float, slack: float) -> int:
    turns: list[int] = []
    for q in queries:
        leaves = truth.get(q["id"], [])
        missing, turn = set(leaves), {}
        for n, leaf in enumerate(tree.walk(np.array(q["vector"], np.float64), slack), 1):
            if not missing:
                break
            if leaf in missing:
                turn[leaf] = n
                missing.remove(leaf)
        turns += [turn[leaf] for leaf in leaves]
    if not turns:
        return tree.leaves
    return int(np.sort(turns)[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)])


def calibrated_visits(tree: Tree, indexed: DataFrame, queries: list, d: int, k: int, recall: float) -> int:
    """Fewest leaves that hold the wanted share of the exact neighbours of the calibration queries."""
    return _visits(tree, queries, _truth(indexed, queries, d, k), recall, 0.0)


def _place_rows(rows: DataFrame, tree: Tree, d: int) -> DataFrame:
    """`rows` with the `leaf` each reaches, written out."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by TREE_BYTES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(_matrix(pa.chunked_array([batch["vector"]]), d))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialise(rows.mapInArrow(placed, f"{schema}, leaf int"))


def _subtrees(indexed: DataFrame, rates: dict[int, float], d: int, branching: int, leaf_vectors: int) -> dict[int, Tree]:
    """A tree for each of the given leaves, fitted in a task of its own on the given share of its rows."""
    spark = indexed.sparkSession
    # One row per large leaf, of which there are no more than nodes of the tree.
    asked = F.broadcast(spark.createDataFrame([(int(n), float(r)) for n, r in rates.items()], "leaf int, rate double"))
    drawn = indexed.join(asked, "leaf").where(unit_hash(F.lit("split"), F.col("id")) < F.col("rate")).select("leaf", "id", "vector")

    def fit(group: pa.Table) -> pa.Table:
        number = group["leaf"][0].as_py()
        sub = fit_tree(_matrix(group["vector"], d), branching, leaf_vectors, number)
        parent = np.full(len(sub.centers), -1)
        for n, children in enumerate(sub.children):
            parent[children] = n
        return pa.table({
            "leaf": pa.array(np.full(len(parent), number), pa.int32()), "node": pa.array(np.arange(len(parent)), pa.int32()),
            "parent": pa.array(parent, pa.int32()), "radius": sub.radii,
            "center": pa.array(list(sub.centers), pa.list_(pa.float64()))})

    found = drawn.groupBy("leaf").applyInArrow(fit, "leaf int, node int, parent int, radius double, center array<double>").toArrow()
    trees = {}
    leaf, node, parent = (found[c].to_numpy() for c in ("leaf", "node", "parent"))
    for number in np.unique(leaf):
        at = np.flatnonzero(leaf == number)
        at = at[np.argsort(node[at])]
        children = [np.flatnonzero(parent[at] == n) for n in range(len(at))]
        part = found.take(at)
        trees[int(number)] = Tree(_matrix(part["center"], d), part["radius"].to_numpy(), children, np.zeros(len(at), np.int64))
    return trees


@dataclass
class Index:
    """Every row (id, vector, name, asks) in its leaf, and how a query is to walk."""

    tree: Tree
    rows: DataFrame
    in_leaf: np.ndarray
    d: int
    slack: float = 0.0
    visits: int = 0

    def leaves_for(self, query: np.ndarray, k: int) -> list[int]:
        """The leaves a query visits: as many as calibrated, and more while they hold too few rows."""
        leaves, held = [], 0
        for leaf in self.tree.walk(query, self.slack):
            leaves.append(leaf)
            held += self.in_leaf[leaf]
            if len(leaves) >= self.visits and held > k:
                break
        return leaves


def grow_index(
    rows: DataFrame, total: int, d: int, sample: int = SAMPLE, branching: int = BRANCHING, leaf_vectors: int = LEAF_VECTORS,
    leaf_rows: int = LEAF_ROWS, tree_bytes: int = TREE_BYTES,
) -> Index:
    """The tree over (id, vector, name, …), split until no leaf that can be split holds more than `leaf_rows` rows."""
    spread = unit_hash(F.lit("tree"), F.col("name"))
    fitted_on = rows.where(spread < min(1.0, 1.1 * sample / total)).limit(sample).select("vector").toArrow()
    if not fitted_on.num_rows:
        fitted_on = rows.limit(sample).select("vector").toArrow()
    tree = fit_tree(_matrix(fitted_on["vector"], d), branching, leaf_vectors)
    most_nodes = tree_bytes // (8 * d)
    whole: set[int] = set()  # nodes that cannot be split
    while True:
        indexed = _place_rows(rows, tree, d)
        # One count per leaf; the number of leaves is bounded by the size of the tree.
        in_leaf = np.zeros(tree.leaves, np.int64)
        for r in indexed.groupBy("leaf").count().collect():
            in_leaf[r["leaf"]] = r["count"]
        node_of = np.flatnonzero(tree.leaf >= 0)[np.argsort(tree.leaf[tree.leaf >= 0])]
        large = [int(n) for n in np.argsort(-in_leaf, kind="stable") if in_leaf[n] > leaf_rows and int(node_of[n]) not in whole]
        room = most_nodes - len(tree.centers)
        # Half of `leaf_rows` is aimed at, with `leaf_vectors` of the sample for each part.
        wanted = {n: min(SPLIT_SAMPLE, int(-(-2 * in_leaf[n] // leaf_rows)) * leaf_vectors) for n in large}
        large = [n for n, nodes in zip(large, np.cumsum([2 * wanted[n] // leaf_vectors for n in large])) if nodes <= room]
        if not large:
            return Index(tree, indexed, in_leaf, d)
        subtrees = _subtrees(indexed, {n: wanted[n] / in_leaf[n] for n in large}, d, branching, leaf_vectors)
        split = {int(node_of[n]): sub for n, sub in subtrees.items() if len(sub.children[0])}
        whole |= {int(node_of[n]) for n in large} - split.keys()
        tree = tree.grafted(split) if split else tree


def calibrate(index: Index, k: int, recall: float = RECALL, calibration_queries: int = CALIBRATION_QUERIES) -> Index:
    """Sets how a query walks from a bounded number of the rows that ask."""
    chosen = index.rows.where("asks").orderBy(F.xxhash64(F.lit("calibration"), "name"), "id").limit(calibration_queries).collect()
    truth = _truth(index.rows, chosen, index.d, k)
    found = [(_visits(index.tree, chosen, truth, recall, slack), slack) for slack in SLACKS]
    index.visits, index.slack = min(found)
    return index


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           sample: int = SAMPLE, recall: float = RECALL, branching: int = BRANCHING, leaf_vectors: int = LEAF_VECTORS,
           calibration_queries: int = CALIBRATION_QUERIES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which `is_query` (over `id`) holds."""
    spark = table.sparkSession
    named, d = usable_vectors(table, id_col, vector_col)
    total = named.count()
    if not named.where(is_query).head(1):
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    # From here on a row's number stands for its id.
    rows = named.select(F.col("row").alias("id"), "vector", F.col("id").alias("name"), is_query.alias("asks"))
    index = calibrate(grow_index(rows, total, d, sample, branching, leaf_vectors, leaf_rows), k, recall, calibration_queries)
    best_rows = _ranked(visit(index, k), k).withColumnsRenamed({"query_id": "asked", "id": "found"})
    names = named.select("row", "id")
    return (
        best_rows.join(names.select(F.col("row").alias("asked"), F.col("id").alias("query_id")), "asked")
        .join(names.select(F.col("row").alias("found"), "id"), "found").select("query_id", "rank", "id", "score"))


def visit(index: Index, k: int) -> DataFrame:
    """(query_id, id, score) of the best rows of each block that a query meets; ids are row numbers."""
    indexed, d, spark = index.rows, index.d, index.rows.sparkSession
    shared = spark.sparkContext.broadcast(Index(index.tree, None, index.in_leaf, d, index.slack, index.visits))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [shared.value.leaves_for(q, k) for q in _matrix(pa.chunked_array([batch["vector"]]), d)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": batch["id"], "vector": batch["vector"], "leaves": pa.array(found, pa.list_(pa.int32()))})

    kind = indexed.schema["vector"].dataType.simpleString()
    queries = indexed.where("asks").select("id", "vector")
    walks = materialise(queries.mapInArrow(visited, f"query_id long, vector {kind}, leaves array<int>"))
    visitors = {r["leaf"]: r["count"] for r in walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    # One row per leaf that is visited.
    blocks = F.broadcast(spark.createDataFrame(
        [(n, max(1, -(-int(index.in_leaf[n]) // BLOCK_ROWS)), max(1, -(-asked // BLOCK_QUERIES))) for n, asked in visitors.items()],
        "leaf int, row_blocks int, query_blocks int"))
    cell = ["leaf", "row_block", "query_block"]
    left = indexed.select("id", "vector", "leaf").join(blocks, "leaf") \
        .withColumn("row_block", F.pmod(F.xxhash64("id"), "row_blocks").cast("int")) \
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).drop("row_blocks", "query_blocks")
    right = walks.select("query_id", "vector", F.explode("leaves").alias("leaf")).join(blocks, "leaf") \
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int")) \
        .withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).drop("row_blocks", "query_blocks")

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, i, s = best(here["id"].to_numpy(), _matrix(here["vector"], d), there["query_id"].to_numpy(),
                       _matrix(there["vector"], d), k)
        return pa.table({"query_id": q.astype(np.int64), "id": i.astype(np.int64), "score": s})

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, RESULT)
