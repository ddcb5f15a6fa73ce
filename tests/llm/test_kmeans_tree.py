import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import kmeans_tree as kt
from tests.llm.conftest import SF

RESULT = ["query_id", "rank", "id", "score"]


def exact(ids, x, k, queries):
    out = {}
    for q in queries:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def as_dict(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["id"], r["score"]))
    return out


def test_tree_walk_reaches_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(3000, 8))
    tree = kt.fit_tree(x, 5, 40)
    leaves = list(tree.walk(x[0]))
    assert sorted(leaves) == list(range(tree.leaves)) and tree.leaves > 50
    assert set(tree.place(x)) == set(leaves)
    same = kt.fit_tree(np.ones((500, 3)), 4, 10)
    assert same.leaves == 1 and list(same.walk(np.ones(3))) == [0]


def test_recall_against_brute_force(spark):
    sf = SF.replace("0.001", "0.1")
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = as_dict(kt.search(table, F.col("id") % 20 == 0))
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    want = exact(ids, x, 20, sorted(got))
    assert set(got) == {i for i in ids if i % 20 == 0}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in got]) >= 0.9
    truth = {i: v for i, v in zip(ids, x)}
    for q, found in got.items():
        assert np.allclose([s for _, s in found], [truth[q] @ truth[i] for i, _ in found], rtol=0, atol=1e-12)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))


def test_fewer_visits_are_calibrated_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 0.3 for c in centers])
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows, d = kt.usable_vectors(table, "vec_id", "embedding")
    tree = kt.fit_tree(x, 8, 50)
    indexed = rows.select(F.col("row").alias("id"), "vector").toPandas()
    indexed["leaf"] = tree.place(np.stack(indexed["vector"]))
    frame = spark.createDataFrame([(int(i), [float(z) for z in v], int(n)) for i, v, n in indexed.itertuples(index=False)],
                                  "id bigint, vector array<double>, leaf int")
    queries = frame.where("id % 40 = 0").collect()
    visits = kt.calibrated_visits(tree, frame, queries, d, 10, 0.97)
    assert visits <= tree.leaves / 4
    got = as_dict(kt.search(table, F.col("id") % 10 == 0, 10))
    want = exact(np.arange(len(x)), x, 10, sorted(got))
    assert np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in got]) >= 0.9


def test_equal_vectors_in_many_blocks_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(kt, "BLOCK_ROWS", 64)
    monkeypatch.setattr(kt, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 6)).astype(np.float32).astype(np.float64)
    x[3] *= 8
    x[rng.choice(600, 350, replace=False)] = x[3]
    ids = rng.permutation(600)
    table = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = as_dict(kt.search(table, F.col("id") % 3 == 0, 20, recall=1.0))
    want = exact(ids, x, 20, sorted(got))
    wrong = [q for q in want if [i for i, _ in got[q]] != [i for i, _ in want[q]]]
    assert len(got) == 200 and len(wrong) <= 4  # the calibration queries alone are sure to be complete
    hot = int(ids[np.flatnonzero((x == x[3]).all(axis=1))[0]])
    alike = sorted(int(i) for i in ids[(x == x[3]).all(axis=1)])
    q = next(i for i in alike if i % 3 == 0)
    assert [i for i, _ in got[q]] == [i for i in alike if i != q][:20] and hot in alike


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [0.5, 0.5], "x"), (20, [0.4, 0.5], "x"), (20, [0.5, 0.5], None), (3, None, "x"), (4, [0.0, 0.0], "x"),
            (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [None, 1.0], "x"), (8, [1.0], "x"), (9, [2.0, 1.0], "x"), (None, [1.0, 1.0], "x"), (10, [], "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    got = {}
    for r in sorted(tuple(r) for r in kt.search(table, F.col("id") % 20 == 0, 20).select("query_id", "rank", "id").collect()):
        got.setdefault(r[0], []).append(r[1:])
    # Three rows have id 20, two of them the vector (0.5, 0.5); each asks, and each is found by the others.
    first, second = [(1, 9), (2, 20), (3, 20), (4, 0)], [(1, 9), (2, 0), (3, 20), (4, 20)]
    assert got == {0: [(1, 9), (2, 20), (3, 20), (4, 20)], 20: sorted(first + second + second)}
    empty = kt.search(table.where("false"), F.col("id") % 20 == 0)
    assert empty.columns == RESULT and empty.count() == 0
    assert kt.search(table, F.col("id") % 20 == 11).count() == 0
    assert kt.search(table.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_every_query_gets_k_rows_where_leaves_are_small(spark):
    rng = np.random.default_rng(8)
    groups = np.repeat(rng.normal(size=(30, 12)), 60, axis=0)
    x = np.concatenate([groups + rng.normal(size=groups.shape) * 1e-3, rng.normal(size=(12, 12)) * 60])
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    wanted = (F.col("id") % 7 == 0) | (F.col("id") >= len(groups))
    got = as_dict(kt.search(table, wanted, 20, recall=0.5, leaf_vectors=8))
    assert set(got) == {i for i in range(len(x)) if i % 7 == 0 or i >= len(groups)}
    assert {len(found) for found in got.values()} == {20}
    few = as_dict(kt.search(table.where(F.col("vec_id") >= len(groups)), F.col("id") % 2 == 0, 20, recall=0.1, leaf_vectors=1))
    assert {len(found) for found in few.values()} == {11} and len(few) == 6


def test_rows_that_repeat_an_id_ask_and_are_found(spark):
    """Every row against every other, by brute force over row places."""
    rng = np.random.default_rng(4)
    ids = np.repeat(np.arange(60), 3)
    x = rng.normal(size=(180, 5)).round(1)
    x[1::9] = x[0::9]  # some whole rows repeat
    table = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>")
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score.round(12))) if i != q][:7]
        want += [(int(ids[q]), n, round(float(score[i]), 9)) for n, i in enumerate(order, 1)]
    got = kt.search(table, F.col("id") % 20 == 0, 7, recall=1.0, leaf_vectors=500)
    assert sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got.collect()) == sorted(want)


def clustered(n, per_cluster=250, d=16, seed=11):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // per_cluster, d)) * 4
    x = np.repeat(centers, per_cluster, axis=0) + rng.normal(size=(n // per_cluster * per_cluster, d)) * 0.3
    return x[rng.permutation(len(x))]


def index_of(spark, x, **limits):
    table = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(x)), "vec_id bigint, embedding array<double>")
    named, d = kt.usable_vectors(table, "vec_id", "embedding")
    rows = named.select(F.col("row").alias("id"), "vector", F.col("id").alias("name"), (F.col("id") % 20 == 0).alias("asks"))
    return kt.grow_index(rows, len(x), d, **limits)


def test_leaves_and_rows_scanned_do_not_grow_with_the_table(spark):
    """The same sample for four times the rows: leaves stay bounded, recall holds, a query reads about as many rows."""
    limits = {"sample": 500, "leaf_rows": 200}
    scanned = []
    for n in (5_000, 20_000):
        x = clustered(n)
        index = index_of(spark, x, **limits)
        assert index.in_leaf.max() <= 200 and index.in_leaf.sum() == n and index.rows.count() == n
        assert sorted(index.tree.walk(x[0], 0.5)) == list(range(index.tree.leaves))
        kt.calibrate(index, 10)
        queries = range(0, n, n // 100)
        scanned.append(np.mean([sum(index.in_leaf[leaf] for leaf in index.leaves_for(x[q], 10)) for q in queries]))
        assert scanned[-1] <= n / 4
    assert scanned[1] <= 2 * scanned[0]
    table = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(x)), "vec_id bigint, embedding array<double>")
    got = as_dict(kt.search(table, F.col("id") % 100 == 0, 10, **limits))
    want = exact(np.arange(len(x)), x, 10, sorted(got))
    assert len(got) == 200 and np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in got]) >= 0.9


def test_leaves_that_cannot_be_split_or_do_not_fit_stay_whole(spark):
    x = clustered(2_000)
    x[:900] = x[0]
    index = index_of(spark, x, sample=300, leaf_rows=100)
    assert index.in_leaf.sum() == 2_000 and index.in_leaf.max() >= 900 and np.sort(index.in_leaf)[-2] <= 100
    small = index_of(spark, clustered(4_000), sample=300, leaf_rows=50, tree_bytes=8 * 16 * 20)
    assert len(small.tree.centers) <= 40 and small.in_leaf.sum() == 4_000
    table = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(x)), "vec_id bigint, embedding array<double>")
    got = as_dict(kt.search(table, F.col("id") % 50 == 0, 5, sample=300, leaf_rows=100, recall=1.0))
    want = exact(np.arange(len(x)), x, 5, sorted(got))
    assert sum([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in got) >= 0.9 * len(got)


def test_grafted_tree_numbers_its_leaves_once():
    x = clustered(3_000)
    tree = kt.fit_tree(x, 5, 400)
    node = int(np.flatnonzero(tree.leaf >= 0)[1])
    inside = x[tree.place(x) == tree.leaf[node]]
    both = tree.grafted({node: kt.fit_tree(inside, 3, 20)})
    assert both.leaves == tree.leaves - 1 + kt.fit_tree(inside, 3, 20).leaves
    assert sorted(both.walk(x[5], 1.0)) == list(range(both.leaves)) == sorted(np.unique(both.place(x)).tolist())
