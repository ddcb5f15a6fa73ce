import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as hn
from tests.llm.conftest import SF

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, n_positives=5, n_negatives=3, low=50, high=95):
    """Plain Python integers, every anchor against every row."""
    def usable(r):
        return r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])

    held = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in filter(usable, rows)]
    out = []
    for a, (anchor, label, v) in enumerate(held):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, lab, w, i)
                  for n, (i, lab, w) in enumerate(held) if n != a]
        scored.sort(key=lambda s: s[:5])
        for p in [s for s in scored if s[3] == label][:n_positives]:
            window = [s for s in scored if s[3] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(anchor, p[5], r, s[5], -p[0], -s[0]) for r, s in enumerate(window[:n_negatives], 1)]
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("m,d,n", [(1, 1, 1), (33, 64, 70), (100, 65, 129), (7, 200, 40), (64, 0, 64), (64, 64, 64)])
def test_strassen_is_exact(m, d, n):
    rng = np.random.default_rng(m + n)
    a, b = rng.integers(-1 << 24, 1 << 24, (m, d)), rng.integers(-1 << 24, 1 << 24, (d, n))
    for base in (4, 32):
        assert (hn.strassen(a, b, base) == (a.astype(object) @ b.astype(object) if d else np.zeros((m, n)))).all()


def test_merged_heaps_are_the_heap_of_all():
    rng = np.random.default_rng(2)
    score, fits, rows = rng.integers(-3, 4, (40, 30)), rng.random((40, 30)) < 0.3, np.arange(100, 130)
    whole = hn.heap_of(score, fits, rows, 4)
    parts = hn.merge_heaps(hn.heap_of(score[:, 20:], fits[:, 20:], rows[20:], 4),
                           hn.merge_heaps(hn.heap_of(score[:, :2], fits[:, :2], rows[:2], 4),
                                          hn.heap_of(score[:, 2:20], fits[:, 2:20], rows[2:20], 4)))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    for line in range(40):
        want = sorted((-score[line, c], rows[c]) for c in np.flatnonzero(fits[line]))[:4]
        assert [r for r in whole[1][line] if r >= 0] == [r for _, r in want]


def test_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "label", "embedding").collect()]
    want = brute(rows, 50)
    assert len(want) > 50
    assert got(hn.mine(table, F.col("id") % 50 == 0, F.col("label"))) == want
    # Small tiles: labels and anchors over many tiles, heaps merged across them.
    assert got(hn.mine(table, F.col("id") % 50 == 0, F.col("label"), anchor_tile=3, row_tile=17)) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(60)]
    rows = [(i, i % 3, v) for i, v in enumerate(vectors)]
    rows += [(0, 0, vectors[3]), (0, 1, vectors[4]), (5, 2, vectors[5]), (5, 2, vectors[5]),   # repeated ids and rows
             (None, 1, vectors[7]), (None, None, vectors[8]), (61, None, vectors[9]), (62, 1, None), (63, 1, []),
             (64, 1, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (65, 1, [float("nan")] * 6), (66, 2, [float("inf")] * 6),
             (67, 2, [0.5, 0.5]), (68, 0, vectors[0] + [3.0, 4.0]), (-70, 1, [0.0] * 6), (-71, 0, vectors[0])]
    schema = "vec_id bigint, label int, embedding array<double>, row string, score string, `a.b` string, windows int, id int"
    table = spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], schema)
    want = brute(rows, 5)
    assert {r[0] for r in want} >= {0, 5} and None in {r[1] for r in want} | {r[3] for r in want}
    assert got(hn.mine(table, F.col("id") % 5 == 0, F.col("label"))) == want
    assert got(hn.mine(table.repartition(7), F.col("id") % 5 == 0, F.col("label"), anchor_tile=4, row_tile=5)) == want
    assert got(hn.mine(table.where("false"), F.col("id") % 5 == 0, F.col("label"))) == []
    huge = spark.createDataFrame([(0, 1, [1e30] * 6), (1, 1, [1.0] * 6)], "vec_id bigint, label int, embedding array<double>")
    assert got(hn.mine(huge, F.col("id") % 5 == 0, F.col("label"))) == []
