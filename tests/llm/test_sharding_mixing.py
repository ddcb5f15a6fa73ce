from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from ledgerlens.llm import mixing, queries, sharding
from tests.llm.conftest import ODD_ROWS, SF, documents, oracle_rows, same_columns


def placed(frame):
    return frame.toPandas().sort_values(["shard", "slot"]).reset_index(drop=True)


@pytest.mark.parametrize("shards, bucket_bytes", [(7, 1 << 14), (40, 1 << 22), (3, 64)])
def test_every_row_has_one_place(docs, shards, bucket_bytes):
    got = placed(sharding.shuffle_into_shards(docs, shards, bucket_bytes=bucket_bytes))
    assert sorted(got.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    assert counts["count"].max() - counts["count"].min() <= 1 and len(counts) == shards


def test_the_order_is_repeatable_and_does_not_depend_on_the_partitions(docs):
    one = placed(sharding.shuffle_into_shards(docs, 5, bucket_bytes=1 << 16))
    two = placed(sharding.shuffle_into_shards(docs.repartition(13), 5, bucket_bytes=1 << 16))
    other = placed(sharding.shuffle_into_shards(docs, 5, seed=99, bucket_bytes=1 << 16))
    assert list(one.doc_id) == list(two.doc_id) != list(other.doc_id)


def test_the_order_is_that_of_a_plain_two_pass_shuffle(spark, docs):
    """Pass one and two by plain lists; only the hash of a row is taken from the engine."""
    key = F.xxhash64(F.lit(sharding.SEED), "doc_id", "text")
    rows = [(r["doc_id"], r["key"], 16 + len((r["text"] or "").encode())) for r in docs.withColumn("key", key).collect()]
    n_buckets = -(-sum(size for *_, size in rows) // (1 << 16))
    buckets = [[] for _ in range(n_buckets)]
    for doc_id, k, _ in rows:
        buckets[((k % (1 << 64)) >> 20) % n_buckets].append((k, doc_id))
    order = []
    for number, bucket in enumerate(buckets):
        bucket.sort()
        order += [bucket[i][1] for i in np.random.default_rng([sharding.SEED, number]).permutation(len(bucket))]
    got = placed(sharding.shuffle_into_shards(docs, 7, bucket_bytes=1 << 16))
    assert n_buckets > 3 and list(got.doc_id) == order
    assert list(got.shard) == [i * 7 // len(order) for i in range(len(order))]


def test_the_order_looks_uniform(spark):
    rows = documents(spark, [(i, f"text {i}", "en", "a", 1) for i in range(4000)])
    order = placed(sharding.shuffle_into_shards(rows, 4, bucket_bytes=2000)).doc_id.to_numpy()
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.06
    assert all(abs(order[i * 1000:(i + 1) * 1000].mean() - 2000) < 150 for i in range(4))


def test_a_row_repeated_very_often_is_spread(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = placed(sharding.shuffle_into_shards(rows, 6, bucket_bytes=3000))
    share = got.groupby("shard").doc_id.apply(lambda x: (x == 7).mean())
    assert len(got) == 6000 and share.between(0.42, 0.58).all()


def test_copies_lie_alike_however_the_rows_are_split(spark, monkeypatch):
    """Copies that differ in a third column, copies that do not, and runs of copies in several tasks."""
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") < 1200, "a").otherwise(F.col("id").cast("string")).alias("source"))
    split = [placed(sharding.shuffle_into_shards(rows.repartition(n), 6, bucket_bytes=3000)) for n in (1, 5, 9)]
    assert split[0].equals(split[1]) and split[0].equals(split[2])
    assert sorted(split[0].source) == sorted(r["source"] for r in rows.collect())
    share = split[0].groupby("shard").doc_id.apply(lambda x: (x == 7).mean())
    assert share.between(0.55, 0.78).all()


def test_shards_of_odd_rows(odd, none, tmp_path):
    got = sharding.shuffle_into_shards(odd, 4)
    assert same_columns(odd, got, ["shard", "slot"])
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r[1]) for r in ODD_ROWS)
    sharding.write_shards(got, str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD_ROWS)
    assert sharding.shuffle_into_shards(none, 4).count() == 0
    sizes = [r[0] for r in odd.select(sharding.record_size(odd["text"])).collect()]
    assert sizes == [16 + len((r[1] or "").encode()) for r in ODD_ROWS]


def test_the_mix_matches_the_sql(spark):
    got = queries.QUERIES["op9_source_mixing"](spark, SF).toPandas()
    assert compare(got, oracle_rows(queries.ORACLES["op9_source_mixing"])) == ""


def test_the_mix_matches_the_sql_where_sources_are_capped(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", s, 1)
            for i, s in enumerate(rng.choice(["a", "b", "c", "dé", "e"], 400, p=[.02, .5, .3, .1, .08]))]
    rows += [(500 + i, "x y z", "en", None, 1) for i in range(30)] + [(600, None, "en", "zero", 0), (601, "", "en", "zero", 0)]
    docs = documents(spark, rows)
    mixed = mixing.mix_sources(docs)
    got = mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")).toPandas()
    assert compare(got, oracle_rows(queries.ORACLES["op9_source_mixing"], documents=docs.toPandas())) == ""
    per_source = mixed.toPandas().groupby("source", dropna=False)
    for _, rows_of in per_source:
        taken = (rows_of["size"] * rows_of.copies).sum()
        assert abs(taken - rows_of.target.iloc[0]) <= rows_of["size"].max()
        assert (rows_of.copies <= 2).all() and rows_of.target.iloc[0] <= 2 * rows_of.source_size.iloc[0]
    totals = got.drop_duplicates(["source_size", "target"])
    assert totals.target.sum() == pytest.approx(1.5 * got["size"].sum())
    emitted = mixing.emit_copies(mixed, docs.columns)
    assert emitted.columns == docs.columns and emitted.count() == mixed.agg(F.sum("copies")).first()[0]


def test_the_mix_of_odd_rows(odd, none):
    mixed = mixing.mix_sources(odd)
    assert same_columns(odd, mixed, ["size", "source_size", "target", "copies"])
    assert mixed.count() == len(ODD_ROWS)
    assert sorted(r["size"] for r in mixed.collect()) == sorted(len(t.replace("\n", " ").replace("\t", " ").split(" ")) - t.replace(
        "\n", " ").replace("\t", " ").split(" ").count("") if t else 0 for _, t, *_ in ODD_ROWS)
    assert mixing.mix_sources(none).count() == 0
    again = mixing.mix_sources(odd.repartition(5))
    pick = ["doc_id", "size", "target", "copies"]
    assert sorted(map(str, mixed.select(pick).collect())) == sorted(map(str, again.select(pick).collect()))


def test_no_document_is_taken_more_often_than_allowed_far_along_a_source(spark):
    shift = 1 - np.arange(1, 5) / 2.0 ** 32
    rows = [((1 << b) + d, float(s), float(r)) for b in range(16, 51) for d in range(-3, 3) for s in shift for r in (2.0, 1.9999999, 1.5, 0.3)]
    df = spark.createDataFrame(rows, "place bigint, shift double, rate double")
    got = df.withColumn("copies", mixing.copies_at(F.col("place"), F.col("rate"), F.col("shift"), 2.0)).toPandas()
    assert (got[got.rate == 2].copies == 2).all() and got.copies.between(0, 2).all()
    near = got[(got.place < 1 << 30) & (got.rate == 0.3)]
    exact = [((p + 1) * 3 / 10 + s) // 1 - (p * 3 / 10 + s) // 1 for p, s in ((Fraction(int(p)), Fraction(s)) for p, s in zip(near.place, near["shift"]))]
    assert (near.copies - np.array(exact, dtype=float)).abs().sum() <= 0.01 * len(near)
