"""A uniform shuffle of the corpus into shards, in two external passes.

Pass one scatters records by a seeded hash over buckets small enough for memory. Pass two shuffles
each bucket by Fisher-Yates (numpy's `permutation`) and lays the buckets end to end; the shards are
equal stretches of that order, so their row counts differ by one at most. A bucket is a contiguous
stretch, so its task holds ready pieces of one or two shards and can write them at once.

The hash is of id and text. Rows repeated so often that they would fill a bucket on their own (more
than a thousandth of all rows) are also told apart by their other columns and, where those agree, by
numbers: equal rows are counted and written out again, copy by copy. So the result depends on the
rows alone and not on how they lie in files. Null ids and null texts hash like values. Repeated rows
stay separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.llm.common import as_row, field, unpack

SEED = 20_240_701
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 20  # bounds the table of bucket starts at 8 MB; buckets grow beyond 16 TB of text
FREQUENT = 1000
RUN = 4096  # copies of a row that one task writes out together


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _frequent_keys(keyed: DataFrame, total: int) -> list[int]:
    """Hashes that hold more than a thousandth of the rows: fewer than a thousand of them."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return [r["key"] for r in counts.where(F.col("n") > F.lit(max(total // FREQUENT, 100))).collect()]


def _number_copies(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` with a `place` for each copy of equal ones; runs of copies are written out in tasks of their own."""
    counted = rows.groupBy("row", "key", "others").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = runs.repartition(parts, "key", "others", "first") \
        .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n")) - 1)))
    return copies.select("row", "key", "others", F.xxhash64(F.lit(seed + 1), "key", "others", "copy").alias("place"))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 40, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `docs` in random order with `shard` and `slot` (such columns are replaced)."""
    key = F.xxhash64(F.lit(seed), field("doc_id"), field("text"))
    keyed = docs.select(key.alias("key"), record_size(field("text")).alias("bytes"))
    total, volume = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = int(min(max(1, -(-volume // bucket_bytes)), MAX_BUCKETS))
    frequent = _frequent_keys(keyed, total) if total else []
    others = [field(c) for c in docs.columns if c.lower() not in ("doc_id", "text")]
    look = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    rows = docs.select(as_row(docs), key.alias("key"), look.alias("others"))
    placed = rows.withColumn("place", F.col("key"))
    if frequent:
        often = F.col("key").isin(frequent)
        placed = placed.where(~often).unionByName(_number_copies(rows.where(often), seed))
    # Shifted: the low bits also choose the shuffle partition.
    bucket = F.pmod(F.shiftrightunsigned("place", 20), F.lit(buckets)).cast("int")
    scattered = placed.select("row", "key", "others", "place", bucket.alias("bucket"))
    counts = np.zeros(buckets, np.int64)
    for r in scattered.groupBy("bucket").count().collect():  # one row per bucket, see MAX_BUCKETS
        counts[r["bucket"]] = r["count"]
    starts = docs.sparkSession.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)[:-1]]))

    def shuffled(group: pa.Table) -> pa.Table:
        number = group["bucket"][0].as_py()
        n = group.num_rows
        # Whatever order the rows arrived in.
        settled = np.lexsort([group[c].to_numpy() for c in ("place", "others", "key")])
        order = settled[np.random.default_rng([seed, number]).permutation(n)]
        at = int(starts.value[number]) + np.arange(n, dtype=np.int64)
        shard = at * n_shards // max(total, 1)
        first = -(-shard * total // n_shards)
        return pa.table({"row": group["row"].take(pa.array(order)), "shard": pa.array(shard, pa.int32()),
                         "slot": pa.array(at - first, pa.int64())})

    schema = T.StructType([scattered.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    shards = scattered.groupBy("bucket").applyInArrow(shuffled, schema)
    return unpack(shards, docs.columns, {"shard": F.col("shard"), "slot": F.col("slot")})


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. Rows leave pass two in slot order within a bucket, so no further shuffle is needed."""
    sharded.write.partitionBy("shard").parquet(path)
