"""Quality score of whole documents by a byte convolutional network.

The text is covered by chunks of two half chunks that overlap by one half. Filters answer at every
position, each chunk keeps its largest answers, and the chunk logits are averaged over the document
into one probability. Null and empty texts are scored as a text without bytes. A null id counts as a
training row when its label is known. Repeated rows get equal scores. Without labels of both classes
every score is 0.5. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm import bytecnn
from ledgerlens.llm.common import as_row, field, id_remainder, unit_hash, unpack

HELD_OUT_DIVISOR, HELD_OUT_REMAINDER = 3, 1
HALF = 256
PER_CLASS = 1200


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, HELD_OUT_DIVISOR) == HELD_OUT_REMAINDER


def labelled_parts(docs: DataFrame, labels: DataFrame, per_class: int, chars: int) -> pd.DataFrame:
    """A bounded sample (label, part): about `per_class` labelled texts a class, one chunk of each.

    A doc_id that carries both labels is left out. The chosen ids number at most twice `per_class`
    for each of the two classes, so they are broadcast.
    """
    marks = (
        labels.select(field("doc_id").alias("doc_id"), field("quality").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other").drop("other")
    )
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(counts) < 2:
        return pd.DataFrame({"label": [], "part": []})
    share = F.when(F.col("label") == 1, min(1.0, 1.5 * per_class / counts[1])).otherwise(min(1.0, 1.5 * per_class / counts[0]))
    chosen = marks.where(unit_hash(F.lit("quality"), F.col("doc_id")) < share).limit(4 * per_class)
    room = F.greatest(F.length("text") - chars + 1, F.lit(1))
    start = F.pmod(F.xxhash64(F.lit("start"), "doc_id", "text"), room.cast("long")).cast("int") + 1
    return (
        docs.select(field("doc_id").alias("doc_id"), field("text").alias("text")).where("text is not null")
        .join(F.broadcast(chosen), "doc_id")
        .select("label", F.substring(F.col("text"), start, F.lit(chars)).alias("part"))
        .limit(8 * per_class)
        .toPandas()
    )


def train_quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = 500) -> bytecnn.ByteCNN:
    """Learn from the labelled rows that are not held out; `per_class` bounds the sample."""
    sample = labelled_parts(docs, labels, per_class, 2 * HALF)
    sample = sample.sort_values(["label", "part"], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng(5)
    parts = [p.encode() for p in sample["part"]]
    parts += [p[:int(rng.integers(8, 2 * HALF))] for p in parts]
    rows = bytecnn.training_windows(parts, 3, 2 * HALF)
    classes = [0, 1] if len(sample) else [0]
    model = bytecnn.train(rows, np.array(list(sample["label"]) * 2, dtype=np.int64), classes, steps=steps)
    return model if len(classes) == 2 else bytecnn.ByteCNN(
        model.bytes_, model.filters, model.bias, np.zeros((len(model.bias), 2), np.float32), np.zeros(2, np.float32), [0, 1])


def score_texts(model: bytecnn.ByteCNN, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.zeros(len(texts))
    for first, last, stream, starts, held in bytecnn.streams(texts, model.overhang, HALF):
        halves = model.pooled(stream, HALF)
        ends = np.append(starts[1:], len(halves))
        # A chunk is a half with the half after it; the last half of a text joins the chunk before it.
        following = np.minimum(np.arange(len(halves)) + 1, np.repeat(ends - 1, ends - starts))
        chunk = np.maximum(halves, halves[following])
        z = model.logits(chunk).astype(np.float64)
        single = np.repeat(ends - starts == 1, ends - starts)
        weight = ((following != np.arange(len(halves))) & (held[following] > 0) | single
                  | (np.arange(len(halves)) == np.repeat(starts, ends - starts))).astype(np.float64)
        margin = np.add.reduceat((z[:, 1] - z[:, 0]) * weight, starts) / np.add.reduceat(weight, starts)
        out[first:last] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return out


def score_quality(docs: DataFrame, model: bytecnn.ByteCNN) -> DataFrame:
    """All columns and rows of `docs` with score and predicted (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(parts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(shared.value, [t.encode("utf-8", "replace") for t in parts]))

    scored = docs.select(as_row(docs), apply(F.coalesce(field("text"), F.lit(""))).alias("score"))
    return unpack(scored, docs.columns, {
        "score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int"),
    })
