"""Language identification with a byte convolutional network.

Null texts and texts without a letter get `und`. A null id counts as a training row. Repeated rows
get the same prediction each. An empty table, or one with fewer than two labelled languages, gives
a net that answers evenly (with one language: that language with score 1; with none: `und`, 0).
Only the text enters a prediction; it is read whole, window by window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm import bytecnn
from ledgerlens.llm.common import as_row, field, id_remainder, unit_hash, unpack

UNDETERMINED = "und"
HELD_OUT_DIVISOR, HELD_OUT_REMAINDER = 4, 2
PER_LANGUAGE = 600
MAX_LANGUAGES = 256


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, HELD_OUT_DIVISOR) == HELD_OUT_REMAINDER


def labelled_windows(docs: DataFrame, label: Column, per_class: int, max_classes: int, chars: int) -> pd.DataFrame:
    """A bounded sample (label, part) for training: about `per_class` rows of each class.

    Rows are chosen by a hash of id and text, and of each chosen text one stretch of `chars`
    characters is sent, at a place that the hash names. At most `max_classes` classes, the most
    frequent ones, and at most twice `per_class` rows for each of them.
    """
    known = docs.select(label.alias("label"), field("text").alias("text"), field("doc_id").alias("doc_id")) \
        .where("label is not null and text is not null")
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_classes).collect()
    if not counts:
        return pd.DataFrame({"label": [], "part": []})
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["label"], min(1.0, 1.5 * per_class / r["count"]))])
    room = F.greatest(F.length("text") - chars + 1, F.lit(1))
    start = F.pmod(F.xxhash64(F.lit("start"), "doc_id", "text"), room.cast("long")).cast("int") + 1
    return (
        known.where(unit_hash(F.lit("train"), F.col("doc_id"), F.col("text")) < share[F.col("label")])
        .select("label", F.substring(F.col("text"), start, F.lit(chars)).alias("part"))
        .limit(2 * per_class * len(counts))
        .toPandas()
    )


def train_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES,
                         steps: int = 500) -> bytecnn.ByteCNN:
    """Learn from text and lang of the rows that are not held out. The sample is bounded by the two parameters."""
    sample = labelled_windows(docs.where(~held_out(field("doc_id"))), field("lang"), per_language, max_languages,
                              bytecnn.WINDOW)
    sample = sample.sort_values(["label", "part"], kind="stable").reset_index(drop=True)
    classes = sorted(set(sample["label"]))
    rng = np.random.default_rng(11)
    parts = [p.encode() for p in sample["part"]]
    # Half of the windows are cut short, as short texts are.
    parts += [p[:int(rng.integers(12, bytecnn.WINDOW))] for p in parts]
    numbers = np.array([classes.index(v) for v in sample["label"]] * 2, dtype=np.int64)
    return bytecnn.train(bytecnn.training_windows(parts, 3, bytecnn.WINDOW), numbers, classes, steps=steps)


def predict_texts(model: bytecnn.ByteCNN, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class number and probability of each text: window probabilities averaged by the bytes they cover."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for first, last, stream, starts, held in bytecnn.streams(texts, model.overhang):
        prob = bytecnn.softmax(model.logits(model.pooled(stream)).astype(np.float64))
        weight = held.astype(np.float64)
        total = np.add.reduceat(prob * weight[:, None], starts, axis=0)
        size = np.maximum(np.add.reduceat(weight, starts), 1)
        mean = np.clip(total / size[:, None], 0, 1)
        best[first:last] = mean.argmax(axis=1)
        score[first:last] = mean.max(axis=1)
    return best, score


def predict_language(docs: DataFrame, model: bytecnn.ByteCNN) -> DataFrame:
    """All columns and rows of `docs` with lang_pred and score (columns of those names are replaced)."""
    known = bool(model.classes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def apply(parts: pd.Series) -> pd.DataFrame:
        net = shared.value
        best, score = predict_texts(net, [t.encode("utf-8", "replace") for t in parts])
        return pd.DataFrame({"lang": [net.classes[i] for i in best], "score": score})

    lettered = F.coalesce(field("text").rlike(r"\p{L}"), F.lit(False))
    answer = apply(F.coalesce(field("text"), F.lit(""))) if known else \
        F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    scored = docs.select(as_row(docs), lettered.alias("lettered"), answer.alias("answer"))
    return unpack(scored, docs.columns, {
        "lang_pred": F.when(F.col("lettered"), F.col("answer.lang")).otherwise(UNDETERMINED),
        "score": F.when(F.col("lettered"), F.col("answer.score")).otherwise(0.0),
    })
