import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bytecnn, language, quality_net
from tests.llm.conftest import ODD_ROWS, SF, documents, same_columns


@pytest.fixture(scope="module")
def language_model(docs):
    return language.train_language_model(docs)


def test_pooled_answers_equal_a_direct_convolution():
    rng = np.random.default_rng(0)
    model = bytecnn.train(rng.integers(1, 255, (20, 32)).astype(np.uint8), np.arange(20) % 2, ["a", "b"], per_width=3, steps=3)
    text = bytes(rng.integers(1, 255, 100).astype(np.uint8))
    (_, _, stream, starts, held), = bytecnn.streams([text], model.overhang, 32)
    assert held.sum() == 100 and list(starts) == [0]
    padded = np.concatenate([stream, np.zeros(8, np.uint8)])
    want = np.full((len(stream) // 32, len(model.filters)), -np.inf)
    for t in range(len(stream)):
        x = model.bytes_[padded[t:t + model.filters.shape[1]]]
        want[t // 32] = np.maximum(want[t // 32], (model.filters * x).sum(axis=(1, 2)))
    assert np.allclose(model.pooled(stream, 32), want, atol=1e-4)


def test_gradient_of_training_lowers_the_loss():
    rows = bytecnn.training_windows([b"abcabcabc", b"xyzxyzxyz"] * 20, 3, 32)
    model = bytecnn.train(rows, np.array([0, 1] * 20), ["a", "x"], steps=60)
    best, score = language.predict_texts(model, [b"bcabca", b"zxyzxy"])
    assert list(best) == [0, 1] and score.min() > 0.9


def test_score_does_not_depend_on_the_batch(language_model):
    texts = [b"the cat and the dog", b"", "die katze und der hund für das große haus".encode() * 900, b"x"]
    together = language.predict_texts(language_model, texts)
    alone = [language.predict_texts(language_model, [t]) for t in texts]
    assert np.allclose(together[1], [s[0] for _, s in alone], atol=1e-5)


def test_language_of_held_out_documents(docs, language_model):
    found = language.predict_language(docs, language_model).select(
        "doc_id", "lang", "lang_pred", "score", language.held_out(F.col("doc_id")).alias("held_out")).toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    tested = found[found.held_out]
    assert (tested.lang == tested.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_of_odd_rows(odd, none, language_model):
    found = language.predict_language(odd, language_model)
    assert same_columns(odd, found, ["lang_pred", "score"])
    rows = found.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(ODD_ROWS)
    for r in rows:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0)
    assert language.predict_language(none, language_model).count() == 0
    assert language.predict_language(odd, language.train_language_model(none)).where("lang_pred = 'und'").count() == len(ODD_ROWS)


def test_language_is_learned_only_from_rows_not_held_out(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "nur text", "xx" if i in ids else "de", "s", 8) for i in range(60)]
    assert language.train_language_model(documents(spark, rows)).classes == ["de"]


def test_quality_of_held_out_documents(spark, docs):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_net.train_quality_model(docs, labels)
    found = quality_net.score_quality(docs, model).join(labels, "doc_id").toPandas()
    tested = found[[zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]]
    good, bad = tested[tested.quality == 1].score.to_numpy(), tested[tested.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (found.predicted == (found.score >= 0.5)).all()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (9, 0, 0), (9, 1, 0), (10, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality_net.train_quality_model(odd, labels, steps=5)
    found = quality_net.score_quality(odd, model)
    assert same_columns(odd, found, ["score", "predicted"])
    rows = found.select("score").collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    blank = quality_net.train_quality_model(odd, labels.where("quality = 1"))
    assert {r["score"] for r in quality_net.score_quality(odd, blank).collect()} == {0.5}
    assert quality_net.score_quality(none, model).count() == 0


def test_chunks_of_a_long_text_all_count():
    class Half(bytecnn.ByteCNN):
        def logits(self, pooled):
            return np.stack([np.zeros(len(pooled)), pooled[:, 0]], axis=1)

    e = np.zeros((256, 1), np.float32)
    e[ord("a")] = 1
    model = Half(e, np.ones((1, 1, 1), np.float32), np.zeros(1), np.zeros((1, 2)), np.zeros(2), [0, 1])
    text = b"b" * 256 * 3 + b"a" + b"b" * 255  # four halves, three chunks, one of which holds the a
    assert quality_net.score_texts(model, [text]) == pytest.approx(1 / (1 + np.exp(-1 / 3)))
