import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import packing as pk
from tests.llm.conftest import SF, documents

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pieces_of(text, capacity):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [0]
    cut = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
    return [(n, n * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes()), c) for n, c in enumerate(cut)]


def check(rows, texts, capacity):
    """Every piece of every document once, as a plain cut makes it, and sequences without gaps or overflow."""
    want = [(doc_id, *p) for doc_id, text in texts for p in pieces_of(text, capacity)]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def fewest(lengths, capacity):
    """Exhaustive search over sequences, for a few pieces."""
    best = len(lengths)

    def go(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= left[0]}.values():
            go(left[1:], [*rooms[:i], rooms[i] - left[0], *rooms[i + 1:]])
        go(left[1:], [*rooms, capacity - left[0]])

    go(sorted(lengths, reverse=True), [])
    return best


def sound(lengths, own, capacity):
    load = np.bincount(own, weights=lengths)
    return (own >= 0).all() and (load > 0).all() and load.max() <= capacity


def test_bound_and_search_against_all_packings():
    rng = np.random.default_rng(1)
    met = 0
    for trial in range(120):
        capacity = int(rng.integers(20, 60))
        lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 11))))[::-1]
        best, bound = fewest(lengths.tolist(), capacity), pk.lower_bound(lengths, capacity)
        assert bound <= best
        start = pk.best_fit(lengths, np.full(len(lengths), -1), np.arange(len(lengths)), capacity)
        herd = pk.evolve(lengths, [start], capacity, np.random.default_rng(trial), bound)
        assert all(sound(lengths, own, capacity) for own in herd)
        assert best <= herd[0].max() + 1 <= start.max() + 1
        met += herd[0].max() + 1 == best
    assert met >= 118


def test_breeding_beats_best_fit_decreasing():
    """Triplets that fill a sequence exactly, which best fit does not find."""
    plain = bred = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(400, 800, 40), rng.integers(500, 700, 40)
        lengths = np.sort(np.concatenate([a, b, 2048 - a - b]))[::-1]
        start = pk.best_fit(lengths, np.full(len(lengths), -1), np.arange(len(lengths)), 2048)
        herd = pk.evolve(lengths, [start], 2048, rng, pk.lower_bound(lengths, 2048), generations=30, size=16)
        assert sound(lengths, herd[0], 2048) and herd[0].max() <= start.max()
        plain, bred = plain + start.max(), bred + herd[0].max()
    assert bred < plain


def test_crossover_takes_whole_sequences():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(100, 900, 200))[::-1]
    one, other = (pk.shaken(lengths, 2048, rng) for _ in range(2))
    child = pk.crossover(lengths, one, other, 2048, rng)
    assert sound(lengths, child, 2048)
    sets = lambda own: {frozenset(np.flatnonzero(own == n).tolist()) for n in range(own.max() + 1)}
    assert len(sets(child) & sets(other)) >= 1 and len(sets(child) & sets(one)) >= 1


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = pk.pack_documents(docs)
    assert packed.columns == COLUMNS
    lengths = [p[2] for _, t in texts for p in pieces_of(t, 2048)]
    assert check(packed.collect(), texts, 2048) <= pk.lower_bound(np.array(lengths), 2048) + 1


def test_neighbourhoods_and_islands(spark):
    """Many small neighbourhoods of pieces that fit badly: rounds, migration and every piece once."""
    rng = np.random.default_rng(6)
    lengths = [*rng.integers(340, 700, 1500).tolist(), *[700] * 1000, *[2048] * 3]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    got = {r["key"]: (r["sequence_id"], r["offset"]) for r in pk.assign(pieces, neighbourhood=250).collect()}
    assert sorted(got) == list(range(len(lengths)))
    sequences = {}
    for key, (sequence, offset) in got.items():
        sequences.setdefault(sequence, []).append((offset, lengths[key]))
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()]
    assert len(sequences) <= 1.05 * pk.lower_bound(np.array(lengths), 2048)
    again = {r["key"]: (r["sequence_id"], r["offset"]) for r in pk.assign(pieces.repartition(5), neighbourhood=250).collect()}
    assert again == got


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_rows(odd, capacity):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert check(pk.pack_documents(odd, capacity=capacity).collect(), texts, capacity) > 1


def test_odd_characters(spark):
    texts = ["a<|endoftext|>b <|startoftext|> c", "İstanbul ΣΑΣ ς J̌ é ́x", "a\xa0b c\x1cd\x1fe　f​g\x85h",
             "I'LL 'S don't", "\x00 \x0b\x0c\r\n\t", "漢字かな交じり文 🙂🙂 ́", "x" * 5000, ""]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    check(pk.pack_documents(docs, capacity=64).collect(), list(enumerate(texts)), 64)
    assert pk.pack_documents(docs.where("false")).collect() == []
    assert pk.pack_documents(docs.where(F.lit(False)).select("text", "doc_id")).columns == COLUMNS
