"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles (runs without ASCII white space are words, and in
scripts that write no spaces every character is one; a text of one to four words is one shingle), each
weighing as often as it occurs. Two texts are linked when
their weighted Jaccard similarity, sum of the smaller over sum of the larger weights, is 0.8 or more.
Classes are the connected components of the links; equal texts are one vertex.

**Signature.** Darts fall on the quadrant weight x rank of each element as a Poisson process of rate
one, fixed by a hash of the element. Those below the element's weight count, in ascending rank, and
each names one of K coordinates; a coordinate keeps its earliest dart. Two texts agree in a
coordinate with a probability of exactly their weighted Jaccard similarity. Only ranks up to
t / (total weight), t = K ln K + 2K, are generated, so a text costs about t darts however long it is;
where a coordinate stays empty, that text is thrown for again with twice the rank. The weight axis is
cut at powers of two, so a heavy element costs a few strips.

**Banded joining.** 32 bands of 7 coordinates: a pair at similarity 0.8 shares no band with a
probability of 0.0005, one at 0.85 with 4e-6. Texts that agree in a band form a bucket. No bucket is
turned into all its pairs: each text is first compared with the one text beside it that stands in the
most and largest buckets, the likely origin of its copies, and linked texts become one component. Members
with so many shingles of their own, found in no other open text, that they cannot be similar enough to
any text of the bucket leave it; this bound is exact. What then still lies in one bucket but in different
components is compared in blocks, exactly and without a row per pair: a cell of two blocks emits only
links between components it has not yet joined. So no link that the bands offer is lost.

Null texts are linked with nothing and are classes of their own. Texts without a word are only
linked with equal texts. Repeated rows and equal texts fall into one class. A class is named by its
smallest doc_id (null if all its ids are null, or for a null text its own id). An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import as_row, field, unpack
from ledgerlens.llm.components import components
from ledgerlens.session import materialise

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
BLOCK, PARTS = 256, 8
_COLUMNS = 4096
_SLICE = 1 << 20
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)  # odd, so it can be divided by in arithmetic modulo 2**64
_BASE_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _nth(n: int) -> np.uint64:
    return _U(n * int(_GOLD) & (1 << 64) - 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1] from the upper 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) / float(1 << 53)


class _Powers:
    """Powers of the base and of its inverse, for hashing byte ranges from running sums."""

    def __init__(self, n: int):
        self.up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE)]).astype(np.uint64), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE_INVERSE)]).astype(np.uint64), dtype=np.uint64)


def _split_unspaced(b: np.ndarray, gap: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut around characters of scripts without spaces, each of which is a word of its own.

    By their bytes: kana and Han (lead E3 to E9), Thai and Lao (E0 B8 to E0 BB), Burmese (E1 80 to E1 82), Khmer (E1 9E, E1 9F).
    """
    second = np.concatenate([b[1:], [0]])
    alone = (b >= 0xE3) & (b <= 0xE9) | (b == 0xE0) & (second >= 0xB8) & (second <= 0xBB) \
        | (b == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F))
    if not alone.any():
        return first, past
    starts = np.zeros(len(b) + 3, bool)
    starts[first] = True
    starts[np.flatnonzero(alone)] = True
    starts[np.flatnonzero(alone) + 3] = True  # what follows such a character
    starts = np.flatnonzero(starts[:len(b)] & ~gap)
    ends = np.unique(np.concatenate([starts, past]))
    return starts, ends[np.searchsorted(ends, starts, "right")]


def word_hashes(data: bytes, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each word, in order. Long texts are cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + _SLICE, len(data))
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t"))
            if cut >= at:
                end = cut + 1
            else:  # a word of over a million bytes is cut as well, between characters
                while data[end] & 0xC0 == 0x80:
                    end -= 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        first, past = edge[::2], edge[1::2]
        if len(b) and b.max() >= 0xE0:
            first, past = _split_unspaced(b, gap, first, past)
        sums = np.concatenate([[_U(0)], np.cumsum((b.astype(np.uint64) + _U(1)) * powers.up[:len(b)], dtype=np.uint64)])
        out.append(mix((sums[past] - sums[first]) * powers.down[first] + (past - first).astype(np.uint64) * _GOLD))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes, powers: _Powers, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    w = word_hashes(data, powers)
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = min(words, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = mix(h * _GOLD + w[j:len(w) - n + 1 + j])
    return np.unique(h, return_counts=True)


def occurrences(data: bytes, powers: _Powers, words: int = WORDS) -> np.ndarray:
    """One hash for the first, second, … occurrence of each shingle: the Jaccard similarity of two such
    sets is the weighted one of the texts."""
    ids, counts = shingles(data, powers, words)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(ids, counts) + nth.astype(np.uint64) * _GOLD).view(np.int64)


def signatures(ids: np.ndarray, weights: np.ndarray, sizes: Sequence[int], k: int) -> np.ndarray:
    """(texts, k) dart ids, k <= 2048. `ids` and `weights` hold the elements of all texts end to end, `sizes` elements each.

    Weights are positive numbers of any kind. A text without elements gets zeros.
    """
    if k > 2048:
        raise ValueError("at most 2048 coordinates")
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), k), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = weights.astype(np.float64)
    total = np.bincount(owner, weights, minlength=len(sizes))
    todo = np.flatnonzero(total > 0)
    t = k * np.log(k) + 2 * k
    while len(todo):
        place = np.full(len(sizes), -1)
        place[todo] = np.arange(len(todo))
        chosen = place[owner] >= 0
        own, darts, ranks, coordinates = _throw(
            place[owner[chosen]], ids[chosen], weights[chosen], (t / np.maximum(total, 1e-300))[owner[chosen]], k)
        cell = own * k + coordinates
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, cell, ranks)
        won = ranks == earliest[cell]
        found = np.zeros(len(todo) * k, np.uint64)
        np.maximum.at(found, cell[won], darts[won])
        out[todo] = found.reshape(len(todo), k)
        todo = todo[np.isinf(earliest.reshape(len(todo), k)).any(axis=1)]
        t *= 2
    return out


def _throw(own, ids, weights, limit, k):
    """All darts of each element below its weight and up to its rank limit: owner, dart, rank, coordinate.

    The upper bits of a dart give its rank, the lowest eleven its coordinate, a second hash its weight.
    """
    found = []
    strip, low = 0, 0.0
    while True:
        high = 1.0 if strip == 0 else low * 2
        inside = np.flatnonzero(weights > low)
        if not len(inside):
            break
        o, most = own[inside], limit[inside]
        w = None if (weights[inside] >= high).all() else weights[inside]  # none: every dart of the strip counts
        seed = mix(ids[inside] + _nth(strip + 1))
        rank = np.zeros(len(inside))
        turn = 0
        while len(o):
            turn += 1
            dart = mix(seed + _nth(turn))
            chance = unit(dart)
            if turn == 1:  # rank <= most, without a logarithm for each element that gets no dart
                near = chance >= np.exp(-most * (high - low)) * (1 - 1e-12)
                o, most, seed, rank, dart, chance = (x[near] for x in (o, most, seed, rank, dart, chance))
                w = w[near] if w is not None else None
            rank = rank - np.log(chance) / (high - low)
            live = rank <= most
            if not live.all():
                o, most, seed, rank, dart = (x[live] for x in (o, most, seed, rank, dart))
                w = w[live] if w is not None else None
            which = (dart & _U(2047)).astype(np.int64) % k
            if w is None:
                found.append((o, dart, rank, which))
            else:
                hit = low + (high - low) * (unit(mix(dart ^ _BASE)) - 2.0 ** -53) < w
                found.append((o[hit], dart[hit], rank[hit], which[hit]))
        strip, low = strip + 1, high
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of band number and the coordinates of the band."""
    part = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _GOLD + part[:, :, j])
    return key.view(np.int64)


def _encode(text) -> bytes:
    return text.encode("utf-8", "replace") if text is not None else b""


def _band_column(words: int, bands: int, rows: int):
    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = _Powers(_SLICE)
        for texts in batches:
            out: list = []
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def flush():
                sizes = [len(i) for i, _ in held]
                signed = signatures(np.concatenate([i for i, _ in held]), np.concatenate([c for _, c in held]),
                                    sizes, bands * rows)
                out.extend(list(row) if n else None for row, n in zip(band_keys(signed, bands, rows), sizes))
                held.clear()

            room = 0
            for text in texts:
                held.append(shingles(_encode(text), powers, words))
                room += len(held[-1][0]) + 4000
                if room > 400_000:
                    flush()
                    room = 0
            if held:
                flush()
            yield pd.Series(out, dtype=object)

    return keys


def _occurrence_column(words: int):
    @F.pandas_udf("array<bigint>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = _Powers(_SLICE)
        for texts in batches:
            yield pd.Series([occurrences(_encode(t), powers, words) for t in texts], dtype=object)

    return apply


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose occurrence sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-9)
        .select("a", "b")
    )


def _merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components of new links and of the components found before."""
    if labels is not None:
        links = links.unionAll(labels.select(F.col("vertex").alias("a"), F.col("label").alias("b")))
    return materialise(components(links))


def _in_different_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that reach into several components, with their component as `label`."""
    marked = members.join(labels.select(F.col("vertex").alias("node"), "label"), "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")) \
        .where("low < high").select("key")
    return materialise(marked.join(open_keys, "key"))


def _sizes_allow(a, b, similarity: float):
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _sharing_allows(shared, a, b, similarity: float):
    """Whether texts of sizes a and b can be similar that have at most `shared` in common."""
    return shared >= similarity * (a + b - shared) - 1e-9


def _without_loners(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members that can be similar to another one of their bucket, with `common`: how many of their
    occurrences some other member's text has as well."""
    grams = sets.join(members.select("node").distinct(), "node").select("node", F.explode("grams").alias("gram"))
    alone = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    least = members.groupBy("key").agg(F.min("total").alias("least"))
    common = F.col("total") - F.coalesce("own", F.lit(0))
    kept = (
        members.join(own, "node", "left").withColumn("common", common).drop("own").join(least, "key")
        .where(_sharing_allows(F.col("common"), F.col("total"), F.greatest("least", "common"), similarity)).drop("least"))
    return kept


def cell_links(nodes, labels, blocks, grams, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) between similar texts of different labels in one cell; each joins two labels not yet joined there.

    A cell holds the texts of one block, or of two blocks, of which only pairs across are looked at.
    """
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    _, number, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1  # occurrences of one text alone are left out
    own, at = owner[held[number] > 1], column[number[held[number] > 1]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    shared = np.zeros((len(nodes), len(nodes)), np.float32)
    for first in range(0, at[-1] + 1 if len(at) else 0, _COLUMNS):
        low, high = np.searchsorted(at, [first, first + _COLUMNS])
        part = np.zeros((len(nodes), _COLUMNS), np.float32)
        part[own[low:high], at[low:high] - first] = 1
        shared += part @ part.T
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    near &= np.triu(labels[:, None] != labels[None, :], 1)
    if len(set(blocks)) > 1:
        near &= blocks[:, None] != blocks[None, :]
    parent = {label: label for label in labels}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for i, j in np.argwhere(near):
        x, y = top(labels[i]), top(labels[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j]))))
    return links


def _links_in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the members of a bucket that lie in different components.

    A bucket is cut into blocks, and each two blocks meet in one bounded cell, which emits fewer links
    than it holds texts.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A large bucket is dealt by parts for its number of blocks, and by block before its rows are multiplied.
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.lit(PARTS)).cast("int")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    cells = (
        members.withColumn("part", part).join(blocks, ["key", "part"])
        .select("key", "node", "label", "blocks", own.alias("block")).repartition("key", "block")
        .select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(sets, "node"))

    def meet(cell: pa.Table) -> pa.Table:
        found = cell_links(cell["node"].to_numpy(), cell["label"].to_numpy(), cell["block"].to_numpy(),
                           [np.asarray(g) for g in cell["grams"].combine_chunks().to_numpy(zero_copy_only=False)], similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return cells.groupBy("key", "low", "high").applyInArrow(meet, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                           rows: int = ROWS) -> DataFrame:
    """One row per distinct text: text_key, doc_id (its smallest), class_id and the number of the class in
    this run (`component`). Null texts are left out."""
    texts = docs.select(field("doc_id").alias("doc_id"), field("text").alias("text")).where("text is not null") \
        .withColumn("text_key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    printed = texts.select("doc_id", "text_key", _band_column(words, bands, rows)("text").alias("keys"))
    nodes = materialise(
        materialise(printed).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.where("keys is not null").select("node", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sharing = materialise(banded.join(full, "key"))

    # The texts that share a bucket, once each, as occurrence sets.
    wanted = nodes.join(sharing.select("node").distinct(), "node").select("node", "doc_id", "text_key")
    same = (F.col("t.text_key") == F.col("w.text_key")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    sets = materialise(
        texts.alias("t").join(wanted.alias("w"), same).select("w.node", "t.text").dropDuplicates(["node"])
        .select("node", _occurrence_column(words)("text").alias("grams")))
    standing = sharing.groupBy("node").agg(F.sum("n").alias("standing"))
    weighed = sets.select("node", F.size("grams").alias("total")).join(standing, "node")
    members = materialise(sharing.select("key", "node").join(weighed, "node"))

    # Each text first meets one other only: the member of any of its buckets that stands out most.
    heads = members.groupBy("key").agg(F.max(F.struct("standing", "node", "total")).alias("best"))
    origins = members.join(heads, "key").groupBy("node", "total").agg(F.max("best").alias("best")).where(
        (F.col("node") != F.col("best.node")) & _sizes_allow(F.col("total"), F.col("best.total"), similarity))
    pairs = origins.select(F.greatest("node", "best.node").alias("a"), F.least("node", "best.node").alias("b")).distinct()
    labels = _merged(_linked(pairs, sets, similarity), None)
    open_members = _in_different_components(members, labels)
    open_members = _in_different_components(_without_loners(open_members.drop("label"), sets, similarity), labels)
    labels = _merged(_links_in_blocks(open_members, sets, similarity), labels)

    placed = nodes.join(labels.select(F.col("vertex").alias("node"), "label"), "node", "left") \
        .select("text_key", "doc_id", F.coalesce("label", "node").alias("label"))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return placed.join(named, "label").select("text_key", "doc_id", "class_id", F.col("label").alias("component"))


def _text_key(text):
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of `docs` with class_id (a column of that name is replaced)."""
    classes = near_duplicate_classes(docs, **options).select(F.col("text_key").alias("of"), "class_id")
    marked = docs.select(as_row(docs), field("doc_id").alias("id"), _text_key(field("text")).alias("text_key"))
    joined = marked.join(classes, F.col("text_key") == F.col("of"), "left")
    return unpack(joined, docs.columns, {
        "class_id": F.when(F.col("text_key").isNull(), F.col("id")).otherwise(F.col("class_id"))})


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one with the smallest doc_id; rows with null text all stay."""
    chosen = near_duplicate_classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))) \
        .groupBy("component", F.col("class_id").alias("as")).agg(F.min("text_key").alias("of")).drop("component")
    marked = docs.select(as_row(docs), field("doc_id").alias("id"), _text_key(field("text")).alias("text_key"))
    kept = (
        marked.where("text_key is not null")
        .join(chosen, (F.col("text_key") == F.col("of")) & F.col("id").eqNullSafe(F.col("as")), "left_semi")
        .dropDuplicates(["text_key", "id"])
    )
    return unpack(kept.unionByName(marked.where("text_key is null")), docs.columns, {})
