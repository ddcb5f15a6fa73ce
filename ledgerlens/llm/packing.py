"""Packing of documents into sequences of bounded length by a grouping genetic algorithm.

Texts become token ids in Arrow batches; a document is its ids and a closing id, and only one longer
than a sequence is cut. A piece that fills a sequence is one by itself. All others are dealt by a hash of
their number into neighbourhoods of bounded size, and each neighbourhood is packed on its own: first
best-fit decreasing, which is done if it meets a lower bound on the number of sequences (Martello and
Toth's). Where it does not, the neighbourhood becomes several islands. On an island, packings are bred:
a child takes whole well-filled sequences from one parent, drops the sequences of the other that hold
the same pieces, and puts displaced pieces where they fit best. Between epochs the best packings of an
island migrate to the next one, in one shuffle of numbers. Sequences left with room to spare are then
dissolved, and their pieces are dealt into the neighbourhoods of the next round, which are fewer; the
last round has one neighbourhood, or as many as could no longer be improved. So no task holds more than
a neighbourhood, and all sequences together are within a sequence or so of the best of their parts.

Hashes and random numbers are seeded, and neighbourhoods are sorted before they are packed, so a rerun
over the same piece numbers gives the same packing.

A null or empty text is one closing id. Null ids and repeated rows are documents like others. Columns
besides id and text are not looked at. Texts of any length are cut and never dropped; a single text is
held in memory whole. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ledgerlens.llm.common import field
from ledgerlens.session import materialise

CAPACITY, CLOSING_ID = 2048, 0
NEIGHBOURHOOD = 4096   # pieces packed together, on average
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 3, 2, 4, 6, 2
INJECTED = 0.15        # share of one parent's sequences that a child takes whole
SPARE = 0.02           # share of a sequence whose emptiness sends its pieces to the next round
MAX_ROUNDS = 6
CACHE_WORDS = 800_000  # words whose ids a Python worker keeps, some 160 MB
BLOCK_BYTES = 8 << 20  # ids of whole documents that leave a task together


# Tokens -------------------------------------------------------------------------------------


# Characters of which lower case, composition and kind are plain: ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
# On such characters, in lower case, these are the tokenizer's own pieces. Its pattern.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_SPACE = re.compile(r"[\t-\r ]+")
_SPECIAL = "<|"


class Words(dict):
    """Little-endian 32-bit ids of words between white space, each tokenised once as long as there is room.

    White space of ASCII always ends a token, so a text's ids are those of its words in order. A word of
    plain characters is cut into pieces here and goes straight to the tokenizer's merges, which is the
    smaller part of its work; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({chr(c): as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100)})
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece if piece.isascii() else piece.translate(self.letters)
            ids = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], "<u4").tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and _SPECIAL not in word:
            ids = b"".join(map(self._piece, _PIECE.findall(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.pieces.clear()
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(map(self.__getitem__, filter(None, _SPACE.split(text))))


_WORDS: dict[str, Words] = {}


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32, ids): the pieces of all documents; `key` is a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = Words(tokenizer)
        words = _WORDS[tokenizer]
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pieces, size = [], 0
                while at < batch.num_rows and size < BLOCK_BYTES:
                    ids = words.encode(batch["text"][at].as_py() or "") + closing
                    pieces += [(at, n, ids[4 * start:4 * (start + capacity)])
                               for n, start in enumerate(range(0, len(ids) // 4, capacity))]
                    at, size = at + 1, size + len(ids)
                number = np.array([n for _, n, _ in pieces], np.int32)
                lengths = np.array([len(ids) // 4 for _, _, ids in pieces], np.int64)
                flat = np.frombuffer(b"".join(ids for _, _, ids in pieces), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array([d for d, _, _ in pieces])), pa.array(number),
                    pa.array(number.astype(np.int64) * capacity), pa.array(lengths),
                    pa.array([zlib.crc32(ids) for _, _, ids in pieces], pa.int64()),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = docs.select(field("doc_id"), field("text")).mapInArrow(cut, schema)
    return materialise(pieces.withColumn("key", F.monotonically_increasing_id()))


# Packings: the sequence number of each piece, pieces sorted by falling length ------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: pieces that cannot share a sequence, and what must go beside them."""
    up = np.sort(lengths)
    sums = np.concatenate([[0], np.cumsum(up)])
    best = -(-int(sums[-1]) // capacity)
    half = np.searchsorted(up, capacity // 2, "right")  # pieces above half a sequence start here
    for small in np.unique(np.concatenate([[0], up[up <= capacity // 2]])):
        alone = np.searchsorted(up, capacity - small, "right")  # nothing of at least `small` goes beside these
        first = np.searchsorted(up, small, "left")
        big = len(up) - alone
        middle = len(up[half:alone])
        room = middle * capacity - int(sums[alone] - sums[half])
        over = int(sums[half] - sums[min(first, half)]) - room
        best = max(best, big + middle + max(0, -(-over // capacity)))
    return best


class Room:
    """Places left in open sequences, ordered by size, for best fits."""

    def __init__(self, free: np.ndarray, capacity: int):
        self.capacity, self.sequences = capacity, len(free)
        self.places = sorted((int(f), n) for n, f in enumerate(free) if f > 0)

    def put(self, length: int) -> int:
        """The sequence with the least room that still takes the piece, or a new one."""
        at = bisect.bisect_left(self.places, (length, -1))
        if at < len(self.places):
            free, number = self.places.pop(at)
        else:
            free, number = self.capacity, self.sequences
            self.sequences += 1
        if free > length:
            bisect.insort(self.places, (free - length, number))
        return number


def best_fit(lengths: np.ndarray, own: np.ndarray, displaced: np.ndarray, capacity: int) -> np.ndarray:
    """`own` with the displaced pieces put, in their order, where they fit best; numbers are made gapless."""
    own = own.copy()
    own[displaced] = -1
    held = own >= 0
    own[held] = np.unique(own[held], return_inverse=True)[1]
    room = Room(capacity - np.bincount(own[held], weights=lengths[held]).astype(np.int64), capacity)
    own[displaced] = [room.put(length) for length in lengths[displaced].tolist()]
    return own


def fitness(lengths: np.ndarray, own: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences are better; of as many, those filled less evenly, as they have room for more."""
    load = np.bincount(own, weights=lengths)
    return len(load), -float(np.square(load / capacity).sum())


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled sequences of `other` go into `one`; what they displace is fitted in anew."""
    load = np.bincount(other, weights=lengths)
    good = np.argsort(-load, kind="stable")[:max(1, len(load) // 2)]
    taken = rng.choice(good, max(1, int(len(load) * INJECTED)) if len(good) > len(load) * INJECTED else len(good), replace=False)
    injected = np.isin(other, taken)
    broken = np.isin(one, one[injected])  # sequences that hold an injected piece as well
    child = np.where(injected, other + len(lengths), one)
    return best_fit(lengths, child, np.flatnonzero(broken & ~injected), capacity)


def mutation(lengths: np.ndarray, own: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Some sequences, mostly the emptiest, are dissolved and their pieces fitted in anew."""
    load = np.bincount(own, weights=lengths)
    worst = np.argsort(load, kind="stable")[:max(1, len(load) // 50)]
    gone = np.concatenate([worst, rng.choice(len(load), max(1, len(load) // 50))])
    return best_fit(lengths, own, np.flatnonzero(np.isin(own, gone)), capacity)


def shaken(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing of another kind: best fit in an order that only roughly falls."""
    order = np.argsort(-lengths * rng.uniform(0.8, 1.0, len(lengths)), kind="stable")
    return best_fit(lengths, np.full(len(lengths), -1), order, capacity)


def evolve(lengths: np.ndarray, start: list[np.ndarray], capacity: int, rng: np.random.Generator, bound: int,
           generations: int = GENERATIONS, size: int = POPULATION) -> list[np.ndarray]:
    """Packings of one island, best first, after some generations; ends early at the lower bound."""
    key = lambda own: fitness(lengths, own, capacity)
    herd = sorted(start, key=key)
    while len(herd) < size:
        herd.append(shaken(lengths, capacity, rng))
    herd.sort(key=key)
    for _ in range(generations):
        if herd[0].max() + 1 <= bound:
            break
        children = []
        for _ in range(size):
            a, b = rng.integers(len(herd), size=2).tolist()  # the better of two, twice
            c, d = rng.integers(len(herd), size=2).tolist()
            child = crossover(lengths, herd[min(a, b)], herd[min(c, d)], capacity, rng)
            children.append(mutation(lengths, child, capacity, rng))
        herd = sorted([*herd, *children], key=key)[:size]
    return herd


# On the cluster ------------------------------------------------------------------------------


def _sorted(group: pa.Table) -> pa.Table:
    """Falling lengths, and whatever order the rows arrived in."""
    return group.take(np.lexsort((group["key"].to_numpy(), -group["length"].to_numpy())))


def _elites(group: pa.Table) -> list[np.ndarray]:
    """The packings that came with a group, each piece's numbers being in one list."""
    if not group.num_rows:
        return []
    numbers = group["elites"].combine_chunks().flatten().to_numpy().astype(np.int64)
    return list(np.ascontiguousarray(numbers.reshape(group.num_rows, -1).T))


def _packed(group: pa.Table, packings: list[np.ndarray], bound: int) -> pa.Table:
    count = int(packings[0].max()) + 1
    lists = np.stack(packings, axis=1).astype(np.int32)
    return pa.table({
        "cell": group["cell"], "island": group["island"], "key": group["key"], "length": group["length"],
        "elites": pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), lists.ravel()),
        "sequences": np.full(group.num_rows, count, np.int32), "settled": np.full(group.num_rows, count <= bound)})


STATE = "cell long, island int, key long, length long, elites array<int>, sequences int, settled boolean"


def _round(pieces: DataFrame, cells: int, number: int, capacity: int, seed: int, islands: int, epochs: int,
           generations: int) -> DataFrame:
    """(cell, key, length, sequence): each neighbourhood packed as well as its islands could."""
    cell = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "key"), F.lit(cells)).alias("cell")
    dealt = pieces.select(cell, F.lit(0).alias("island"), "key", "length")

    def first(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        lengths = group["length"].to_numpy()
        plain = best_fit(lengths, np.full(len(lengths), -1), np.arange(len(lengths)), capacity)
        return _packed(group, [plain], lower_bound(lengths, capacity))

    state = materialise(dealt.groupBy("cell").applyInArrow(first, STATE))
    done = [state.where("settled")]
    state = state.where("not settled")
    if not state.head(1):
        return done[0].select("cell", "key", "length", F.col("elites")[0].alias("sequence"))
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    def breeder(epoch: int):
        def bred(group: pa.Table) -> pa.Table:
            # An island's own packings and those that came from the island before it, piece by piece.
            home = group["island"].to_numpy() == group["origin"].to_numpy()
            own, came = _sorted(group.filter(home)), _sorted(group.filter(~home))
            lengths = own["length"].to_numpy()
            bound = lower_bound(lengths, capacity)
            rng = np.random.default_rng([seed, number, epoch, own["cell"][0].as_py(), own["island"][0].as_py()])
            herd = evolve(lengths, _elites(own) + _elites(came), capacity, rng, bound, generations)
            return _packed(own, herd[:ELITES], bound)

        return bred

    for epoch in range(epochs):
        moved = state.withColumnRenamed("island", "origin").select(
            "cell", "origin", "key", "length", "elites",
            F.explode(F.array(F.col("origin"), F.pmod(F.col("origin") + 1, F.lit(islands))) if epoch and islands > 1
                      else F.array("origin")).alias("island"))
        state = materialise(moved.groupBy("cell", "island").applyInArrow(breeder(epoch), STATE))
    # One row per island and neighbourhood decides which island's packing is used.
    island = state.groupBy("cell").agg(F.min(F.struct("sequences", "island"))["island"].alias("island"))
    best = state.join(island, ["cell", "island"]).select("cell", "key", "length", F.col("elites")[0].alias("sequence"))
    return materialise(best.unionByName(done[0].select("cell", "key", "length", F.col("elites")[0].alias("sequence"))))


def _with_offsets(packed: DataFrame, number: int) -> DataFrame:
    """Adds `load` of each sequence and the piece's `offset` in it; a neighbourhood is bounded, so it is one group."""
    def offsets(group: pa.Table) -> pa.Table:
        group = group.take(np.lexsort((group["key"].to_numpy(), group["sequence"].to_numpy())))
        lengths, sequence = group["length"].to_numpy(), group["sequence"].to_numpy()
        before = np.cumsum(lengths) - lengths
        load = np.bincount(sequence, weights=lengths).astype(np.int64)
        first = np.concatenate([[True], sequence[1:] != sequence[:-1]])
        start = before[np.flatnonzero(first)[np.cumsum(first) - 1]]
        return pa.table({"key": group["key"], "length": group["length"], "load": load[sequence], "offset": before - start,
                         "sequence_id": (np.int64(number) << 58) + (group["cell"].to_numpy() << 20) + sequence})

    return packed.groupBy("cell").applyInArrow(offsets, "key long, length long, load long, offset long, sequence_id long")


def assign(pieces: DataFrame, capacity: int = CAPACITY, neighbourhood: int = NEIGHBOURHOOD, seed: int = 11,
           islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(key, sequence_id, offset) of all pieces; `pieces` has a unique `key` and a `length` of at most `capacity`."""
    full = pieces.where(F.col("length") >= capacity).select(
        "key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    closed, waiting = [full], pieces.where(F.col("length") < capacity).select("key", "length")
    left = waiting.count()
    for number in range(MAX_ROUNDS):
        if not left:
            break
        cells = max(1, round(left / neighbourhood))
        packed = materialise(_with_offsets(
            _round(waiting, cells, number, capacity, seed, islands, epochs, generations), number))
        roomy = F.col("load") < F.lit(int(capacity * (1 - SPARE)))
        still = packed.where(roomy).count()
        # Another round is of use while it brings together pieces of several neighbourhoods, and not all stay open.
        if cells == 1 or still > 0.7 * left or number == MAX_ROUNDS - 1:
            closed.append(packed.select("key", "sequence_id", "offset"))
            break
        closed.append(packed.where(~roomy).select("key", "sequence_id", "offset"))
        waiting, left = packed.where(roomy).select("key", "length"), still
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **settings) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece of every document."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json") if tokenizer is None else tokenizer
    pieces = cut_documents(docs, tokenizer, capacity)
    return pieces.join(assign(pieces, capacity, **settings), "key").drop("key")
