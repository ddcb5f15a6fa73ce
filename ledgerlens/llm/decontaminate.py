"""Benchmark items in documents, found with a bounded number of edits.

An item of m characters may differ by k = `rate` * m edits (inserted, deleted or changed characters)
from a stretch of the document. Cut into k + 1 pieces, at least one piece must then appear unchanged;
pieces are searched for by their first eight bytes at every position of the text, and each hit is
verified with Myers' bit-parallel distance over the stretch around it. The pigeonhole holds for every
halving of the pieces too: of two neighbouring runs with i and j pieces, one must appear with under i
or under j edits. So a hit is verified over the two or three pieces around it first, then over twice
as many, and so on; chance hits end at the first step. Pieces keep at least eight characters, which
lowers k for short items; items of under eight characters must appear unchanged.

Both sides are compared in lower case with white space runs as one space. Null and empty texts match
nothing and are matched by nothing. Repeated rows match alike; ties in distance go to the first
stretch. Items are sent to the tasks in blocks of bounded size. A pass over the documents takes a
bounded number of blocks, so what is held at once does not grow with the benchmark; a benchmark of
more blocks takes more passes, whose hits are added up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import as_row, field, unpack
from ledgerlens.session import materialise

RATE = 0.1
PIECE = 8
BLOCK_BYTES = 16 << 20
BLOCKS = 4  # met in one pass over the documents
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20

HITS = "array<struct<item_id:bigint,distance:int,budget:int,match_start:int,match_end:int>>"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of so many characters; short items have short pieces, which are indexed as they are."""
    return min(int(rate * length), max(0, length - 1))


def runs_around(piece: int, n: int) -> list[tuple[int, int]]:
    """The runs of pieces that halving all n pieces again and again leaves around one, smallest first."""
    a, b, found = 0, n, []
    while b - a > 1:
        found.append((a, b))
        middle = (a + b) // 2
        a, b = (a, middle) if piece < middle else (middle, b)
    return found[::-1]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def nearest(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern to a stretch of `text`, and the first end of such a stretch.

    Myers' algorithm; one column of the distance table is two integers of m bits. `anchored`: the
    stretch must start at the start of the text.
    """
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, end = m, 0
    step = 1 if anchored else 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        vertical = e | down
        across = (((e & up) + up) ^ up) | e
        more = down | full & ~(across | up)
        less = up & across
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more = more << 1 | step
        up = (less << 1 | ~(vertical | more)) & full
        down = more & vertical & full
        if score < best:
            best, end = score, j
    return best, end


class Item:
    """A benchmark item, cut into `budget` + 1 pieces whose lengths differ by one at most."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text = item_id, text
        self.budget = budget(len(text), rate)
        n = self.budget + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.runs = [runs_around(i, n) for i in range(n)]
        self.beside = [self._halves_beside(i) for i in range(n)]
        self._masks: dict[tuple[int, int], dict[str, int]] = {}

    def _halves_beside(self, piece: int) -> list[tuple[int, str]]:
        """(offset from the piece, text) of the halves of the other pieces in the smallest run."""
        found = []
        for a, b in self.runs[piece][:1]:
            for other in range(a, b):
                low, high = self.cuts[other], self.cuts[other + 1]
                middle = (low + high) // 2
                if other != piece:
                    found += [(low - self.cuts[piece], self.text[low:middle]), (middle - self.cuts[piece], self.text[middle:high])]
        return found

    def run_masks(self, a: int, b: int) -> dict[str, int]:
        if (a, b) not in self._masks:
            self._masks[a, b] = masks(self.text[self.cuts[a]:self.cuts[b]])
        return self._masks[a, b]

    def may_hold(self, text: str, at: int, piece: int) -> bool:
        """Whether the runs around a piece that appears at `at` appear too, each with fewer edits than pieces."""
        # e edits leave e + 2 of the 2e + 2 half pieces of a run as they are, so e of those beside the hit.
        halves, needed = self.beside[piece], len(self.beside[piece]) // 2
        whole = sum(text.find(half, max(0, at + offset - needed), max(0, at + offset + len(half) + needed)) >= 0
                    for offset, half in halves)
        if whole < needed:
            return False
        for a, b in self.runs[piece][:-1]:
            slack, size = b - a - 1, self.cuts[b] - self.cuts[a]
            start = at - self.cuts[piece] + self.cuts[a]
            part = text[max(0, start - slack):max(0, start + size + slack)]
            if len(part) < size - slack or nearest(self.run_masks(a, b), size, part)[0] > slack:
                return False
        return True


class Matcher:
    """The items of one block, with an index of their pieces by leading bytes."""

    def __init__(self, rows: Sequence[tuple[int, str]], rate: float):
        self.items: list[Item] = []
        anchors: dict[int, list[tuple[int, bytes, int, int]]] = {}  # number of leading bytes -> pieces
        for item_id, raw in rows:
            text = normalise(raw)
            if not text:
                continue
            item = Item(item_id, text, rate)
            for i, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                data = text[a:b].encode("utf-8", "replace")
                lead = min(PIECE, len(data))
                value = int.from_bytes(data[:lead], "little")
                anchors.setdefault(lead, []).append((value, data, len(self.items), i))
            self.items.append(item)
        self.tables = []
        for lead, found in anchors.items():
            found.sort(key=lambda x: x[0])
            keys = np.array([x[0] for x in found], np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[self._slot(keys)] = True
            self.tables.append((lead, keys, seen, found))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - _BITS)).astype(np.int64)

    def anchors(self, data: bytes):
        """(byte position, item, piece) of every piece that appears in `data`."""
        padded = np.frombuffer(data + bytes(PIECE), np.uint8)
        for lead, keys, seen, found in self.tables:
            keep = np.uint64((1 << 8 * lead) - 1 if lead < 8 else 0xFFFFFFFFFFFFFFFF)
            for first in range(0, len(data), _CHUNK):
                n = min(_CHUNK, len(data) - first)
                at = np.ndarray((n,), "<u8", padded, first, (1,)).copy()
                if lead < 8:
                    at &= keep
                place = np.flatnonzero(seen[self._slot(at)])
                if not len(place):
                    continue
                value = at[place]
                low = np.searchsorted(keys, value, "left")
                high = np.searchsorted(keys, value, "right")
                for i in np.flatnonzero(high > low):
                    p = first + int(place[i])
                    for _, piece, item, number in found[low[i]:high[i]]:
                        if len(piece) <= PIECE or data.startswith(piece, p):
                            yield p, item, number

    def search(self, texts: Sequence[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text its matches (item_id, distance, budget, start, end), one per item."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        ready = [normalise(t) for t in texts]
        at = 0
        while at < len(ready):
            parts, starts, size = [], [], 0
            first = at
            while at < len(ready) and (not parts or size < 4 << 20):
                data = ready[at].encode("utf-8", "replace")
                starts.append(size)
                parts.append(data)
                size += len(data) + 1
                at += 1
            places: dict[int, dict[int, list[tuple[int, int]]]] = {}
            for p, item, piece in self.anchors(b"\n".join(parts)):
                d = bisect_right(starts, p) - 1
                places.setdefault(d, {}).setdefault(item, []).append((p - starts[d], piece))
            for d, by_item in places.items():
                out[first + d] = self._verified(ready[first + d], parts[d], by_item)
        return out

    def _verified(self, text: str, data: bytes, by_item: dict[int, list[tuple[int, int]]]):
        chars = None
        if len(data) != len(text):
            chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # character at each byte
        found = []
        for number, hits in sorted(by_item.items()):
            item = self.items[number]
            m, k = len(item.text), item.budget
            exact = text.find(item.text)
            if exact >= 0:
                found.append((item.item_id, 0, k, exact, exact + m))
                continue
            at = [(int(chars[p]) if chars is not None else p, piece) for p, piece in hits]
            spans: list[list[int]] = []
            for start, p, piece in sorted((p - item.cuts[piece], p, piece) for p, piece in at):
                low, high = max(0, start - k), min(len(text), start + m + k)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                elif item.may_hold(text, p, piece):
                    spans.append([low, high])
            best = (k + 1, 0, 0)
            for low, high in spans:
                distance, end = nearest(item.run_masks(0, k + 1), m, text[low:high])
                if distance < best[0]:
                    best = (distance, low, low + end)
            if best[0] <= k:
                distance, low, end = best
                back = text[max(low, end - m - k):end][::-1]
                _, length = nearest(masks(item.text[::-1]), m, back, anchored=True)
                found.append((item.item_id, distance, k, end - length, end))
        return found


def _passes(benchmark: DataFrame, block_bytes: int, blocks: int) -> Iterator[list[list[tuple[int, str]]]]:
    """The items in blocks of about `block_bytes` by a hash of the item, `blocks` of them at a time."""
    items = benchmark.select(field("item_id").cast("long").alias("item_id"), field("text").alias("text")) \
        .where("text is not null").distinct()
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-volume // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    if n > 1:
        items = materialise(items)
    for first in range(0, n, blocks):
        yield [sorted(((r["item_id"], r["text"]) for r in items.where(F.col("block") == i).collect()),
                      key=lambda r: (r[0] is None, r[0], r[1])) for i in range(first, min(first + blocks, n))]


def _searcher(shared, rate: float):
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        names = ("item_id", "distance", "budget", "match_start", "match_end")
        for texts in batches:
            found = matcher.search([t if t is not None else "" for t in texts])
            yield pd.Series([[dict(zip(names, h)) for h in hits] for hits in found])

    return search


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES,
               blocks: int = BLOCKS) -> DataFrame:
    """All rows and columns of `docs` with `hits`, an array of matches (a column of that name is replaced).

    Of several rows with one item_id each text counts; the hits then repeat the id. A further pass,
    needed above `blocks` * `block_bytes` of items, starts from a written table of the rows and hits so far.
    """
    context = docs.sparkSession.sparkContext
    marked, shared = None, []
    for rows in _passes(benchmark, block_bytes, blocks):
        if marked is not None:
            marked = materialise(marked)
            for s in shared:
                s.unpersist()
        shared = [context.broadcast(r) for r in rows]
        text = field("text") if marked is None else F.col("row").getField("text")
        # Marked as not repeatable, or a filter on the hits would run the search a second time.
        parts = [_searcher(s, rate).asNondeterministic()(text) for s in shared]
        if marked is not None:
            parts.insert(0, F.col("hits"))
        hits = F.concat(*parts) if len(parts) > 1 else parts[0]
        marked = (docs.select(as_row(docs), hits.alias("hits")) if marked is None else marked.select("row", hits.alias("hits")))
    return unpack(marked, docs.columns, {"hits": F.col("hits")})


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows in which no item was found."""
    marked = docs.select(as_row(docs, "whole"), field("text").alias("text"))
    return unpack(find_items(marked, benchmark, rate).where(F.size("hits") == 0), docs.columns, {}, "whole")


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document row and item found in it, with the distance and the stretch of the normalised text."""
    found = find_items(docs.select(field("doc_id").alias("doc_id"), field("text").alias("text")), benchmark, rate)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
