"""Repair of the turn structure of conversations at least cost.

A sound conversation is an optional system turn followed by pairs of user and assistant turns. Rows are
kept (free), given another role (1), deleted (2; blank rows and repeats must be), or an empty row is
inserted (5); a truncated row that is not deleted costs 5 more. The lattice of a conversation has a node
for every number of rows read and every state of that grammar. Dijkstra's algorithm runs from both ends
at once: a forward heap from the start and a reverse heap from the two ends, the cheaper front first.
They meet; both go on until no crossing of the same cost can be missing; then the least audit among all
cheapest paths is read off, over the forward half and on into the reverse half. A state and an edit
decide the new role, so the audit alone says what the repaired conversation is.

Rows are ordered by turn (null first), rows of one turn by a digest of role and text. Spark looks at the
texts and sends only a few bytes per row, sorted, through the search; the texts join their edits
afterwards by the digest, since no two rows that stay are equal, and are hashed line by line. So a task
never holds the texts of a conversation, but some 300 bytes per row of one conversation at a time: its
audit and hash are one value each, made in order, and cannot be split.

A null role or text counts as one space, so a null text is blank and a null role is no legal turn. Null
conversation ids form one conversation. Only ASCII white space is white space. Repeated rows are
duplicates. Columns besides the four named ones are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import field
from ledgerlens.session import materialise

# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State -> state after the turn it waits for; a kept, reroled or inserted row goes there.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {USER: "u", ASSISTANT: "a"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = 1 << 60

BLANK, DUPLICATE, CUT = 1, 2, 3  # first fault of a row; 0 for none


class Lattice:
    """Edits of one conversation: the first letter of each row's role and its first fault.

    Node 4 * row + state: so many rows are read, and the grammar is in that state.
    """

    def __init__(self, initials: Sequence[str], faults: bytes):
        self.initials, self.faults, self.n = initials, faults, len(faults)

    def _row_edges(self, row: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, state after) of the edits that read `row` in `state`."""
        yield "D", DELETE, state
        if self.faults[row] not in (BLANK, DUPLICATE):
            extra = TRUNCATED if self.faults[row] == CUT else 0
            after = NEXT[state]
            if self.initials[row] == INITIAL[after]:
                yield "K", extra, after
            elif state == START and self.initials[row] == "s":
                yield "K", extra, SYSTEM
            yield "R", REROLE + extra, after

    def after(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next node) in the order of the edits' letters."""
        row, state = divmod(node, 4)
        edges = [("I", INSERT, row * 4 + NEXT[state])]
        if row < self.n:
            edges += [(edit, cost, row * 4 + 4 + to) for edit, cost, to in self._row_edges(row, state)]
        yield from sorted(edges)

    def before(self, node: int) -> Iterator[tuple[int, int]]:
        """(cost, previous node)."""
        row, state = divmod(node, 4)
        for origin in BEFORE.get(state, ()):
            yield INSERT, row * 4 + origin
        if row:
            for origin in range(4):
                for _, cost, to in self._row_edges(row - 1, origin):
                    if to == state:
                        yield cost, row * 4 - 4 + origin


def repair(lattice: Lattice) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost."""
    size = 4 * (lattice.n + 1)
    ahead, behind = array("q", [_FAR]) * size, array("q", [_FAR]) * size
    done_ahead, done_behind = bytearray(size), bytearray(size)
    goals = [lattice.n * 4 + state for state in ENDS]
    ahead[START] = 0
    forward, reverse = [(0, START)], [(0, goal) for goal in goals]
    for goal in goals:
        behind[goal] = 0
    least = min((ahead[g] + behind[g] for g in goals), default=_FAR)
    # A path not yet seen costs at least as much as both fronts together; equal ones still have to be finished.
    while forward and reverse and forward[0][0] + reverse[0][0] <= least:
        if forward[0][0] <= reverse[0][0]:
            cost, node = heapq.heappop(forward)
            if done_ahead[node]:
                continue
            done_ahead[node] = 1
            for _, step, to in lattice.after(node):
                if cost + step < ahead[to]:
                    ahead[to] = cost + step
                    heapq.heappush(forward, (cost + step, to))
                least = min(least, ahead[to] + behind[to])
        else:
            cost, node = heapq.heappop(reverse)
            if done_behind[node]:
                continue
            done_behind[node] = 1
            for step, origin in lattice.before(node):
                if cost + step < behind[origin]:
                    behind[origin] = cost + step
                    heapq.heappush(reverse, (cost + step, origin))
                least = min(least, ahead[origin] + behind[origin])
    return least, _least_audit(lattice, ahead, behind, least)


def _least_audit(lattice: Lattice, ahead: array, behind: array, least: int) -> str:
    """Reads the least audit off the two halves.

    A node is on a cheapest path if both halves reached it and their costs add up to the least (a crossing),
    or if a tight forward edge leads from it to such a node. From a node the smallest letter that stays on
    cheapest paths comes first; two paths to one node of equal cost never have audits that begin one another.
    """
    crossings = [node for node in range(len(ahead)) if ahead[node] + behind[node] == least]
    good, waiting = bytearray(len(ahead)), list(crossings)
    for node in crossings:
        good[node] = 1
    while waiting:  # back along tight forward edges
        node = waiting.pop()
        for step, origin in lattice.before(node):
            if not good[origin] and ahead[origin] + step == ahead[node]:
                good[origin] = 1
                waiting.append(origin)
    audit, node, spent = [], START, 0
    while node // 4 < lattice.n or node % 4 not in ENDS or spent < least:
        for edit, step, to in lattice.after(node):
            if spent + step + behind[to] == least or (good[to] and ahead[to] == spent + step):
                audit.append(edit)
                node, spent = to, spent + step
                break
        else:
            raise AssertionError("the halves do not meet")
    return "".join(audit)


def repaired_rows(lattice: Lattice, audit: str) -> Iterator[tuple[int | None, str | None]]:
    """(row number or None for an inserted row, new role or None for the row's own) of the repaired conversation."""
    row, state = 0, START
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "K" and state == START and lattice.initials[row] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
        yield (None if edit == "I" else row), (None if edit == "K" else ROLE[state])
        row += edit != "I"


def damage(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): rows damaged by a hash of conversation and turn.

    A row that the hash drops stays with `present` false, so that its conversation is not lost.
    """
    shown = lambda c: F.coalesce(field(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(shown(conv), F.lit(":"), shown(turn)), "UTF-8")) % 20
    rows = table.select(field(conv).alias("conv"), field(turn).alias("turn"), shown(role).alias("role"),
                        shown(text).alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _digested(rows: DataFrame) -> DataFrame:
    content = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.md5(content)))


def _marks(rows: DataFrame) -> DataFrame:
    """What the search needs of each row: no texts."""
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return rows.select(
        "conv", F.col("turn").cast("long").alias("turn"), "digest", "present", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.substring(body, -1, 1).isin(".", "!", "?").alias("ended"))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows of one conversation in sorted batches, one row at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda row: row["conv"])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(chunk, schema=schema)


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _searched(conv: object, rows: Iterator[dict]) -> Iterator[dict]:
    """The figures and audit of one conversation as line -1, then the lines of its repaired form."""
    initials, faults, digests, turns, seen = [], bytearray(), [], [], set()
    for row in rows:
        if not row["present"]:
            continue
        if row["turn"] is not None and (not turns or turns[-1] != row["turn"]):
            turns.append(row["turn"])
        faults.append(BLANK if row["blank"] else DUPLICATE if row["digest"] in seen else CUT if not row["ended"] else 0)
        initials.append(row["initial"])
        seen.add(row["digest"])
        digests.append(row["digest"])
    lattice = Lattice(initials, bytes(faults))
    cost, audit = repair(lattice)
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    yield {
        "conv": conv, "line": -1, "gaps": min(gaps, (1 << 63) - 1), "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit}
    for line, (row, role) in enumerate(repaired_rows(lattice, audit)):
        yield {"conv": conv, "line": line, "digest": None if row is None else digests[row], "role": role}


def _hashed(conv: object, lines: Iterator[dict]) -> dict:
    """The figures of one conversation with the hash of its repaired lines; a line that comes twice counts once."""
    stats, last, digest = next(lines), -1, hashlib.sha256()
    for line in lines:
        if line["line"] == last:
            continue
        if last >= 0:
            digest.update(b"\n")
        last = line["line"]
        role = line["role"] if line["role"] is not None else line["own_role"]
        digest.update(f"{role}:{line['text'] or ''}".encode())
    return {"conv": conv, **{n: stats[n] for n in STATS}, "audit": stats["audit"], "repaired_sha256": digest.hexdigest()}


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per `conv`: gaps, faults, cost, audit and the hash of the repaired conversation.

    `rows` has conv, turn, role and text without null roles and texts, and `present`; see `damage`.
    """
    rows = _digested(rows)
    key = rows.schema["conv"].dataType
    line = T.StructType([T.StructField("conv", key), T.StructField("line", T.LongType()),
                         *[T.StructField(n, T.LongType()) for n in STATS], T.StructField("audit", T.StringType()),
                         T.StructField("digest", T.BinaryType()), T.StructField("role", T.StringType())])
    result = T.StructType([*line.fields[:1], *line.fields[2:9], T.StructField("repaired_sha256", T.StringType())])
    line_arrow, result_arrow = to_arrow_schema(line), to_arrow_schema(result)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = itertools.chain.from_iterable(_searched(conv, own) for conv, own in _by_conversation(batches))
        return _batches(found, line_arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_hashed(conv, own) for conv, own in _by_conversation(batches)), result_arrow)

    lines = materialise(
        _marks(rows).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "digest")
        .mapInArrow(search, line))
    texts = rows.where("present").select(F.col("conv").alias("own_conv"), F.col("digest").alias("own_digest"),
                                         F.col("role").alias("own_role"), "text")
    same = F.col("conv").eqNullSafe(F.col("own_conv")) & (F.col("digest") == F.col("own_digest"))
    return (
        lines.join(texts, same, "left").drop("own_conv", "own_digest")
        .repartition("conv").sortWithinPartitions("conv", "line").mapInArrow(finish, result))
