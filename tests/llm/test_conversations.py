import hashlib
import random
import re
import zlib

import pytest

from ledgerlens.llm import conversations as cv
from tests.llm.conftest import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SOUND = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(initials, faults, roles=None, texts=None):
    """Every sequence of edits with at most three inserted rows in a place, and all sound ones compared."""
    n = len(initials)
    roles, texts = roles or [{"u": "user", "a": "assistant", "s": "system"}.get(i, i) for i in initials], texts or ["x"] * n
    found = {}

    def go(row, cost, audit, shape, lines, inserted):
        if (len(found) and cost > min(found)[0]) or not re.fullmatch(r"s?(ua)*u?", shape):
            return
        if row == n and SOUND.fullmatch(shape):
            found[cost, audit] = "\n".join(lines)
        if inserted < 3:
            for role in ("user", "assistant"):
                go(row, cost + 5, audit + "I", shape + role[0], [*lines, role + ":"], inserted + 1)
        if row == n:
            return
        go(row + 1, cost + 2, audit + "D", shape, lines, 0)
        if faults[row] not in (cv.BLANK, cv.DUPLICATE):
            extra = 5 if faults[row] == cv.CUT else 0
            go(row + 1, cost + extra, audit + "K", shape + (initials[row] or "?"), [*lines, f"{roles[row]}:{texts[row]}"], 0)
            for role in ("user", "assistant"):
                go(row + 1, cost + extra + 1, audit + "R", shape + role[0], [*lines, f"{role}:{texts[row]}"], 0)

    go(0, 0, "", "", [], 0)
    (cost, audit), text = min(found.items())
    return cost, audit, text


def test_least_audit_against_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(7)
        initials = [rng.choice("uuuaaas x") for _ in range(n)]
        faults = bytes(rng.choice([0, 0, 0, 0, cv.CUT, cv.BLANK, cv.DUPLICATE]) for _ in range(n))
        assert cv.repair(cv.Lattice(initials, faults)) == cheapest(initials, faults)[:2], (initials, faults)


def test_long_conversation_is_repaired():
    n = 60_000
    cost, audit = cv.repair(cv.Lattice(["u", "a"] * (n // 2) + ["a"], bytes(n + 1)))
    assert cost == 2 and len(audit) == n + 1 and audit.count("D") == 1 and audit.index("D") == n - 1


def plain(rows):
    """The whole job on Python lists."""
    convs = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        faults = bytearray()
        for i, (_, role, text) in enumerate(held):
            faults.append(cv.BLANK if not SEEN.search(text) else cv.DUPLICATE if (role, text) in [h[1:] for h in held[:i]]
                          else cv.CUT if text.rstrip(SPACE)[-1] not in ".!?" else 0)
        initials = [r[1][:1] for r in held]
        turns = {r[0] for r in held} - {None}
        cost, audit, text = cheapest(initials, faults, [r[1] for r in held], [r[2] for r in held])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def repaired(frame):
    got = cv.repair_conversations(cv.damage(frame))
    assert got.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = got.collect()
    assert len({r["conv"] for r in rows}) == len(rows)
    return {r["conv"]: tuple(r)[1:] for r in rows}


def test_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert repaired(table) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, "user", "Null turn."),
            (1, 0, None, "No role."), (1, 1, "user", None), (1, 2, "", "Empty role!"), (1, 3, "assistant", " \n\t\x0b"),
            (2, 5, "user", "Same turn?"), (2, 5, "user", "Same turn?"), (2, 5, "assistant", "Same turn."), (2, 9, "user", "gap"),
            (3, 0, "system", "S."), (3, 1, "user", "U. \r\n"), (3, 2, "assistant", "A.\xa0"), (3, 3, "assistant", "\xa0"),
            (4, None, "user", "All turns null."), (4, None, "assistant", "Yes."), (5, 0, "tool", "é" * 200_000 + "."),
            (-6, -3, "user", "Below."), (-6, 4, "assistant", "Above."), (7, 1, "user", "a\x00b."), (7, 2, "assistant", "x\ny!")]
    rows += [(100 + c, 0, "user", "One.") for c in range(60)]  # some of them lose their only row
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", line int, digest string, `a.b` string")
    want = plain(rows)
    assert repaired(table) == want and repaired(table.repartition(5)) == want
    gone = [w for c, w in want.items() if c is not None and c >= 100 and w[6] == ""]
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in gone
    assert repaired(table.where("false")) == {}


@pytest.mark.parametrize("copies", [3000])
def test_one_long_conversation_among_short_ones(spark, copies):
    rows = [(1, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"Turn {t}.") for t in range(copies)]
    table = spark.createDataFrame(rows + [(2, t, r, "Ok.") for t, r in enumerate(("user", "assistant"))], SCHEMA)
    got = repaired(table)
    assert set(got) == {1, 2} and len(got[1][6].replace("I", "")) >= copies * 0.9 and got[1][5] > 0
