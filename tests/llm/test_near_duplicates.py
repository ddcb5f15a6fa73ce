from collections import Counter

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import dartminhash as dm
from ledgerlens.llm.components import components
from tests.llm.conftest import ODD_ROWS, documents, same_columns


def bag(text):
    w = text.replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes_by_pairs(rows):
    """Smallest id of each component of equal or similar texts, by going through all pairs."""
    rows = [(i, t) for i, t in rows if t is not None]
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or similarity(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: least[find(a)] for a, (i, _) in enumerate(rows)}


def test_word_and_shingle_hashes_follow_the_words():
    powers = dm._Powers(dm._SLICE)
    text = "a bb  ccc\tdd\ne f été a bb ccc dd e"
    words = text.replace("\t", " ").replace("\n", " ").split()
    hashes = dm.word_hashes(text.encode(), powers)
    assert len(hashes) == len(words) and len(set(hashes)) == len(set(words))
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))
    ids, counts = dm.shingles(text.encode(), powers)
    assert sorted(counts) == sorted(bag(text).values()) and len(ids) == len(bag(text))
    assert len(dm.occurrences(text.encode(), powers)) == sum(bag(text).values())
    long = ("word " * 300_000 + "x" * 1_200_000 + " end").encode()
    assert len(dm.word_hashes(long, powers)) in (300_002, 300_003)
    assert len(dm.shingles(b"", powers)[0]) == len(dm.shingles(b" \n", powers)[0]) == 0


@pytest.mark.parametrize("weights", ["counts", "reals", "large"])
def test_agreement_is_the_weighted_similarity(weights):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a = {"counts": rng.integers(1, 6, 60), "reals": rng.uniform(0.01, 3, 60), "large": rng.uniform(100, 9000, 60)}[weights]
    b = a * rng.uniform(0.6, 1.3, 60) if weights != "counts" else np.maximum(1, a + rng.integers(-2, 3, 60))
    signed = dm.signatures(np.concatenate([ids, ids]), np.concatenate([a, b]), [60, 60], 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2000)


def test_a_signature_does_not_depend_on_the_texts_beside_it():
    powers = dm._Powers(dm._SLICE)
    parts = [dm.shingles(t, powers) for t in (b"one two three four five six seven", b"", b"x", b"a b c d e f g h i j k l")]
    ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    together = dm.signatures(ids, counts, [len(p[0]) for p in parts], 64)
    alone = np.concatenate([dm.signatures(p[0], p[1], [len(p[0])], 64) for p in parts])
    assert (together == alone).all() and (together[1] == 0).all() and (together[[0, 2, 3]] != 0).all()


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 580)] + [(1, 2), (2, 3), (3, 1), (7, 7)]
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r["vertex"]: r["label"] for r in found.collect()}
    assert found.count() == len(got)
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 580)}, **{i: 1 for i in (1, 2, 3)}}


def near_copies(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(*changes)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for size, n, changes in ((150, 60, (0, 6)), (400, 25, (1, 14)), (30, 10, (0, 1)), (90, 5, (8, 12))):
        texts += near_copies(rng, [rng.choice(vocabulary) for _ in range(size)], n, changes)
    drifting = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(25):  # each near the one before it, the ends far apart
        drifting[rng.randrange(200)] = f"w{rng.randrange(10 ** 6)}"
        drifting[rng.randrange(200)] = f"w{rng.randrange(10 ** 6)}"
        texts.append(" ".join(drifting))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["a b", "a  b", "a b c", "same line\n" * 50, "same line\n" * 45, "same line\n" * 20] + texts[:20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()}
    want = classes_by_pairs(rows)
    different = [i for i in got if got[i] != want[i]]
    # A pair at just 0.8 shares no band with a probability of 0.0006.
    assert len(got) == len(rows) and len(different) <= 1, different


def test_classes_of_odd_rows(odd, none):
    found = dm.near_duplicates(odd)
    assert same_columns(odd, found, ["class_id"])
    rows = [(r["doc_id"], r["text"], r["class_id"]) for r in found.select("doc_id", "text", "class_id").collect()]
    assert len(rows) == len(ODD_ROWS)
    want = classes_by_pairs([(10 ** 9 if i is None else i, t) for i, t, *_ in ODD_ROWS])
    assert all(c == (i if t is None else want[10 ** 9 if i is None else i]) for i, t, c in rows)
    kept = dm.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted(["-11", "1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    assert dm.near_duplicates(none).count() == dm.keep_one(none).count() == 0


def test_scripts_without_spaces(spark):
    """Two Chinese texts of 3,000 characters that differ in one are alike, against all pairs of character shingles."""
    rng = np.random.default_rng(12)
    han = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 3000))
    other = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 3000))
    thai = "".join(chr(0x0E01 + int(c)) for c in rng.integers(0, 40, 900))
    texts = [han, han[:1500] + "\u3042" + han[1501:], han[1:], other, thai, thai[:450] + thai[451:], "x" + han, han[:1000] + " " + han[1000:]]

    def weights(text):
        chars = [c for c in text if c != " "]
        return Counter(tuple(chars[i:i + 5]) for i in range(len(chars) - 4))

    held = [weights(t) for t in texts]
    alike = [[sum((a & b).values()) >= 0.8 * sum((a | b).values()) for b in held] for a in held]
    want = [min(j for j, x in enumerate(row) if x) for row in alike]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want == [0, 0, 0, 3, 4, 4, 0, 0]


def test_words_of_mixed_scripts():
    powers = dm._Powers(1 << 10)
    count = lambda t: len(dm.word_hashes(t.encode(), powers))
    assert count("abc 漢字かな x") == 6 and count("ab漢c d") == 4 and count("漢") == 1 and count("é “quoted” 🙂") == 3
    same = lambda a, b: (dm.word_hashes(a.encode(), powers) == dm.word_hashes(b.encode(), powers)).all()
    assert same("ab漢c d", "ab 漢 c d") and same("漢字\n", " 漢 字") and same("ไทย x", "ไ ท ย x")
