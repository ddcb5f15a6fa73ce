import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate as dc
from tests.llm.conftest import ODD_ROWS, SF, documents, same_columns


def nearest_by_table(pattern, text):
    """Least distance of `pattern` to a stretch of `text`, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_distance_equals_the_whole_table(pattern, text):
    got = dc.nearest(dc.masks(pattern), len(pattern), text)
    want = nearest_by_table(pattern, text)
    assert got[0] == want[0]
    if want[0] < len(pattern):
        assert got[1] == want[1]


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("abcdefghijklmnop")
        elif kind == 1:
            chars.insert(i, rng.choice("abcdefghijklmnop"))
        else:
            del chars[i]
    return "".join(chars)


def test_matches_equal_a_search_of_every_item_in_every_text():
    rng = random.Random(4)
    words = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
             for n in [1, 2, 4, 6, 10, 20, 40, 60] for _ in range(6)]
    items = [(i, w) for i, w in enumerate(words)]
    filler = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    texts = [filler(40) for _ in range(20)]
    for i, w in items:
        for edits in (0, 1, len(w) // 20, len(w) // 10, len(w) // 8):
            texts.append(f"{filler(rng.randint(0, 9))} {edited(w, edits, rng)} {filler(rng.randint(0, 9))}")
    matcher = dc.Matcher(items, 0.1)
    found = matcher.search(texts)
    for text, hits in zip(texts, found):
        clean = dc.normalise(text)
        got = {h[0]: h for h in hits}
        for item in matcher.items:
            distance, _ = nearest_by_table(item.text, clean)
            assert (distance <= item.budget) == (item.item_id in got), (item.text, clean)
            if item.item_id in got:
                _, d, k, start, end = got[item.item_id]
                assert d == distance and k == item.budget
                assert nearest_by_table(item.text, clean[start:end])[0] == d


def test_short_items_are_found_with_a_tenth_of_edits(spark):
    """Items of 10 to 47 characters, with every number of edits, against the whole distance table."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n * 10 + i, "".join(rng.choice(letters) for _ in range(n))) for n in (1, 9, 10, 15, 20, 23, 30, 31, 39, 40, 47) for i in range(4)]
    texts = []
    for _, item in items:
        for edits in range(len(item) // 10 + 2):
            texts += [f"{''.join(rng.choice(letters) for _ in range(30))}{edited(item, edits, rng)}{''.join(rng.choice(letters) for _ in range(30))}"
                      for _ in range(4)]
    matcher = dc.Matcher(items, 0.1)
    assert [i.budget for i in matcher.items] == [len(t) // 10 for _, t in items]
    for text, hits in zip(texts, matcher.search(texts)):
        want = {i for i, item in items if nearest_by_table(item, text)[0] <= len(item) // 10}
        assert {h[0] for h in hits} == want


def test_every_item_planted_in_the_documents_is_found(spark, docs):
    items = {r["item_id"]: dc.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in dc.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = {r["doc_id"]: dc.normalise(r["text"]) for r in docs.collect()}
    exact = {(d, i) for d, t in rows.items() for i, x in items.items() if x in t}
    assert exact and exact == {k for k, r in got.items() if r["distance"] == 0}
    for (d, i), r in got.items():
        assert nearest_by_table(items[i], rows[d][r["match_start"]:r["match_end"]])[0] == r["distance"] <= r["budget"]


def test_blocks_of_items_give_the_same_matches(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = dc.find_items(docs, benchmark).select("doc_id", F.explode("hits.item_id").alias("i")).collect()
    many = dc.find_items(docs, benchmark, block_bytes=2000).select("doc_id", F.explode("hits.item_id").alias("i")).collect()
    assert sorted(one) == sorted(many) and one
    passes = list(dc._passes(benchmark, 2000, 2))
    assert len(passes) > 1 and max(map(len, passes)) == 2
    repeated = dc.find_items(docs, benchmark, block_bytes=2000, blocks=2)
    assert sorted(repeated.select("doc_id", F.explode("hits.item_id").alias("i")).collect()) == sorted(one)
    assert repeated.count() == docs.count()


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "jumps over the lazy dog while nine"), (2, None), (3, ""), (4, "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"),
                                   (4, "große haus am see"), (None, "watch from the far bank"), (5, "word")], "item_id bigint, text string")
    found = dc.find_items(odd, items)
    assert same_columns(odd, found, ["hits"])
    rows = {}
    for r in found.select("doc_id", "text", "hits").collect():
        rows.setdefault(r["doc_id"], []).append(sorted(str(h["item_id"]) for h in r["hits"]))
    assert rows[1] == [["1", "None"]] * 2 and rows[8] == [["1", "None"]] and rows[9] == [["4"]] and rows[10] == [["4"]]
    assert rows[7] == [["5"]] and rows[3] == rows[4] == rows[5] == rows[6] == [[]]
    kept = dc.clean(odd, items)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not any(str(i) in "12789" or i == 10 for i in [r[0]]) and r[0] is not None for r in ODD_ROWS) + 1
    assert dc.leaks(none, items).count() == 0
    assert dc.leaks(odd, items.where("false")).count() == 0
    assert dc.clean(documents(spark, ODD_ROWS), items.where("text = ''")).count() == len(ODD_ROWS)
