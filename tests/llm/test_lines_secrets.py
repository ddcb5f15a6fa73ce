import re

import pandas as pd
import pytest

from check import compare
from ledgerlens.llm import lines, queries, secrets
from tests.llm.conftest import ODD_ROWS, SF, documents, oracle_rows, same_columns


def test_lines_match_the_sql(spark):
    got = queries.QUERIES["op2_line_dedup"](spark, SF).toPandas()
    assert compare(got, oracle_rows(queries.ORACLES["op2_line_dedup"])) == ""


def test_lines_match_the_sql_where_lines_repeat(spark):
    rows = []
    for i in range(60):
        site = "a" if i < 40 else "b" if i < 59 else None
        rows.append((i, "\n".join(["Menu", f"own {i}", "", "Menu"] + (["rare"] if i % 9 == 0 else []) + ["  "]), "en", site, 1))
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (101, "", "en", "a", 0), (102, "Menu", "en", "a", 4)]
    docs = documents(spark, rows)
    got = lines.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped").toPandas()
    assert compare(got, oracle_rows(queries.ORACLES["op2_line_dedup"], documents=docs.toPandas())) == ""
    by_id = got.set_index("doc_id")
    assert by_id.loc[1, "text"] == "own 1\n\n  " and by_id.loc[102, "text"] == "" and by_id.loc[59, "n_dropped"] == 0


def test_small_hosts_lose_their_menu(spark):
    """By hand: three pages of nine are boilerplate, two are not; one copied page of a host of two stays."""
    rows = [(i, f"Menu\nown {i}" + ("\nthrice" if i < 3 else "") + ("\ntwice" if i < 2 else ""), None, "nine", 1) for i in range(9)]
    rows += [(20 + i, "Menu\nsame page", None, "two", 1) for i in range(2)]
    rows += [(30 + i, f"Menu\npage {i % 2}", None, "four", 1) for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(documents(spark, rows)).collect()}
    assert got[0] == "own 0\ntwice" and got[2] == "own 2" and got[8] == "own 8"
    assert got[20] == got[21] == "Menu\nsame page" and got[30] == got[32] == "page 0"


def test_a_long_page_of_many_lines(spark):
    """A page of 200,000 lines next to pages that share some of them."""
    long = "\n".join(f"line {i}" for i in range(200_000))
    shared = "\n".join(f"line {i}" for i in range(300))
    rows = [(0, long, None, "a", 1)] + [(i, f"{shared}\nown {i}", None, "a", 1) for i in range(1, 30)]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in lines.drop_boilerplate(documents(spark, rows)).collect()}
    assert got[0][0] == got[1][0] == 300 and got[7][1] == "own 7" and got[0][1].startswith("line 300\nline 301\n")


def test_lines_of_odd_rows(odd, none):
    cut = lines.drop_boilerplate(odd)
    assert same_columns(odd, cut, ["text", "n_lines", "n_dropped"])
    rows = sorted((str(r["text"]), r["n_lines"]) for r in cut.select("text", "n_lines").collect())
    assert rows == sorted((str(t), 0 if t is None else t.count("\n") + 1) for _, t, *_ in ODD_ROWS)
    assert lines.drop_boilerplate(none).count() == 0


@pytest.fixture(scope="module")
def dictionary(docs):
    return secrets.frequent_words(docs)


@pytest.fixture(scope="module")
def forest(spark, dictionary):
    return secrets.train_forest(secrets.labelled_findings(spark, 2500, dictionary), dictionary, trees=20)


def test_candidates_equal_a_direct_search(docs):
    got = sorted((r["doc_id"], r["word_no"], r["candidate"]) for r in
                 secrets.candidates(docs).select("row.doc_id", "word_no", "candidate").collect())
    want = []
    for r in docs.collect():
        words = re.split(r"[\x20\x09-\x0D]+", r["text"])
        for i, w in enumerate(words):
            found = [x for x in re.findall(secrets.RUN, w) if re.search("[0-9]", x)]
            before = " ".join(words[max(0, i - 2):i]).lower()
            if not found and re.search(f"({secrets.SECRET_NAMES})\\S*\\s?[=:]\\s?$", before):
                found = re.findall(secrets.SHORT_RUN, w)
            want += [(r["doc_id"], i, x) for x in found]
    assert got == sorted(want) and got


def test_words_are_counted_over_all_texts(docs, dictionary):
    words = pd.Series([w for r in docs.collect() for w in re.split(r"[^\w]+|[\d_]+", r["text"].lower()) if re.fullmatch("[a-z]{3,12}", w)])
    counts = words.value_counts()
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:len(dictionary)]
    assert [w for w, _ in best] == dictionary


def test_forest_on_findings_it_has_not_seen(spark, dictionary):
    assert secrets.held_out_accuracy(secrets.labelled_findings(spark, 3000, dictionary), dictionary, trees=20) > 0.97


def test_keys_stay_and_card_numbers_go(docs, forest, dictionary):
    found = secrets.scan(docs, forest, dictionary).select("candidate", "is_secret").collect()
    for r in found:
        if re.fullmatch("[0-9]{16}", r["candidate"]):
            assert not r["is_secret"]
        if re.fullmatch("[0-9a-f]{40}", r["candidate"]):
            assert r["is_secret"]


def test_secrets_of_odd_rows(spark, odd, none, forest, dictionary):
    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    rows = ODD_ROWS + [(20, key, None, None, None), (20, key, None, None, None), (21, "password: hunter2hunter", "en", "a", 1)]
    found = secrets.scan(documents(spark, rows, ["candidate", "score", "row", "path"]), forest, dictionary)
    assert same_columns(documents(spark, [], ["candidate", "score", "row", "path"]), found, ["word_no", "candidate", "score", "is_secret"])
    rows = found.select("doc_id", "word_no", "candidate", "is_secret").collect()
    assert [(r["word_no"], r["is_secret"]) for r in rows if r["doc_id"] == 20] == [(2, True)] * 2
    assert [r["candidate"] for r in rows if r["doc_id"] == 21] == ["hunter2hunter"]
    assert secrets.scan(none, forest, dictionary).count() == 0
    assert secrets.frequent_words(none) == []


ASSIGNED = {
    'password="hunter2abc"': ["hunter2abc"], "pwd=hunter2abc": ["hunter2abc"], '{"password":"hunter2abc"}': ["hunter2abc"],
    'token="abcdefGHIJKLmnopQRST"': ["abcdefGHIJKLmnopQRST"], "DB_PASSWORD='hunter2abc';": ["hunter2abc"], "pwd:hunter2": [],
    "name=hunter2abc": [], '{\\"api_key\\":\\"hunter2abc\\"}': ["hunter2abc"], "x&token:hunter2abc&pwd=other3abc": ["hunter2abc", "other3abc"],
    'password ="hunter2abc"': ["hunter2abc"], "password => hunter2abc": [], "secret=>hunter2abc": ["hunter2abc"],
    '{"id":"0123456789abcdef12345678","pwd":"12345678"}': ["0123456789abcdef12345678", "12345678"],
    "MY_LONG_SECRET_TOKEN_2024:hunter2abc": ["MY_LONG_SECRET_TOKEN_2024", "hunter2abc"],
    'token="0123456789abcdef01"': ["0123456789abcdef01"], "token=0123456789abcdef01": ["token=0123456789abcdef01"],
    "password: hunter2abc": ["hunter2abc"], "password hunter2abc": [],
}


def values_in(text):
    """Values assigned to a telling name inside one word, found sign by sign without regular expressions."""
    names = ("token", "secret", "passw", "pwd", "api_key", "auth")
    found = []
    for word in text.split():
        for at, sign in enumerate(word):
            left, right = word[:at].rstrip("\\\"'"), word[at + 1:].lstrip(">").lstrip("\\\"'")
            size = next((n for n, c in enumerate(right) if not (c.isascii() and c.isalnum() or c in "+/_=@#$%!.-")), len(right))
            start = next((n for n in range(len(left), 0, -1) if not (left[n - 1].isalnum() or left[n - 1] in "_.-")), 0)
            if sign in "=:" and size >= 8 and any(n in left[start:].lower() for n in names):
                found.append(right[:size])
    return found


def test_secrets_assigned_inside_a_word_are_candidates(spark):
    texts = list(ASSIGNED)
    found = secrets.candidates(documents(spark, [(i, f"see the {t} of it", "en", "src/app.py", 1) for i, t in enumerate(texts)]))
    got = {t: [] for t in texts}
    for r in found.select("row.doc_id", "candidate").collect():
        got[texts[r["doc_id"]]].append(r["candidate"])
    assert {t: sorted(c) for t, c in got.items()} == {t: sorted(c) for t, c in ASSIGNED.items()}
    for t in texts:
        for value in values_in(t):
            assert any(c == value or c.endswith("=" + value) for c in got[t]), (t, value)
    assert sum(len(values_in(t)) for t in texts) >= 12
