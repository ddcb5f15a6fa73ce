import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

CLASHING = ["row", "score", "lang_pred", "shard", "slot", "bucket", "key", "class_id", "hits", "Size", "copies", "target",
            "n_lines", "words", "answer", "predicted", "candidate", "a.b"]
BASE = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def documents(spark, rows, extra=()):
    schema = ", ".join([f"`{n}` {t}" for n, t in BASE] + [f"`{n}` string" for n in extra])
    return spark.createDataFrame([tuple(r) + ("x",) * len(extra) for r in rows], schema)


PROSE = "the quick brown fox jumps over the lazy dog while nine old men watch from the far bank of the river and say nothing"

ODD_ROWS = [
    (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE, None, None, None), (None, PROSE, "en", "a", 1),
    (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4),
    (6, "1234 !!", "de", "b", 7), (7, "word", None, "b", 4), (8, (PROSE + "\n") * 2000, "en", "a", 230_000),
    (9, "ein anderer text mit ganz anderen wörtern über die straße und das große haus am see ßß", "de", "c", 80),
    (10, "x" * 300_000, "de", "c", 300_000), (-11, "\x00 odd � bytes \U0001f600", "de", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash."""
    return documents(spark, ODD_ROWS, CLASHING)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_columns(before, after, added):
    """`after` has the columns of `before` and those added; an added name took the place of an old one."""
    new = {a.lower() for a in added}
    return [c for c in before.columns if c.lower() not in new] + list(added) == after.columns


def oracle_rows(sql, sf=SF, **tables):
    import duckdb
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    if not tables:
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    return con.execute(sql).df()


SCHEMA_OF_DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                                    T.StructField("n_chars", T.LongType())])
