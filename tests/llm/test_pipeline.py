import corpus_pipeline as cp
import __spark_entry__ as entry
from ledgerlens.llm import decontaminate, mixing
from ledgerlens.llm.common import DOCUMENT_COLUMNS
from ledgerlens.session import materialise
from tests.llm.conftest import ODD_ROWS, SF, documents
from tests.llm.test_near_duplicates import classes_by_pairs


def test_each_stage_on_what_the_one_before_kept(spark, docs):
    """Each stage is held against a plain calculation on its own input."""
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs.toPandas(), stage(spark, docs, SF)
        rows = docs.toPandas()
        docs = spark.createDataFrame(rows)
        kept[name] = (before, rows)
        if name != "sharding":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    before, rows = kept["language_id"]
    assert all(any(c.isalpha() for c in t) for t in rows.text)
    gone = before[~before.doc_id.isin(rows.doc_id)]
    assert (gone.n_chars < 40).all() and len(gone) < 0.03 * len(before)
    before, rows = kept["near_dedup"]
    classes = classes_by_pairs(list(zip(before.doc_id, before.text)))
    assert sorted(rows.doc_id) == sorted(set(classes.values()))
    before, rows = kept["decontamination"]
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i, t in zip(before.doc_id, before.text) if not any(x in decontaminate.normalise(t) for x in items)]
    assert sorted(rows.doc_id) == sorted(clean) and len(clean) < len(before)
    before, rows = kept["mixing"]
    mixed = mixing.mix_sources(spark.createDataFrame(before)).toPandas()
    assert sorted(rows.doc_id) == sorted(i for i, n in zip(mixed.doc_id, mixed.copies) for _ in range(n))
    before, rows = kept["sharding"]
    assert sorted(rows.doc_id) == sorted(before.doc_id)
    assert sorted(zip(rows.shard, rows.slot)) == sorted(
        (s, p) for s, n in rows.shard.value_counts().items() for p in range(n))


def test_the_whole_run_and_empty_and_odd_tables(spark, docs):
    assert entry.queries()["pipeline"] is cp.run
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    for table in (docs.where("false"), documents(spark, ODD_ROWS, ["extra", "shard"])):
        for _, stage in cp.STAGES:
            table = materialise(stage(spark, table, SF))
            assert set(DOCUMENT_COLUMNS) <= set(table.columns)
        assert table.columns == [*DOCUMENT_COLUMNS, "shard", "slot"]
