"""The pipeline against its stages in plain Python."""

import duckdb
import pytest

import corpus_pipeline
from test_decontaminate import expected as decontaminated
from test_neardup import classes
from test_per_document import features
from tidewater.llm import quality
from tidewater.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns, the table of documents first."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    assert stages[5].columns == [*stages[0].columns, "mix_copy"]


def test_quality_stage(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    kept = {r["doc_id"] for r in quality.judged(stages[0]).filter("q_kept").collect()}
    assert after == {i: t for i, t in before.items() if i in kept}
    assert not any(features(t)[-1] for t in after.values())


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    want = classes(list(before.items()))
    assert rows(stages[2]) == {i: t for i, t in before.items() if want[i] == i}


def test_decontamination_stage(sf, stages):
    before = rows(stages[2])
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in decontaminated(list(before.items()), items) if r[-1]}
    assert rows(stages[3]) == {i: t for i, t in before.items() if i not in bad}


def test_personal_data_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys() and 0 < sum(before[i] != after[i] for i in before) < len(before) / 2


def test_mix_and_run(spark, sf, stages):
    mixed = stages[5].collect()
    assert {r["doc_id"] for r in mixed} <= rows(stages[4]).keys()
    count = lambda df: sorted((r["doc_id"], r["mix_copy"], r["text"]) for r in df.collect())
    assert count(corpus_pipeline.run(spark, sf)) == count(stages[5])
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, sf, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/none/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_edge_rows_through_each_stage(spark, sf, edge_rows):
    """Nulls in every column, a very long text, repeated rows and columns with names of the operators' results."""
    long = " ".join(f"word{i * i % 9973}" for i in range(40_000))
    given = [*edge_rows, (20, long, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    clash = {"kept": "'x'", "size": "1", "rank": "2", "class_id": "3", "spans": "'s'", "item_id": "4"}
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{v} as {k}" for k, v in clash.items()]).repartition(3)
    key = lambda r: str((r["doc_id"], r["lang"], r["source"], r["n_chars"], *[r[c] for c in clash]))
    before = [key(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == [*docs.columns, *(["mix_copy"] if name == "mixing" else [])], name
        after = [key(r) for r in out.collect()]
        assert set(after) <= set(before), name
        if name == "personal data":
            assert sorted(after) == sorted(before)
        if name in ("near duplicates", "decontamination"):
            assert any(r.startswith("(20,") for r in after) and sum(r.startswith("(None, None") for r in after) == 2
