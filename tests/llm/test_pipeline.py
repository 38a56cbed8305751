"""The pipeline's stages against plain versions, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from plumbline.llm import quality
from plumbline.llm.queries import ORACLE, QUERIES
from tests.llm import corpus
from tests.oracle import compare, connect


def test_each_operator_has_a_query():
    names = set(E.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, key):
    assert compare(spark, connect(sf_dir), sf_dir, key) == []


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall()
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        results[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    read = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    before, after = results["quality"]
    predicted = {r["doc_id"]: r["predicted"] for r in quality.score(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {i for i, _ in read(after)} == {i for i, p in predicted.items() if p == 1}
    assert sum(predicted[i] == q for i, q in labels) > 0.95 * len(labels)

    before, after = results["lines"]
    gone = corpus.dropped_lines(read(before))
    want = {}
    for i, t in read(before):
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if ((True, i, k), x) not in gone]
        if any(x.strip() for x in left) or not any(x.strip() for x in lines):
            want[i] = "\n".join(left)
    assert dict(read(after)) == want

    before, after = results["near_copies"]
    found = corpus.near_components(read(before))
    assert sorted(i for i, _ in read(after)) == sorted({c for _, c in found.values()})

    before, after = results["mixing"]
    assert {i for i, _ in read(after)} == {i for i, _ in read(before)} and after.count() >= before.count()

    before, after = results["packing"]
    totals = {r["doc_id"]: r["sum(length)"] for r in after.groupBy("doc_id").sum("length").collect()}
    assert set(totals) == {i for i, _ in read(before)}
