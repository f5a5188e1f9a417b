"""The stages of the pipeline on a small corpus, each against its own input; the registered queries."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline
from grainwise.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        result = spark.read.parquet(str(folder / name))
        out.append((name, docs, result))
        docs = result
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [name for name, *_ in stages] == ["language ID", "quality classifier", "MinHash near-dedup", "secret scans", "packing"]
    for _, docs, result in stages[:-1]:
        assert result.schema == docs.schema


def test_language_rejects_only_texts_without_letters(stages):
    _, docs, result = stages[0]
    assert result.count() == docs.filter(r"text rlike '\\p{L}'").count()


def test_quality_keeps_good_documents(spark, stages):
    _, docs, result = stages[1]
    kept = {r["doc_id"] for r in result.collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").join(docs, "doc_id").select("doc_id", "quality").collect()
    assert sum((r["doc_id"] in kept) == bool(r["quality"]) for r in labels) >= 0.97 * len(labels)


def test_one_of_each_group_stays(stages):
    _, docs, result = stages[2]
    component = brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in result.collect()} == {i for i, c in component.items() if i == c}


def test_secrets_are_masked(stages):
    _, docs, result = stages[3]
    texts = {r["doc_id"]: brute.masked(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in result.collect()} == texts


def test_every_document_is_packed(stages):
    _, docs, result = stages[4]
    packed = {r["doc_id"]: r for r in result.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()}
    assert set(packed) == {r["doc_id"] for r in docs.collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed.values())


def test_stages_on_an_empty_table_and_odd_rows(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "the of and to in", None, "s", None)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, columns)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, docs, SF_DIR)
            assert result.columns == docs.columns and result.count() <= len(given)
        assert corpus_pipeline.pack(spark, docs, SF_DIR).count() == len(given)


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    import oracle

    con = oracle.connect(SF_DIR)
    assert oracle.difference(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLE_SQL[name]) is None
    con.close()
