"""The operators' queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from curves.llm.queries import ORACLES, QUERIES
from tests.compare import DATA, assert_same, connection
from tests.llm.data import ODD, documents, prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLES[name], connection())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_input(spark, name):
    table = "pages" if name.startswith("op9_") else "documents"
    n = QUERIES[name](spark, DATA).count()
    assert n > 0 if name.startswith("op5_") else n == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_stages_filter_and_keep_columns(spark, tmp_path):
    texts = [*ODD, *(prose(i, 60) for i in range(5)), prose(3, 60), prose(4, 60) + " more", "A!! B!! C!! D!! E!!"]
    docs = documents(spark, texts)
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert counts[:4] == [18, 7, 6, 5]  # eleven short or blank rows and the marks go; one equal text; one text with a word more
    assert docs.columns == ["bin_id", "capacity", "n_tokens", "doc_ids", "starts", "lengths"]


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
