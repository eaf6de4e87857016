"""Tables in the shared folder."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from curves.functions.storage import remove, scratch, stored


def test_stored_tables_come_back_and_can_be_removed(spark):
    path = scratch(spark)
    df = stored(spark.range(10).selectExpr("id", "id * 2 AS twice", "CAST(NULL AS STRING) AS `a.b`"), path)
    assert df.columns == ["id", "twice", "a.b"] and sorted(r.twice for r in df.collect()) == list(range(0, 20, 2))
    assert Path(path.removeprefix("file:")).exists() and scratch(spark) != path
    remove(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_an_empty_table_keeps_its_schema(spark):
    df = stored(spark.range(0))
    assert df.columns == ["id"] and df.count() == 0
