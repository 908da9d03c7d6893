"""One small session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").appName("tests").config(map={
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame with sorted columns, comparable across engines."""
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 7) + 0.0
        return v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks that a query and its SQL give the same columns and rows."""
    def check(query, sql: str) -> None:
        got, expected = query(spark, SMALL).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        a, b = rows_of(got), rows_of(expected)
        assert len(a) == len(b)
        assert [(repr(x), repr(y)) for x, y in zip(a, b) if x != y][:3] == []

    return check
