"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def same_rows(found, expected) -> None:
    """Compare two pandas frames without regard to order."""
    found, expected = found[sorted(found.columns)], expected[sorted(expected.columns)]
    assert list(found.columns) == list(expected.columns)
    keys = list(found.columns)
    found, expected = found.sort_values(keys, ignore_index=True), expected.sort_values(keys, ignore_index=True)
    assert len(found) == len(expected)
    for c in keys:
        differs = (found[c] != expected[c]) & ~(found[c].isna() & expected[c].isna())
        assert not differs.any(), (c, found[differs].head(3), expected[differs].head(3))


def duck(sql: str, sf_dir: str = SF):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql).to_arrow_table().to_pandas()
