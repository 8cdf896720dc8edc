"""Every query with an SQL form agrees with it."""

from __future__ import annotations

import pytest
from conftest import duck, same_rows

from plumbline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    same_rows(found, duck(registry.ORACLES[name], sf_dir))


def test_golden_totals(spark, sf_dir):
    rows = registry.QUERIES["detection_prf_by_label"](spark, sf_dir).toPandas()
    assert (rows.tp.sum(), rows.fp.sum(), rows.fn.sum()) == (4659, 139, 1341)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).collect()) == 3
