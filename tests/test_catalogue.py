import pytest

import __spark_entry__ as entry
from stratum.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q in catalogue.ORACLE_SQL])
def test_agrees_with_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in catalogue.ORACLE_SQL])
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["snapshot_hash", "file_count", "total_bytes"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_are_pruned(spark, sf):
    plan = catalogue.QUERIES["q28_ancestor_dirs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].split(">")[0]
    assert "text" not in read and "n_chars" not in read
