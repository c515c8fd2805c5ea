"""Every registered query of the reference's operators against its SQL, and determinism over partitionings."""

from __future__ import annotations

import pytest

import oracle
from srcatlas import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    assert name in queries.ORACLE_SQL
    assert oracle.compare(spark, name, SF, queries.queries(), queries.oracle_sql()) == ""


@pytest.mark.parametrize("name", ["import_fixpoint", "symbol_at_narrowest", "container_path", "textual_scope_asof", "visible_dependency_closure"])
def test_partitions_do_not_matter(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = queries.QUERIES[name](spark, SF)
        return oracle.rows(df.columns, df.collect())

    try:
        assert run(1) == run(13)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
