"""Every registered query of the analytics against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from casewright.plans.oracle import ORACLE
from casewright.plans.queries import QUERIES
from tests.conftest import SF, rows_of

#: Their work is covered with small inputs in the other modules.
SLOW = {"neardup_cohesion", "cohesion_bands"}


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
