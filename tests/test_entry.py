from __future__ import annotations

import __spark_entry__ as entry


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_is_in_rank_order(spark):
    rows = entry.workload.flagship(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["priority_rank"] for r in rows) == list(range(1, 101))
