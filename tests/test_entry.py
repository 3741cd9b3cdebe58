"""Driver contract: entry runs, every oracle has a query, columns line up."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["src_id", "technique", "copy_no", "text", "label", "is_original"]


def test_oracle_keys_subset_of_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
