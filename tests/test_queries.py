"""Each query against its SQL in DuckDB on the smallest tables."""

import compare
import pytest

from tidemark import queries_audit, queries_boards, queries_cards, queries_domain, queries_events, queries_fuller, queries_functions, queries_names, queries_passes, queries_ranks, queries_relational, queries_store, queries_writes  # noqa: F401  register more
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = compare.rows_of(df)
    assert sum(got.values()) >= 0
    if name in ORACLE_SQL:
        names, want = compare.sql_rows(SF, ORACLE_SQL[name], TABLES)
        assert names == sorted(df.columns)
        assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
