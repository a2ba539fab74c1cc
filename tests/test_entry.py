"""The driver's contract."""

import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())
