"""Queries of language with an SQL twin give the same rows as DuckDB."""

import pytest

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, duck, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert theirs and sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs
