"""Every query with an SQL twin gives the same rows as DuckDB; every other query runs."""

import math

import pytest

import __spark_entry__ as entry
from quern.operators import queues
from quern.plans import adapters, batches, friction, problems, routing, rules, snapshots

ORACLES = {k: v for m in (problems, friction, rules, routing, snapshots, batches, adapters, queues) for k, v in m.ORACLES.items()}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, duck, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_golden_skill_counts(spark, sf_dir):
    rows = {r["skill"]: (r["invocations"], r["retries"], r["corrections"], r["folded"]) for r in entry.queries()["c09_skill_friction"](spark, sf_dir).collect()}
    assert rows == {"skill_0": (87, 21, 22, 4), "skill_1": (81, 20, 25, 6), "skill_2": (74, 17, 36, 3), "skill_3": (72, 20, 13, 6), "skill_4": (63, 12, 20, 5)}
