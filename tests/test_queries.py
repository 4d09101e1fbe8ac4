"""Each registered query against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from pathlore.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool | str) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
    assert got == want


def test_loop_at_the_lookback_bound(spark):
    from pathlore.operators import sequences

    def loop_of(gap, n):
        states = [f"s{i}" for i in range(n)]
        states[n - 1 - gap] = states[n - 1] = "same"
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "task int, idx long, state string")
        return [r.loop_at for r in sequences.flags(df, "task", "state").orderBy("idx").collect()][-1]

    assert loop_of(1, 100) is None and loop_of(2, 100) == 97 and loop_of(50, 100) == 49 and loop_of(51, 100) is None
    assert loop_of(10, 12) == 1 and loop_of(11, 12) is None
