import os

import __spark_entry__ as entry
import duckdb
import pytest
from skymatch.plans import registry

DATA = "/root/testdata/sf0.001"


def test_names_and_entry(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(registry.ORACLE_SQL) >= 45
    assert entry.entry(spark).limit(1).count() == 1


def shown(value):
    return "[" + ",".join(map(shown, value)) + "]" if isinstance(value, (list, tuple)) else repr(value + 0.0 if isinstance(value, float) else value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted("|".join(shown(r[c]) for c in names) for r in got.collect()) == sorted("|".join(shown(r[k]) for k in at) for r in want.fetchall())
