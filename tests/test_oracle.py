import os

import duckdb
import pytest

from diffloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in os.listdir(SMALL):
        c.sql(f"create view {p[:-8]} as select * from '{SMALL}/{p}'")
    return c


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, duck, name):
    duck.register("got", registry.QUERIES[name](spark, SMALL).toArrow())
    duck.execute(f"create or replace table want as {registry.SQL[name]}")
    columns = sorted(x[0] for x in duck.sql("describe want").fetchall())
    assert columns == sorted(x[0] for x in duck.sql("describe got").fetchall())
    listed = ",".join(f'"{c}"' for c in columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert not duck.sql(f"select {listed} from {a} except all select {listed} from {b}").fetchall()
