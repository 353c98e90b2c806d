import os

import duckdb
import pytest

from diffloom.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in os.listdir(SMALL):
        c.sql(f"create view {p[:-8]} as select * from '{SMALL}/{p}'")
    c.register("got", QUERIES[name](spark, SMALL).toArrow())
    c.execute(f"create table want as {SQL[name]}")
    columns = ",".join(sorted(x[0] for x in c.sql("describe want").fetchall()))
    for a, b in (("got", "want"), ("want", "got")):
        assert not c.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall()
