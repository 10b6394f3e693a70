"""Every query on empty tables: a result, however empty, and the one that SQL gives."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest
from test_oracles import SF, TABLES, plain

from ledgerwood.plans import registry

registry.load()


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    at, con = str(tmp_path_factory.mktemp("empty")), duckdb.connect()
    for t in TABLES:
        pq.write_table(pq.read_schema(f"{SF}/{t}.parquet").empty_table(), f"{at}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return at, con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, empty, name):
    at, con = empty
    df = registry.QUERIES[name](spark, at)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name])
        place = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())
