"""Every query of the engine against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quillon.catalogue import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(str(r[c]) for c in sorted(columns)) for r in got.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
