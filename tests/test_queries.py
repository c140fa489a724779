"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from harrier.plans import fleets, hosts, more, registry, tables, telemetry  # noqa: F401 - the others add their queries to the registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return con


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, db, name):
    df = registry.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in registry.ORACLE:
        rel = db.sql(registry.ORACLE[name])
        names = list(rel.columns)
        assert sorted(names) == columns
        want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in rel.fetchall()), key=str)
        assert got == want
