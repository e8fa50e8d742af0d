"""Every query with SQL against DuckDB on the same tables, and the others for rows."""

import math

import duckdb
import pytest

from windgrid.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows, columns):
    """Rows in an order of their exact values, columns by name; floats apart, as sums may differ in the last digit."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, float) else str(v)

    out = [([one(r[i]) for i in order if not isinstance(r[i], float)], [float(one(r[i])) for i in order if isinstance(r[i], float)]) for r in rows]
    return sorted(out, key=lambda x: (x[0], [round(v, 3) for v in x[1]])), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got, columns = plain([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    want, wanted = plain(rel.fetchall(), names)
    assert columns == wanted and len(got) == len(want)
    for (a, x), (b, y) in zip(got, want, strict=True):
        assert a == b and x == pytest.approx(y, abs=2e-3, rel=1e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "tier" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
