"""Every registered query against its DuckDB oracle on the sf0.001 tables,
and the entry() smoke check."""

import datetime as dt
import decimal
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    coarse = lambda t: repr(tuple(round(v, 3) if isinstance(v, float) else v for v in t))
    return sorted(out, key=coarse)


def _same(a, b):
    """Equal rows, floats within 1e-5 (the two engines may round an exact
    decimal tie at the 6th place differently)."""
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, (float, int)):
                if not math.isclose(u, v, abs_tol=1e-5):
                    return False
            elif u != v:
                return False
    return True


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.collect()) >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert srows is not None
        return
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    a, b = _rows(df.columns, srows), _rows(dcols, cur.fetchall())
    assert _same(a, b), (a[:3], b[:3])
