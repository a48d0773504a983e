"""Every registered query against its SQL in DuckDB on the smallest tables."""

import json
import os

import duckdb
import numpy as np
import pytest

from metrifold.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "quantize") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(SQL[name])
    there = [x[0] for x in r.description]
    assert sorted(there) == cols
    want = sorted(tuple(_cell(row[there.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    """Every query is executed; what its rows must hold to is told below for each."""
    rows = QUERIES[name](spark, DATA).collect()
    assert rows or name == "st03_stream_cusum"
    CHECKS.get(name, lambda rows: None)([r.asDict(recursive=True) for r in rows])


def _bands(rows):
    """r is that of the six-hourly sums, and its band holds it."""
    c = duckdb.connect()
    sums = c.execute(f"select event_type, epoch_us(ts) // 21600000000 as h, sum(value) from '{DATA}/events.parquet' group by all").fetchall()
    of = {}
    for t, h, v in sums:
        of.setdefault(t, {})[h] = v
    assert len(rows) == len(of) * (len(of) - 1) // 2
    for r in rows:
        a, b = (of[t] for t in r["pair"].split("|"))
        both = sorted(set(a) & set(b))
        assert r["r"] == pytest.approx(np.corrcoef([a[h] for h in both], [b[h] for h in both])[0, 1], abs=1e-5)
        assert -1 <= r["r_min"] <= r["r"] <= r["r_max"] <= 1 and r["r_max"] - r["r_min"] > 1e-3


def _document(rows):
    (text,) = rows[0].values()
    doc = json.loads(text)
    assert len(rows) == 1 and doc and json.dumps(doc) and all(v is not None for v in doc.values())


CHECKS = {"a20_r_band": _bands, "k04_overview_document": _document}
