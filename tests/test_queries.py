"""Every base query runs on the smallest tables, and agrees with its SQL."""

import duckdb
import pytest

from loomframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    def one(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return str(v) if v is not None and not isinstance(v, bool | int | str) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def _close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, int | float) and abs(a - b) <= 1e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*[df[f"`{c}`"] for c in columns]).collect()
    if name not in queries.ORACLE:
        assert got
        return
    found = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()]
    a, b = _plain(got), _plain(want)
    assert len(a) == len(b)
    assert all(_close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
