"""A shared session, and helpers to compare rows."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from proofweave.session import build_session

    session = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(data)):
        path = f"{data}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df, *columns):
    """Sorted tuples of a DataFrame."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def same(df, frame) -> None:
    """A DataFrame holds the rows of a pandas frame, whatever their order."""
    left = df.toPandas()
    assert sorted(left.columns) == sorted(frame.columns)
    names = sorted(left.columns)

    def key(f):
        out = []
        for r in f[names].itertuples(index=False, name=None):
            out.append(tuple("~" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r))
        return sorted(out)

    assert key(left) == key(frame)
