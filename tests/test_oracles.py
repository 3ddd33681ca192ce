"""Every query with SQL gives the SQL's rows, in a second engine, on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

from trackloom import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def compare(df, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cols = sorted(df.columns)
    rows = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got, want = sorted(map(tuple, df.select(*cols).collect()), key=key), sorted(rows, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            if isinstance(a, float) and b is not None:
                assert math.isclose(a, float(b), rel_tol=1e-9, abs_tol=1e-6), (g, w)
            else:
                assert a == b, (g, w)


PARTS = tuple(f"{os.sep}trackloom{os.sep}{p}{os.sep}" for p in ("operators", "functions", "sources", "streaming"))


def reached(build):
    """What ``build`` returns, and the operators and column functions of the library that it calls on the way."""
    found = set()

    def note(frame, event, _):
        if event == "call" and any(p in frame.f_code.co_filename for p in PARTS):
            found.add(frame.f_code.co_name)

    sys.setprofile(note)
    try:
        return build(), found
    finally:
        sys.setprofile(None)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    df, called = reached(lambda: QUERIES[name](spark, DATA))
    assert called, "a query holds its operator itself"
    compare(df, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run_and_call_operators(spark, name):
    df, called = reached(lambda: QUERIES[name](spark, DATA))
    assert called and df.limit(1).count() == 1


def test_every_inventory_row_that_a_query_covers_is_named_once_at_least():
    rows = {r for found in registry.covered().values() for r in found}
    assert len(rows) > 200
