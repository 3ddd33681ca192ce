"""Registration of queries with the SQL they are checked against."""

import re

from . import fixtures

QUERIES, ORACLE, ROWS = {}, {}, {}


def query(name, rows, sql=None):
    """Register ``fn(read) -> DataFrame`` under ``name``; ``rows``: the inventory rows it covers.

    ``read(view)`` loads a view or table. In ``sql`` the views are named like tables.
    """

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda view: fixtures.load(spark, sf_dir, view))
        ROWS[name] = rows.split()
        if sql:
            used = [v for v in fixtures.VIEWS if re.search(rf"\b{v}\b", sql)]
            ORACLE[name] = fixtures.with_views(sql, *used) if used else sql
        return fn

    return register
