"""Queries over the given tables and the SQL each one is checked against."""

from .plans import base, q_enrich, q_models, q_motion, q_report, q_sources, q_stats, q_tables  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLE)


def covered():
    """Inventory rows by query."""
    return dict(base.ROWS)
