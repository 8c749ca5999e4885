"""Registered queries over the given tables, each with its SQL statement where one exists."""

from shoal.catalog import documents, density, inspection, labelings, metrics, topics, vectors

_PARTS = (documents, vectors, labelings, metrics, inspection, topics, density)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
