"""All queries of the library and, where SQL can express them, their DuckDB counterparts."""

from .plans import base, board, entities, found, more, sessions, small, streams, text, turns  # noqa: F401

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL
