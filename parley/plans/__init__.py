"""The registered queries, their DuckDB oracles, and reports."""

from parley.plans import catalogue, messages, oracles

QUERIES = catalogue.QUERIES | messages.QUERIES
SQL = oracles.SQL | messages.SQL
