"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from . import agents, bodies, captures, cases, streams, traffic  # captures and streams add to traffic's

QUERIES = traffic.QUERIES | agents.QUERIES | bodies.QUERIES | cases.QUERIES
ORACLE_SQL: dict[str, str] = traffic.ORACLE_SQL | agents.ORACLE_SQL | bodies.ORACLE_SQL | cases.ORACLE_SQL
