"""Queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from sparkloom.plans import index_queries, text_queries


def queries() -> dict:
    return index_queries.QUERIES | text_queries.QUERIES


def oracle_sql() -> dict:
    return index_queries.SQL | text_queries.SQL
