"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estate_spark.session import shared_dir
from estate_spark.sources.views import LINKS_SQL, PRICE_HISTORY_SQL, SALES_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

VIEW_SQL = {"sales": SALES_SQL, "links": LINKS_SQL, "price_history": PRICE_HISTORY_SQL}


def query(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    """Register a function under ``name``; ``views`` are put before ``sql`` as named queries."""

    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            named = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
            body = sql.strip()
            if named:
                body = body[5:].lstrip() if (more := body.upper().startswith("WITH ")) else body
                body = f"WITH {'RECURSIVE ' if recursive else ''}{named}{', ' if more else ' '}{body}"
            ORACLES[name] = body
        return fn

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for one query's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/estate-{uuid.uuid4().hex}/{name}"
