"""Side-by-side comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows; else what differs."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns differ: {names} vs {sorted(relation.columns)}"
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema.fields:
        want = SAME_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if want != theirs[field.name]:
            return f"type of {field.name}: {want} vs {theirs[field.name]}"
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    order = [relation.columns.index(n) for n in names]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    if ours == expected:
        return None if ours else "no rows"
    extra, missing = list((ours - expected).items())[:3], list((expected - ours).items())[:3]
    return f"rows {sum(ours.values())} vs {sum(expected.values())}; only ours {extra}; only theirs {missing}"
