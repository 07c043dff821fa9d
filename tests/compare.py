"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date",
         "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(columns)}"
    types = dict(df.dtypes)
    wrong = {c: (types[c], kinds[c]) for c in columns if types[c] != kinds[c]}
    if wrong:
        return f"types differ (spark, sql): {wrong}"
    actual = rows_of(df.columns, df.collect())
    if len(actual) != len(expected):
        return f"row counts differ: spark {len(actual)} sql {len(expected)}"
    if actual != expected:
        extra = sorted(set(actual) - set(expected))[:3]
        missing = sorted(set(expected) - set(actual))[:3]
        return f"values differ: only spark {extra} only sql {missing}"
    if not expected:
        return "both results are empty"
    return None
