"""Side-by-side check of a Spark result and a DuckDB statement."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    return {"bool": "bool", "int": "int", "float": "float", "str": "str"}.get(
        type(value).__name__, type(value).__name__
    )


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, row count, value kinds and values agree exactly."""
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return [f"columns {columns} vs {sorted(names)}"]
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} vs {len(theirs)}"]
    found = []
    for mine, other in zip(sorted(ours, key=_key), sorted(theirs, key=_key)):
        for column, a, b in zip(columns, mine, other):
            if a is None and b is None:
                continue
            if _kind(a) != _kind(b):
                found.append(f"{column}: kind {a!r} vs {b!r}")
            elif isinstance(a, float) and math.isnan(a) and math.isnan(b):
                continue
            elif a != b:
                found.append(f"{column}: {a!r} vs {b!r}")
    return found
