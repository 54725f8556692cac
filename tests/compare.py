"""Comparing a Spark result with its DuckDB counterpart, value by value, in any row order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v).__name__), str(v)) for v in r))


_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    """What differs, as text; empty if nothing does."""
    relation = con.execute(sql)
    described = {d[0]: str(d[1]) for d in relation.description}
    names = sorted(described)
    expected_rows = relation.fetchall()
    order = [list(described).index(n) for n in names]
    expected = _sorted([tuple(r[i] for i in order) for r in expected_rows])
    found = []
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != described[name]:
            found.append(f"type of {name}: {kind} != {described[name]}")
    actual = _sorted([tuple(r) for r in df.select(*names).collect()])
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    for a, e in wrong[:3]:
        found += [f"  {n}: {x!r} != {y!r}" for n, x, y in zip(names, a, e) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ")
    return found
