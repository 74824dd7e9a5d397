"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value


def compare(spark, query, sql: str, folder: str = FOLDER) -> None:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    have = sorted(repr(plain(list(r))) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(plain([r[k] for k in order])) for r in found.fetchall())
    assert have == want
