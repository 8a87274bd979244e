"""Compare a query with its SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if type(v).__name__ in ("int", "bool", "str", "NoneType"):
        return v
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(df, con, sql: str) -> str:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want, got = rows(names, result.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} and {len(want)} rows, first differences {odd}"
    return ""
