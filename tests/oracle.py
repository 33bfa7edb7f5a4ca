"""Compares registered queries with their SQL in DuckDB: rows, columns, values."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def canonical(rows, names) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


def compare(df, sql: str, sf_dir: str) -> None:
    got = df.collect()
    want = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a, b = canonical(got, df.columns), canonical(want.fetchall(), want.columns)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
