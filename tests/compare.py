"""Compares a query with its DuckDB SQL as multisets of rows, columns by name."""

import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, result.fetchall())
    assert got == want
    return len(got)
