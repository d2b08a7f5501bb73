"""Compares a query's rows with those of DuckDB on the same files, in any order, values as text."""

from pathlib import Path

import duckdb


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(float(r[i])) if hasattr(r[i], "is_finite") else str(r[i]) for i in order) for r in found)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.sql(sql)
    return rows(found.fetchall(), found.columns)
