"""Rows of a query and of its SQL, in a form that can be compared."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in found), key=repr)


def of_sql(sql, sf_dir=SF):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    table = con.execute(sql).to_arrow_table()
    return sorted(table.column_names), rows(table.column_names, zip(*(c.to_pylist() for c in table.columns)) if table.num_columns else [])


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())
