"""Runs DuckDB SQL on a folder of tables and compares rows, whatever their order."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def duck_rows(sql, sf_dir=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf_dir=SF):
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(*duck_rows(sql, sf_dir))
