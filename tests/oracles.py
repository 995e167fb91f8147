"""Comparing registered queries with their SQL on DuckDB."""

import duckdb

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def same_rows(spark, name, sf):
    """The query's rows are those of its SQL: columns by name, rows in any order, values as text."""
    own = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(own.columns)
    theirs = connected(sf).execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    mine = sorted(str(tuple(r)) for r in own.select(*columns).collect())
    assert mine == sorted(map(str, theirs)), name
