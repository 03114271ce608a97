"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("FACTWEAVE_TEST_DATA", "/root/testdata/sf0.001")


def connection(data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def same(spark, query, sql: str, data: str = DATA) -> None:
    df = query(spark, data)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    res = connection(data).execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    assert rounded(got) == rounded(want)
