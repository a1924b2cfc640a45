"""Runs a registered query and its oracle and compares them as multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(spark, sf_dir: str, make, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = make(spark, sf_dir), con.sql(sql)
    columns, kinds = sorted(df.columns), dict(df.dtypes)
    assert columns == sorted(rel.columns)
    assert [kinds[c] for c in columns] == [KINDS[str(dict(zip(rel.columns, rel.types, strict=True))[c])] for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs
