"""Rows of a Spark result and of DuckDB SQL, made comparable."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """The Parquet tables of a folder as views."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "NULL"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    if hasattr(value, "__len__") and not isinstance(value, (str, bytes)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, str):
        return value
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    try:
        return str(int(value)) if float(value) == int(value) else f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(map(plain, row)) for row in frame.itertuples(index=False, name=None))


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert a == b, f"only ours {list((a - b).items())[:3]}, only theirs {list((b - a).items())[:3]}"
