"""Runs a query and its SQL on the same tables and compares rows, columns and values, as the gate does."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 6))
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(map(_value, r)) for r in pdf[cols].astype(object).itertuples(index=False))
