"""Holds a registered query against its DuckDB SQL."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, (list, np.ndarray)):
            return tuple(plain(y) for y in x)
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if hasattr(x, "as_tuple"):
            x = float(x)
        if isinstance(x, (float, np.floating)):
            return f"{float(x) + 0.0:.6g}"
        return f"{float(x):.6g}" if isinstance(x, (int, np.integer)) else str(x)

    return sorted(map(str, (tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))))
