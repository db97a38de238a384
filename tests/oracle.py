"""Compare a registered query with its SQL, as the driver does."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu" and not df[c].hasnans:
            df[c] = df[c].astype("int64")
        if df[c].dtype.kind == "f" or df[c].hasnans and df[c].dtype.kind in "iu":
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(_sorted(got), _sorted(want), check_dtype=False, check_exact=True)
