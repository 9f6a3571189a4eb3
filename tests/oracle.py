"""Rows of a query and of its SQL in one comparable form."""

import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import numpy as np
    import pandas as pd

    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    v = v.item() if isinstance(v, np.generic) else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def check(spark, run, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(run(spark, str(DATA)).toPandas()) == rows(con.execute(sql).fetchdf())
