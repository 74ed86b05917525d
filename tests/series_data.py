"""Random bar series: one long key that spans many chunks and two short ones."""

import numpy as np
import pandas as pd


def frame(seed=3, sizes=(("HOT", 1500), ("B", 90), ("C", 1)), gaps=0.0):
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in sizes:
        # irregular days, so that time buckets hold different row counts
        days = pd.to_datetime("2015-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, n)), unit="D")
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + rng.random(n) * 0.01)
        low = np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
        x = rng.normal(0, 60, n)
        x[rng.random(n) < gaps] = np.nan
        parts.append(pd.DataFrame({
            "symbol": name, "date": days.date, "open": open_, "high": high, "low": low, "close": close,
            "adjusted_close": close * 0.9, "volume": rng.integers(1, 1000, n).astype(float), "split_factor": 1.0, "x": x,
        }))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=schema(pdf)).repartition(5)


def schema(pdf):
    kinds = {"symbol": "string", "date": "date"}
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)


def collect(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
