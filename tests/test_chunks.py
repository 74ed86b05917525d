"""Chunked operators give what one whole-key pass gives, with chunks small enough that a key spans many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.operators import recursive as rec
from quoteflow.operators.ranks import prior_rank, rolling_percentile, rolling_rank, with_ranks
from quoteflow.operators.smoothing import interpolate, smooth
from quoteflow.operators.timeline import CHUNK, Series, last_rows, place, positions, running, running_on
from tests.series_data import collect, frame, to_spark

SIZE = 60


@pytest.fixture(scope="module")
def data():
    return frame(gaps=0.1).sort_values(["symbol", "date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, data):
    return to_spark(spark, data).cache()


def by_key(data, fn):
    return pd.concat([fn(g) for _, g in data.groupby("symbol", sort=True)]).sort_index().to_numpy()


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(np.asarray(got, dtype=float), np.asarray(want, dtype=float), rtol=tol, atol=tol, equal_nan=True)


def test_hot_key_spans_chunks_and_every_row_has_one_owner(df, data):
    placed = place(df, 5, 5, size=SIZE)
    assert placed.where("symbol = 'HOT'").select(CHUNK).distinct().count() > 5
    cut = Series.cut(df, 30, size=SIZE, ahead=7)
    assert cut.done().count() == len(data)
    biggest = cut.frame.groupBy("symbol", CHUNK).count().agg(F.max("count")).first()[0]
    assert biggest < 400  # bounded by chunk + bucket + halo, not by the key


def test_placing_runs_no_job(spark, df):
    spark.sparkContext.setJobGroup("placing", "none expected")
    place(df, 5, 5, size=SIZE)
    Series.cut(df, 30, size=SIZE)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("placing")
    spark.sparkContext.setJobGroup("tests", "")


def test_look_back_windows(df, data):
    s = Series.cut(df, 25, size=SIZE)
    s = s.add(top=fs.rolling_drawdown(s, "x", 20, 5), lag=fs.difference(s, "close", 21), filled=fs.ffill(s, "x", 3))
    got = collect(s.done())
    same(got["top"], by_key(data, lambda g: g.x / g.x.rolling(20, min_periods=5).max() - 1))
    same(got["lag"], by_key(data, lambda g: g.close.diff(21)))
    same(got["filled"], by_key(data, lambda g: g.x.ffill(limit=3)))


def test_running_aggregates_both_ways(df, data):
    s = Series.cut(df, 0, size=SIZE)
    s = running_on(s, total=("sum", F.col("x")), best=("max", F.col("x")), seen=("count", F.col("x")), last=("last", F.col("x")), first=("first", F.col("x")))
    s = running_on(s, exclusive=True, low=("min", F.col("close")))
    s = running_on(s, reverse=True, after=("last", F.col("x")), rest=("count", F.lit(1)))
    got = collect(s.done())
    same(got["total"], by_key(data, lambda g: g.x.fillna(0).cumsum().where(g.x.notna().cumsum() > 0)), 1e-7)
    same(got["best"], by_key(data, lambda g: g.x.cummax().ffill()))
    same(got["seen"], by_key(data, lambda g: g.x.notna().cumsum()))
    same(got["last"], by_key(data, lambda g: g.x.ffill()))
    same(got["first"], by_key(data, lambda g: g.x.bfill().iloc[:1].reindex(g.index).ffill().where(g.x.notna().cumsum() > 0)))
    same(got["low"], by_key(data, lambda g: g.close.cummin().shift()))
    same(got["after"], by_key(data, lambda g: g.x.bfill()))
    same(got["rest"], by_key(data, lambda g: pd.Series(np.arange(len(g), 0, -1), g.index)))


def test_running_product(df, data):
    got = collect(running(df.withColumn("f", F.lit(1.0) + F.col("volume") / 1e5), size=SIZE, p=("product", F.col("f"))))
    same(got["p"], by_key(data, lambda g: (1 + g.volume / 1e5).cumprod()), 1e-8)


def test_positions_and_last_rows(df, data):
    got = collect(positions(df, width=30))
    same(got["pos"], by_key(data, lambda g: pd.Series(np.arange(1, len(g) + 1), g.index)))
    tail = collect(last_rows(df, 200, width=30))
    want = data.groupby("symbol").tail(200).sort_values(["symbol", "date"])
    assert list(tail["date"]) == list(want["date"])


def ranked(values, mode, minimum):
    values = np.asarray(values)
    clean = values[~np.isnan(values)]
    if mode == "last":
        return np.nan if len(clean) < minimum else (clean <= clean[-1]).mean()
    if np.isnan(values[-1]):
        return np.nan
    if mode == "current":
        return np.nan if len(clean) < minimum else (clean <= values[-1]).mean() * 200 - 100
    before = values[:-1][~np.isnan(values[:-1])]
    return np.nan if len(before) < minimum else 100 * (before <= values[-1]).mean()


def test_ranks(df, data):
    s = with_ranks(Series.cut(df, 64, size=SIZE), rolling_percentile("a", "x", 63), rolling_rank("b", "x", 50, 10), prior_rank("c", "x", 64, 40))
    got = collect(s.done())
    roll = lambda k, mode, minimum: by_key(
        data, lambda g: pd.Series([ranked(g.x.to_numpy()[max(0, i - k + 1): i + 1], mode, minimum) for i in range(len(g))], g.index))
    same(got["a"], roll(63, "last", 31))
    same(got["b"], roll(50, "current", 10))
    same(got["c"], roll(65, "prior", 40))


def test_all_null_and_tied_ranks(spark):
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2020-01-01", periods=30).date, "x": [np.nan] * 5 + [1.0] * 25})
    got = collect(with_ranks(Series.cut(to_spark(spark, pdf), 25), rolling_percentile("p", "x", 20, 20)).done())
    assert got["p"].isna().sum() == 24 and (got["p"].dropna() == 1.0).all()


def test_exponential_means(df, data):
    means = [rec.span("e20", "close", 20, 10), rec.wilder("w6", "close", 6), rec.Mean("z", "close", 0.3, from_zero=True)]
    got = collect(rec.recursive_means(df, means, size=SIZE))
    same(got["e20"], by_key(data, lambda g: g.close.ewm(span=20, adjust=False, min_periods=10).mean()), 1e-11)
    same(got["w6"], by_key(data, lambda g: g.close.ewm(alpha=1 / 6, adjust=False, min_periods=6).mean()), 1e-11)
    same(got["z"], by_key(data, lambda g: pd.concat([pd.Series([0.0]), g.close]).ewm(alpha=0.3, adjust=False).mean().iloc[1:]), 1e-11)


def sequential(x, update, start=None):
    state, out = start, []
    for v in x:
        if np.isnan(v):
            out.append(np.nan)
            continue
        state = v if state is None else update(state, v)
        out.append(state)
    return out


def test_asymmetric_filter_and_ar1(df, data):
    step = lambda s, v: (0.55 if v < s else 0.25) * v + (1 - (0.55 if v < s else 0.25)) * s
    got = collect(rec.asymmetric(df, "x", "y", size=SIZE))
    same(got["y"], by_key(data, lambda g: pd.Series(sequential(g.x, step), g.index)), 1e-11)
    got = collect(rec.ar1(df, "x", 0.5, "y", size=SIZE))
    same(got["y"], by_key(data, lambda g: pd.Series(sequential(g.x, lambda s, v: 0.5 * v + 0.5 * s, 0.0), g.index)), 1e-11)


def test_interpolation_and_centred_median(spark):
    data = frame(5, (("HOT", 900), ("B", 40)), gaps=0.0).sort_values(["symbol", "date"]).reset_index(drop=True)
    keep = np.random.default_rng(1).random(len(data)) < 0.15
    data["x"] = data["x"].where(keep)
    placed = place(to_spark(spark, data), 1, 1, size=SIZE)
    got = collect(smooth(interpolate(placed, "x", "y", 12), "y", "m"))

    def fill(g):
        x = g.x.to_numpy()
        known = np.flatnonzero(~np.isnan(x))
        full = np.interp(np.arange(len(x)), known, x[known])
        near = np.array([np.abs(known - i).min() <= 12 for i in range(len(x))])
        return pd.Series(np.where(near, full, np.nan), g.index)

    filled = pd.Series(by_key(data, fill))
    same(got["y"], filled)
    data["y"] = filled
    same(got["m"], by_key(data, lambda g: g.y.rolling(3, center=True, min_periods=1).median()))
