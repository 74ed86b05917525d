"""Score models against formulas written out in pandas, in one chunk and in many."""

import numpy as np
import pandas as pd
import pytest

from quoteflow.operators import quality as qc
from quoteflow.plans import scores
from quoteflow.plans.observation import check_request
from tests.series_data import collect, frame, to_spark


@pytest.fixture(scope="module")
def data():
    return frame(11, (("HOT", 1400), ("B", 300))).drop(columns="x").sort_values(["symbol", "date"]).reset_index(drop=True)


def rank(x, k, minimum, scale):
    out = []
    for i in range(len(x)):
        w = x[max(0, i - k + 1): i + 1]
        w = w[~np.isnan(w)]
        out.append(np.nan if len(w) < minimum or np.isnan(x[i]) else scale((w <= x[i]).mean()))
    return np.array(out)


def rsi(close, n):
    """From the definition: the means of rises and falls start at the first change, and each later change enters with weight 1/n."""
    prices, out = close.to_numpy(), []
    rise = fall = None
    for i, price in enumerate(prices):
        if i == 0 or np.isnan(price) or np.isnan(prices[i - 1]):
            out.append(np.nan)
            continue
        change = price - prices[i - 1]
        rise = max(change, 0.0) if rise is None else rise + (max(change, 0.0) - rise) / n
        fall = max(-change, 0.0) if fall is None else fall + (max(-change, 0.0) - fall) / n
        # 100 - 100 / (1 + rise / fall) is the rises' percentage of both; from there to -100..100
        out.append(np.nan if i < n or fall == 0 else 200 * rise / (rise + fall) - 100)
    return pd.Series(out, close.index)


def stoch(g, k):
    """From the definition: where the close stands between the lowest low and the highest high of the last k rows, all adjusted alike."""
    bars, out = g[["high", "low", "close", "adjusted_close"]].to_numpy(), []
    for i in range(len(bars)):
        frame_ = bars[max(0, i - k + 1): i + 1]
        scale = frame_[:, 3] / frame_[:, 2]
        top, bottom = (frame_[:, 0] * scale).max(), (frame_[:, 1] * scale).min()
        whole = i >= k - 1 and top > bottom
        out.append(min(100.0, max(-100.0, 200 * (bars[i, 3] - bottom) / (top - bottom) - 100)) if whole else np.nan)
    return pd.Series(out, g.index)


def two_input(g, p):
    c = g.adjusted_close
    f = pd.DataFrame({"a": stoch(g, 21), "b": stoch(g, 252), "c": rank(rsi(c, 14).to_numpy(), 252, 126, lambda s: s * 200 - 100)}, g.index)
    ok = f.dropna()
    drive, level, out = p[0] + ok.to_numpy() @ np.array(p[1:4]) / 100, 0.0, pd.Series(np.nan, g.index)
    for i, d in zip(ok.index, drive):
        level = (1 - p[4]) * d + p[4] * level
        out[i] = np.clip(100 * np.tanh(level), -99, 99)
    return out


def per_key(data, fn):
    return np.concatenate([np.asarray(fn(g), dtype=float) for _, g in data.groupby("symbol", sort=True)])


PARAMETERS = [0.02, 0.3, 0.0, -0.2, 0.6]


@pytest.mark.parametrize("size", [100, 100_000])
def test_two_input_score(spark, data, size):
    got = collect(scores.two_input_score(to_spark(spark, data), PARAMETERS, size=size))
    want = per_key(data, lambda g: two_input(g, PARAMETERS))
    np.testing.assert_allclose(got["score"].astype(float), want, atol=1e-9, equal_nan=True)
    assert np.isfinite(want).sum() > 1000
    prior = per_key(data.assign(s=want), lambda g: [
        np.nan if np.isnan(v) or np.isfinite(g.s.to_numpy()[max(0, i - 504): i]).sum() < 504
        else 100 * np.nanmean(np.where(np.isnan(w := g.s.to_numpy()[max(0, i - 504): i]), np.nan, w <= v)) for i, v in enumerate(g.s)])
    np.testing.assert_allclose(got["score_rank"].astype(float), prior, atol=1e-9, equal_nan=True)


def test_two_input_rejects_bad_parameters(spark, data):
    for bad in ([1, 2, 3], [0, 1, 1, 1, 0.5], [0, 1, 0, 1, 1.0]):
        with pytest.raises(ValueError):
            scores.two_input_score(to_spark(spark, data), bad)


def five(g):
    f = g.adjusted_close / g.close
    o, h, low, c, v = g.open * f, g.high * f, g.low * f, g.adjusted_close, g.volume
    ret = c.pct_change()
    vol = ret.rolling(20, min_periods=15).std()
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / c
    scaled = lambda s: s * 200 - 100
    price = (stoch(g, 21) + stoch(g, 60) + stoch(g, 252) + rank(c.to_numpy(), 252, 126, scaled)) / 4
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    hist = macd - macd.ewm(span=9, adjust=False).mean()
    mom = (rsi(c, 6) + rsi(c, 14) + rsi(c, 21) + 100 * np.tanh(hist / (atr * c))) / 4
    loc = ((2 * c - h - low) / (h - low)).clip(-1, 1)
    signed = np.sign(ret).replace(0, np.nan).fillna(loc) * v
    share = lambda x, k, m: x.rolling(k, min_periods=m).sum() / v.rolling(k, min_periods=m).sum() * 100
    flow = 0.5 * share(signed, 5, 5) + 0.3 * share(signed, 20, 15) + 0.2 * share(loc * v, 20, 15)
    state = -pd.Series(rank(atr.to_numpy(), 252, 126, scaled), g.index)
    multi = pd.concat([100 * np.tanh(c.pct_change(n) / (vol * np.sqrt(n))) for n in (3, 5, 10, 20)], axis=1).mean(axis=1)
    dd = pd.concat([(100 + s * (c / c.rolling(k).max() - 1)).clip(-100, 100) for s, k in ((1000, 20), (500, 60))], axis=1).mean(axis=1)
    urge = (multi + dd + 100 * np.tanh((o / c.shift() - 1) / vol)) / 3
    raw = 100 * np.tanh((0.3 * price + 0.2 * mom + 0.25 * flow + 0.1 * state + 0.15 * urge) / 50)
    level, out = None, []
    for value in raw:
        if np.isfinite(value):
            level = value if level is None else (0.55 if value < level else 0.25) * value + (0.45 if value < level else 0.75) * level
        out.append(level if np.isfinite(value) else np.nan)
    return out


@pytest.mark.parametrize("size", [100, 100_000])
def test_five_component_score(spark, data, size):
    rows = scores.five_component_score(to_spark(spark, data), size=size)
    got = collect(rows)
    want = per_key(data, five)
    np.testing.assert_allclose(got["score"].astype(float), want, atol=1e-8, equal_nan=True)
    assert np.isfinite(want).sum() > 1000


def test_four_factor_score_is_the_same_in_many_chunks(spark, data):
    bars = to_spark(spark, data)
    other = bars.select("symbol", "date", (bars.close * 2 + bars.volume).alias("adjusted_close")).where("dayofmonth(date) % 3 > 0")
    one, many = (collect(scores.four_factor_score(bars, other, size=n)) for n in (100_000, 100))
    assert len(one) > 1000 and list(one["date"]) == list(many["date"])
    for c in (*scores.FOUR_FACTOR_WEIGHTS, "score"):
        np.testing.assert_allclose(one[c], many[c], atol=1e-8)


def test_no_loss_leaves_the_oscillator_missing(spark):
    n = 60
    pdf = pd.DataFrame({"symbol": "UP", "date": pd.date_range("2020-01-01", periods=n).date, "open": np.arange(1.0, n + 1), "high": np.arange(2.0, n + 2),
                        "low": np.arange(0.5, n + 0.5), "close": np.arange(1.0, n + 1), "adjusted_close": np.arange(1.0, n + 1), "volume": 1.0})
    got = collect(scores.oscillators(to_spark(spark, pdf)))
    assert got["rsi_6"].isna().all()


def test_one_bad_row_blocks_the_symbol(spark, data):
    pdf = data.copy()
    pdf.loc[5, "volume"] = 0.0  # first key in order is B
    gate = {r.symbol: r.blocked for r in qc.strict_gate(to_spark(spark, pdf)).collect()}
    assert gate == {"B": True, "HOT": False}


def test_request_checks():
    from datetime import date

    known = [f"S{i}" for i in range(20)]
    check_request(["S1", "S2"], known, date(2020, 1, 1), date(2021, 1, 1), 0)
    for names, start, end, limit in ((["S1", "S1"], date(2020, 1, 1), date(2021, 1, 1), 0), ([], date(2020, 1, 1), date(2021, 1, 1), 0), (["X"], date(2020, 1, 1), date(2021, 1, 1), 0),
                                     (["S1"], date(2021, 1, 1), date(2020, 1, 1), 0), (["S1"], date(2000, 1, 1), date(2021, 1, 1), 0), (["S1"], date(2020, 1, 1), date(2021, 1, 1), 5001)):
        with pytest.raises(ValueError):
            check_request(names, known, start, end, limit, 14, 365 * 15, 5000)
    check_request([f"S{i}" for i in range(20)], known, date(1990, 1, 1), date(2021, 1, 1), 10**6)
