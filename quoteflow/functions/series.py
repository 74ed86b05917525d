"""Causal time-series functions: Columns over a chunked :class:`Series`.

``s`` supplies the windows, so one sort per series serves every function of a stage. ``LOOKBACK`` notes in
the docstrings give the halo a function needs; a function fed by another adds both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteflow.functions.scalars import clip, col, mean_skip, nonzero, tanh_score
from quoteflow.operators.timeline import Series

TRADING_DAYS = 252


def gated(s: Series, x: Column, k: int, minimum: int, value: Column) -> Column:
    """``value`` once the last ``k`` rows hold ``minimum`` non-null ``x``."""
    return F.when(s.let(F.count(x).over(s.last(k))) >= minimum, value)


def change(s: Series, c, n: int = 1) -> Column:
    """Relative change against ``n`` rows earlier. LOOKBACK n."""
    x = col(c)
    return x / nonzero(s.let(F.lag(x, n).over(s.window()))) - 1


def difference(s: Series, c, n: int = 1) -> Column:
    x = col(c)
    return x - s.let(F.lag(x, n).over(s.window()))


def ffill(s: Series, c, n: int) -> Column:
    """Last non-null value at most ``n`` rows back. LOOKBACK n."""
    return s.let(F.last(col(c), ignorenulls=True).over(s.rows(-n, 0)))


def stochastic(s: Series, high, low, close, k: int) -> Column:
    """Close inside the full ``k``-row range, -100..100; NULL for a zero range. LOOKBACK k-1."""
    h, lo, c = col(high), col(low), col(close)
    top, bottom = s.let(F.max(h).over(s.last(k))), s.let(F.min(lo).over(s.last(k)))
    full = s.let(F.count(h - lo).over(s.last(k))) >= k
    return F.when(full, clip((c - bottom) / nonzero(top - bottom) * 200 - 100, -100, 100))


def rolling_drawdown(s: Series, c, k: int, minimum: int) -> Column:
    x = col(c)
    return gated(s, x, k, minimum, x / s.let(F.max(x).over(s.last(k))) - 1)


def rolling_std(s: Series, c, k: int, minimum: int) -> Column:
    x = col(c)
    return gated(s, x, k, minimum, s.let(F.stddev_samp(x).over(s.last(k))))


def realized_vol(s: Series, returns, k: int, minimum: int) -> Column:
    """Annualised deviation of returns. LOOKBACK k-1."""
    return rolling_std(s, returns, k, minimum) * math.sqrt(TRADING_DAYS)


def true_range(s: Series, high, low, close) -> Column:
    """First row of a key: high - low (``greatest`` skips the missing previous close). LOOKBACK 1."""
    h, lo = col(high), col(low)
    previous = s.let(F.lag(col(close), 1).over(s.window()))
    return F.greatest(h - lo, F.abs(h - previous), F.abs(lo - previous))


def atr_ratio(s: Series, tr, close, k: int = 20, minimum: int = 15) -> Column:
    t = col(tr)
    return gated(s, t, k, minimum, s.let(F.avg(t).over(s.last(k)))) / col(close)


def close_location(high, low, close) -> Column:
    h, lo, c = col(high), col(low), col(close)
    return clip((2 * c - h - lo) / nonzero(h - lo), -1, 1)


def signed_volume(returns, location, volume) -> Column:
    """Direction of the return times volume; a flat or missing return uses the close location."""
    return F.coalesce(nonzero(F.signum(col(returns))), col(location)) * col(volume)


def volume_share(s: Series, numerator, volume, k: int, minimum: int) -> Column:
    """100 x sum(numerator) / sum(volume), each sum gated on its own non-null count. LOOKBACK k-1."""
    n, v = col(numerator), col(volume)
    top = gated(s, n, k, minimum, s.let(F.sum(n).over(s.last(k))))
    base = gated(s, v, k, minimum, s.let(F.sum(v).over(s.last(k))))
    return top / nonzero(base) * 100


def tanh_momentum(s: Series, close, vol, ns: Sequence[int] = (3, 5, 10, 20)) -> Column:
    """Null-skipping mean of squashed n-row returns. LOOKBACK max(ns)."""
    return mean_skip([tanh_score(change(s, close, n), col(vol) * math.sqrt(n)) for n in ns])


def drawdown_score(s: Series, close) -> Column:
    """Null-skipping mean of two scaled drawdowns. LOOKBACK 59."""
    short = clip(100 + 1000 * rolling_drawdown(s, close, 20, 20), -100, 100)
    long = clip(100 + 500 * rolling_drawdown(s, close, 60, 60), -100, 100)
    return mean_skip([short, long])


def gap_score(s: Series, open_, close, vol) -> Column:
    gap = col(open_) / nonzero(s.let(F.lag(col(close), 1).over(s.window()))) - 1
    return tanh_score(gap, vol)


def centred_median(s: Series, c, radius: int = 1) -> Column:
    """Median of the non-null values at most ``radius`` rows away (needs rows after, see ``smooth``)."""
    values = F.sort_array(s.let(F.collect_list(col(c)).over(s.rows(-radius, radius))))
    n = F.size(values)
    middle = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (middle + F.try_element_at(values, F.floor(n / 2 + 1).cast("int"))) / 2)
