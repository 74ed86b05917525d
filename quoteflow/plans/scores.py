"""The three score models. They are independent; see the README for which inputs each one reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.functions.scalars import clip, col, mean_skip, mean_strict, nonzero, tanh_score, to_score
from quoteflow.operators.joins import align_ffill
from quoteflow.operators.recursive import Mean, ar1, asymmetric, means_on, recursive_means, span, wilder
from quoteflow.operators.ranks import avg_percentiles, percentile_set, prior_rank, rolling_percentile, rolling_rank, with_ranks
from quoteflow.operators.timeline import CHUNK, CHUNK_ROWS, Series, as_list, place, placement_of, unplace

# Fixed values of the models: factor weights, scale of the squash, filter weights.
FOUR_FACTOR_WEIGHTS = {"market_position": 0.25, "etf_position": 0.25, "volatility": 0.25, "trend": 0.25}
FIVE_COMPONENT_WEIGHTS = {
    "price_position": 0.30, "momentum": 0.20, "volume_flow": 0.25, "volatility_state": 0.10, "urgency": 0.15,
}
SQUASH = 50.0
FALLING, RISING = 0.55, 0.25
TREND_SPANS = ((20, 3), (60, 6), (200, 20))
RSI_WINDOWS = (6, 14, 21)
FIVE_HALO = 272  # longest look-back of the five components: a 252-row rank over a 20-row change
VOLATILITY = ("_v20", "_v60", "_atr")


def adjust_ohlc(bars: DataFrame) -> DataFrame:
    """Add adjusted open, high, low and close (``a_*``); a zero close gives NULL."""
    ratio = F.col("adjusted_close") / nonzero("close")
    adjusted = {f"a_{c}": F.col(c) * ratio for c in ("open", "high", "low")}
    return bars.withColumns({**adjusted, "a_close": F.col("adjusted_close").cast("double")})


def rsi_from(gain: str, loss: str) -> Column:
    """Relative strength index on -100..100; no average loss gives NULL."""
    strength = F.col(gain) / nonzero(loss)
    return clip(2 * (100 - 100 / (1 + strength)) - 100, -100, 100)


def macd_signal(fast: str, slow: str, smooth: str) -> Column:
    """9-row mean of (12-row mean - 26-row mean), from the three plain means of the close.

    A cascade of two exponential means with different weights is a fixed mix of the two single means, so the
    signal line needs no recursion of its own.
    """
    a9, a12, a26 = 2 / 10, 2 / 13, 2 / 27

    def cascade(mean: str, a: float) -> Column:
        return (a * (1 - a9) * F.col(smooth) - a9 * (1 - a) * F.col(mean)) / ((1 - a9) - (1 - a))

    return cascade(fast, a12) - cascade(slow, a26)


def with_differences(bars: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> Series:
    """Adjusted prices, one-row gain and loss, and adjusted true range on a cut series."""
    s = Series.cut(adjust_ohlc(bars), 1, key, ts, size)
    delta = fs.difference(s, "a_close")
    s = s.add(_delta=delta, _tr=fs.true_range(s, "a_high", "a_low", "a_close"))
    return s.add(
        _gain=F.when(F.col("_delta").isNotNull(), F.greatest(F.lit(0.0), F.col("_delta"))),
        _loss=F.when(F.col("_delta").isNotNull(), F.greatest(F.lit(0.0), -F.col("_delta"))),
    )


def oscillators(bars: DataFrame, windows: Sequence[int] = RSI_WINDOWS, macd: bool = True, key="symbol",
                ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Recursive indicators: ``rsi_n``, ``atr_pct`` and the MACD score, all in one Arrow pass."""
    means: list[Mean] = []
    for n in windows:
        means += [wilder(f"_g{n}", "_gain", n), wilder(f"_l{n}", "_loss", n)]
    if macd:
        means += [wilder("_atr", "_tr", 14), span("_e9", "a_close", 9), span("_e12", "a_close", 12), span("_e26", "a_close", 26)]
    out = means_on(with_differences(bars, key, ts, size), means)
    out = out.withColumns({f"rsi_{n}": rsi_from(f"_g{n}", f"_l{n}") for n in windows})
    if macd:
        histogram = F.col("_e12") - F.col("_e26") - macd_signal("_e12", "_e26", "_e9")
        atr = F.col("_atr") / nonzero("a_close")
        out = out.withColumns({"atr_pct": atr, "macd_score": tanh_score(histogram, atr * F.col("a_close"))})
    return out.drop("_delta", "_gain", "_loss", "_tr", *[m.out for m in means])


def five_component(bars: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Five components from a symbol's own bars, each on -100..100 (bars must have passed ``strict_gate``)."""
    placed = bars if CHUNK in bars.columns else place(bars, FIVE_HALO, 0, key, ts, size)
    s = Series.cut(oscillators(placed, key=key, ts=ts, size=size), FIVE_HALO, key, ts)
    s = s.add(
        _ret=fs.change(s, "a_close"),
        _loc=fs.close_location("a_high", "a_low", "a_close"),
        _s21=fs.stochastic(s, "a_high", "a_low", "a_close", 21),
        _s60=fs.stochastic(s, "a_high", "a_low", "a_close", 60),
        _s252=fs.stochastic(s, "a_high", "a_low", "a_close", 252),
        _dd=fs.drawdown_score(s, "a_close"),
    )
    s = s.add(
        _vol=nonzero(fs.rolling_std(s, "_ret", 20, 15)),
        _signed=fs.signed_volume("_ret", "_loc", "volume"),
        _flow=F.col("_loc") * F.col("volume"),
    )
    s = s.add(
        _b5=fs.volume_share(s, "_signed", "volume", 5, 5),
        _b20=fs.volume_share(s, "_signed", "volume", 20, 15),
        _m20=fs.volume_share(s, "_flow", "volume", 20, 15),
        _mom=fs.tanh_momentum(s, "a_close", "_vol"),
        _gap=fs.gap_score(s, "a_open", "a_close", "_vol"),
    )
    s = with_ranks(s, rolling_rank("_rank", "a_close", 252, 126), rolling_rank("_atr_rank", "atr_pct", 252, 126))
    out = s.done().withColumns({
        "price_position": clip(mean_strict(["_s21", "_s60", "_s252", "_rank"]), -100, 100),
        "momentum": clip(mean_strict(["rsi_6", "rsi_14", "rsi_21", "macd_score"]), -100, 100),
        "volume_flow": clip(F.col("_b5") * 0.5 + F.col("_b20") * 0.3 + F.col("_m20") * 0.2, -100, 100),
        "volatility_state": clip(-F.col("_atr_rank"), -100, 100),
        "urgency": clip(mean_strict(["_mom", "_dd", "_gap"]), -100, 100),
    })
    return out.select(*bars.columns, *FIVE_COMPONENT_WEIGHTS)


def five_component_score(bars: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Components, raw score and filtered score; the rows are counted once for all steps."""
    placed = place(bars, FIVE_HALO, 0, key, ts, size)
    return unplace(score_index(five_component(placed, key, ts), key, ts))


def score_index(components: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """``score_raw`` (squashed weighted sum) and ``score`` (asymmetric filter of it)."""
    linear = sum((F.col(c) * w for c, w in FIVE_COMPONENT_WEIGHTS.items()), F.lit(0.0))
    raw = components.withColumn("score_raw", tanh_score(linear, SQUASH))
    out = asymmetric(raw, "score_raw", "score", FALLING, RISING, key, ts, size)
    return out.withColumn("score", clip("score", -100, 100))


def four_factor_score(bars: DataFrame, underlying: DataFrame, key="symbol", ts: str = "date",
                      size: int = CHUNK_ROWS) -> DataFrame:
    """Market, own-price, volatility and trend factors and their weighted score; incomplete rows are dropped.

    ``underlying`` has (key, ts, adjusted_close) and is aligned to the dates of ``bars``.
    """
    means = [span(f"_e{n}", "adjusted_close", n, max(10, n // 2)) for n, _ in TREND_SPANS]
    with_means = recursive_means(place(bars, 515, 0, key, ts, size), means, key, ts)
    ratio = F.col("adjusted_close") / nonzero("close")
    close = F.col("adjusted_close")
    s = align_ffill(with_means, underlying, 3, "adjusted_close", "underlying_adjusted_close", key, ts, halo=512)
    s = s.add(
        execution_open=F.col("open") * ratio,
        execution_close=close,
        _ret=fs.change(s, close),
        _tr=fs.true_range(s, "high", "low", "close"),
        _dd=fs.rolling_drawdown(s, close, 252, 63),
        **{f"_dist{n}": close / nonzero(f"_e{n}") - 1 for n, _ in TREND_SPANS},
        **{f"_slope{n}": fs.change(s, f"_e{n}", lag) for n, lag in TREND_SPANS},
    )
    s = s.add(
        _v20=fs.realized_vol(s, "_ret", 20, 15),
        _v60=fs.realized_vol(s, "_ret", 60, 30),
        _atr=fs.atr_ratio(s, "_tr", "close"),
    )
    trend = [f"_{part}{n}" for n, _ in TREND_SPANS for part in ("dist", "slope")]
    s = with_ranks(
        s, *percentile_set("_u", "underlying_adjusted_close"), *percentile_set("_p", "adjusted_close"),
        *[rolling_percentile(f"_r{c}", c, 252, 63) for c in ("_dd", *VOLATILITY, *trend)],
    )
    out = avg_percentiles(avg_percentiles(s.done(), "_u", "_market"), "_p", "_price").withColumns({
        "market_position": to_score("_market"),
        "etf_position": to_score(mean_skip(["_price", "_r_dd"])),
        "volatility": to_score(1 - mean_skip([f"_r{c}" for c in VOLATILITY])),
        "trend": to_score(mean_skip([f"_r{c}" for c in trend])),
    })
    weighted = sum((F.col(c) * w for c, w in FOUR_FACTOR_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", clip(weighted, -100, 100)).where(F.col("score").isNotNull())
    return out.select(*bars.columns, "execution_open", "execution_close", "underlying_adjusted_close",
                      *FOUR_FACTOR_WEIGHTS, "score")


def check_parameters(parameters: Sequence[float]) -> list[float]:
    p = [float(x) for x in parameters]
    if len(p) != 5 or p[2] != 0 or not 0 <= p[4] < 1:
        raise ValueError("a two-input model needs five parameters, the third 0 and the last in [0, 1)")
    return p


def two_input_score(bars: DataFrame, parameters: Sequence[float], key="symbol", ts: str = "date",
                    size: int = CHUNK_ROWS) -> DataFrame:
    """Stochastic and ranked RSI, squashed after an AR(1) smoothing, with ranks among the preceding values."""
    p = check_parameters(parameters)
    s = Series.cut(oscillators(place(bars, 504, 0, key, ts, size), (14,), False, key, ts), 504, key, ts)
    s = s.add(
        _f1=fs.stochastic(s, "a_high", "a_low", "a_close", 21),
        _f2=fs.stochastic(s, "a_high", "a_low", "a_close", 252),
    )
    s = with_ranks(s, rolling_rank("_f3", "rsi_14", 252, 126))
    drive = p[0] + (F.col("_f1") * p[1] + F.col("_f2") * p[2] + F.col("_f3") * p[3]) / 100
    driven = s.done().withColumn("_drive", drive)
    latent = ar1(driven, "_drive", p[4], "_latent", key, ts)
    scored = latent.withColumn("score", clip(100 * F.tanh("_latent"), -99, 99))
    names = [*as_list(key), ts]
    inputs = scored.select(*names, F.col("a_close").alias("close"), F.col("a_open").alias("open"), "score", *placement_of(scored))
    t = Series.cut(inputs, 504, key, ts)
    t = with_ranks(t, prior_rank("score_rank", "score", 504, 504), prior_rank("score_partial_rank", "score", 504, 126))
    return unplace(t.done())


def contributions(df: DataFrame, weights: dict[str, float], keep: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row per component: key, weight, value and value x weight."""
    parts = F.array(*[
        F.struct(F.lit(name).alias("component"), F.lit(w).alias("weight"), col(name).cast("double").alias("value"))
        for name, w in weights.items()
    ])
    return df.select(*keep, F.inline(parts)).withColumn("contribution", F.col("value") * F.col("weight"))


def with_previous(b: DataFrame, key="symbol", ts: str = "date", price: str = "close", score: str = "score",
                  size: int = CHUNK_ROWS) -> DataFrame:
    """Percent price change against the previous row, and the previous score."""
    s = Series.cut(b, 1, key, ts, size)
    return s.add(price_change_pct=fs.change(s, price) * 100, previous_score=F.lag(score).over(s.window())).done()
