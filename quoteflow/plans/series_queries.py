"""Registered queries: window and time-series functions and the composite scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.functions.scalars import nonzero, tanh_score, to_score
from quoteflow.operators import recursive as rec
from quoteflow.operators.joins import align_ffill
from quoteflow.operators.ranks import avg_percentiles, percentile_set, prior_rank, rolling_percentile, rolling_rank, with_ranks
from quoteflow.operators.smoothing import interpolate, resample_linear, smooth
from quoteflow.operators.timeline import Series, last_rows, place, running
from quoteflow.plans import fixtures as fx
from quoteflow.plans import scores
from quoteflow.plans.registry import query, r, rounded

KEY = ["symbol", "date"]

# Parameters of the frozen two-input model (bias, three weights, memory).
FROZEN_PARAMETERS = (-0.010663545490466473, 0.2718293778084337, 0.0, 0.22118152221048204, 0.5279469368762758)

# Bars numbered per symbol, with adjusted prices and one-row changes.
NUMBERED = f"""{fx.BARS},
n AS (
  SELECT *, open * (adjusted_close / close) AS a_open, high * (adjusted_close / close) AS a_high, low * (adjusted_close / close) AS a_low,
    row_number() OVER w AS rn, adjusted_close / lag(adjusted_close) OVER w - 1 AS ret, adjusted_close - lag(adjusted_close) OVER w AS delta,
    lag(adjusted_close) OVER w AS prev, lag(close) OVER w AS prev_raw
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def pct_sql(x: str, k: int, minimum: int) -> str:
    """Share of non-null frame values at most the last non-null one."""
    w = frame(k)
    values = f"list({x}) FILTER ({x} IS NOT NULL) OVER {w}"
    return (f"CASE WHEN count({x}) OVER {w} >= {minimum} THEN len(list_filter({values}, lambda v: v <= "
            f"last_value({x} IGNORE NULLS) OVER {w})) / count({x}) OVER {w} END")


def rank_cte(name: str, source: str, items: list[tuple[str, str, int, int]], current: bool = False) -> str:
    """CTEs that collect the frames first and compare afterwards: items are (out, column, k, minimum)."""
    lists = ", ".join(
        f"list({x}) FILTER ({x} IS NOT NULL) OVER {frame(k)} AS l_{out}, last_value({x} IGNORE NULLS) OVER {frame(k)} AS c_{out}"
        for out, x, k, _ in items
    )
    shares = ", ".join(
        f"CASE WHEN len(l_{out}) >= {m}{f' AND {x} IS NOT NULL' if current else ''} THEN "
        f"len(list_filter(l_{out}, lambda v: v <= c_{out}))::DOUBLE / len(l_{out}) END AS {out}"
        for out, x, k, m in items
    )
    drop = ", ".join(f"l_{o}, c_{o}" for o, *_ in items)
    return f"{name}_l AS (SELECT *, {lists} FROM {source}),\n{name} AS (SELECT * EXCLUDE ({drop}), {shares} FROM {name}_l)"


def gated_sql(agg: str, x: str, k: int, minimum: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(k)} >= {minimum} THEN {agg}({x}) OVER {frame(k)} END"


def ema_cte(name: str, source: str, items: list[tuple[str, str, float]]) -> str:
    """Recursive exponential means started at the first value; items are (out, column, alpha)."""
    first = ", ".join(f"{x} AS {out}" for out, x, _ in items)
    step = ", ".join(
        f"CASE WHEN s.{x} IS NULL THEN e.{out} WHEN e.{out} IS NULL THEN s.{x} ELSE (1 - {a!r}::DOUBLE) * e.{out} + {a!r}::DOUBLE * s.{x} END"
        for out, x, a in items
    )
    return (f"{name} AS (SELECT symbol, rn, {first} FROM {source} WHERE rn = 1 UNION ALL "
            f"SELECT s.symbol, s.rn, {step} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)")


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


# --- rolling ranks -------------------------------------------------------------------------------------------


@query("ts1_rolling_percentile",
       f"WITH {NUMBERED}, {rank_cte('p', 'n', [('pct', 'ret', 252, 126)])} SELECT symbol, date, {r('pct', 'pct', 6)} FROM p")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 252)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    s = with_ranks(s, rolling_percentile("pct", "ret", 252))
    return rounded(s.done().select(*KEY, "pct"), 6, "pct")


@query("ts2_rolling_rank",
       f"WITH {NUMBERED}, {rank_cte('p', 'n', [('rk', 'ret', 252, 126)], True)} SELECT symbol, date, {r('rk * 200 - 100', 'rank', 6)} FROM p")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 252)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    s = with_ranks(s, rolling_rank("rank", "ret", 252, 126))
    return rounded(s.done().select(*KEY, "rank"), 6, "rank")


PRIOR = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 504 PRECEDING AND 1 PRECEDING)"


@query("ts3_prior_rank", f"""WITH {NUMBERED}, p AS (SELECT symbol, date, ret, list(ret) FILTER (ret IS NOT NULL) OVER {PRIOR} AS l FROM n),
q AS (SELECT symbol, date, ret, len(l) AS n, 100 * len(list_filter(l, lambda v: v <= ret))::DOUBLE / len(l) AS v FROM p)
SELECT symbol, date, {r('CASE WHEN ret IS NOT NULL AND n >= 504 THEN v END', 'full_rank', 6)},
  {r('CASE WHEN ret IS NOT NULL AND n >= 126 THEN v END', 'partial_rank', 6)} FROM q""")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 505)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    s = with_ranks(s, prior_rank("full_rank", "ret", 504, 504), prior_rank("partial_rank", "ret", 504, 126))
    return rounded(s.done().select(*KEY, "full_rank", "partial_rank"), 6, "full_rank", "partial_rank")


def skip_mean_sql(*xs: str) -> str:
    total = " + ".join(f"coalesce({x}, 0)" for x in xs)
    count = " + ".join(f"({x} IS NOT NULL)::INT" for x in xs)
    return f"CASE WHEN {count} > 0 THEN ({total}) / ({count}) END"


@query("ts4_ts5_avg_percentiles", f"""WITH {NUMBERED},
{rank_cte('p', 'n', [('a', 'adjusted_close', 63, 31), ('b', 'adjusted_close', 126, 63), ('c', 'adjusted_close', 252, 126)])}
SELECT symbol, date, {r('(' + skip_mean_sql('a', 'b', 'c') + ') * 200 - 100', 'score')} FROM p""")
def _(spark, sf):
    s = with_ranks(Series.cut(fx.daily_bars(spark, sf), 252), *percentile_set("_p", "adjusted_close"))
    out = avg_percentiles(s.done(), "_p", "score").withColumn("score", to_score("score"))
    return rounded(out.select(*KEY, "score"), 4, "score")


# --- ranges, volatility, drawdown ----------------------------------------------------------------------------


def stochastic_sql(k: int) -> str:
    w = frame(k)
    hi, lo = f"max(a_high) OVER {w}", f"min(a_low) OVER {w}"
    return (f"CASE WHEN count(*) OVER {w} >= {k} THEN greatest(-100.0, least(100.0, "
            f"(adjusted_close - {lo}) / nullif({hi} - {lo}, 0) * 200 - 100)) END")


def stochastic_column(name: str, k: int) -> str:
    """As text; a zero range needs its own guard because greatest/least skip NULL."""
    w = frame(k)
    return f"CASE WHEN max(a_high) OVER {w} > min(a_low) OVER {w} THEN {stochastic_sql(k)} END AS {name}"


@query("ts6_stochastic", f"""WITH {NUMBERED}, p AS (SELECT *, {stochastic_column('s21', 21)}, {stochastic_column('s60', 60)}, {stochastic_column('s252', 252)} FROM n)
SELECT symbol, date, {r('s21', 's21')}, {r('s60', 's60')}, {r('s252', 's252')} FROM p""")
def _(spark, sf):
    s = Series.cut(scores.adjust_ohlc(fx.daily_bars(spark, sf)), 252)
    s = s.add(**{f"s{k}": fs.stochastic(s, "a_high", "a_low", "a_close", k) for k in (21, 60, 252)})
    return rounded(s.done().select(*KEY, "s21", "s60", "s252"), 4, "s21", "s60", "s252")


@query("ts7_rolling_drawdown", f"""WITH {NUMBERED}
SELECT symbol, date, {r(f"adjusted_close / ({gated_sql('max', 'adjusted_close', 252, 63)}) - 1", 'dd252', 6)},
  {r(f"adjusted_close / ({gated_sql('max', 'adjusted_close', 20, 20)}) - 1", 'dd20', 6)},
  {r(f"adjusted_close / ({gated_sql('max', 'adjusted_close', 60, 60)}) - 1", 'dd60', 6)} FROM n""")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 252)
    s = s.add(**{f"dd{k}": fs.rolling_drawdown(s, "adjusted_close", k, m) for k, m in ((252, 63), (20, 20), (60, 60))})
    return rounded(s.done().select(*KEY, "dd252", "dd20", "dd60"), 6, "dd252", "dd20", "dd60")


@query("ts8_realized_vol", f"""WITH {NUMBERED}
SELECT symbol, date, {r(f"({gated_sql('stddev_samp', 'ret', 20, 15)}) * sqrt(252)", 'vol20')},
  {r(f"({gated_sql('stddev_samp', 'ret', 60, 30)}) * sqrt(252)", 'vol60')},
  {r(f"nullif({gated_sql('stddev_samp', 'ret', 20, 15)}, 0)", 'daily_vol')} FROM n""")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 61)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    s = s.add(vol20=fs.realized_vol(s, "ret", 20, 15), vol60=fs.realized_vol(s, "ret", 60, 30),
              daily_vol=nonzero(fs.rolling_std(s, "ret", 20, 15)))
    return rounded(s.done().select(*KEY, "vol20", "vol60", "daily_vol"), 4, "vol20", "vol60", "daily_vol")


TR_RAW = "CASE WHEN prev_raw IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev_raw), abs(low - prev_raw)) END"
TR_ADJ = "CASE WHEN prev IS NULL THEN a_high - a_low ELSE greatest(a_high - a_low, abs(a_high - prev), abs(a_low - prev)) END"


@query("ts9_ts10_atr_ratio", f"""WITH {NUMBERED}, p AS (SELECT *, {TR_RAW} AS tr, {TR_ADJ} AS tr_adj FROM n)
SELECT symbol, date, tr AS true_range, tr_adj AS adjusted_true_range,
  {r(f"({gated_sql('avg', 'tr', 20, 15)}) / close", 'atr_ratio')} FROM p""")
def _(spark, sf):
    s = Series.cut(scores.adjust_ohlc(fx.daily_bars(spark, sf)), 21)
    s = s.add(true_range=fs.true_range(s, "high", "low", "close"),
              adjusted_true_range=fs.true_range(s, "a_high", "a_low", "a_close"))
    s = s.add(atr_ratio=fs.atr_ratio(s, "true_range", "close"))
    return rounded(s.done().select(*KEY, "true_range", "adjusted_true_range", "atr_ratio"), 4, "atr_ratio")


# --- recursive indicators ------------------------------------------------------------------------------------

TREND_MEANS = ema_cte("e", "n", [(f"e{k}", "adjusted_close", 2 / (k + 1)) for k in (20, 60, 200)])


@query("ts11_ts12_ema", f"""{recursive(NUMBERED, TREND_MEANS)},
g AS (SELECT n.symbol, n.date, adjusted_close, {', '.join(f'CASE WHEN n.rn >= {max(10, k // 2)} THEN e{k} END AS e{k}' for k in (20, 60, 200))}
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn)
SELECT symbol, date, {', '.join(r(f'e{k}', f'ema{k}', 3) for k in (20, 60, 200))},
  {', '.join(r(f'adjusted_close / e{k} - 1', f'distance{k}', 5) for k in (20, 60, 200))},
  {', '.join(r(f'e{k} / lag(e{k}, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1', f'slope{k}', 5) for k, n in ((20, 3), (60, 6), (200, 20)))} FROM g""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf).select(*KEY, "adjusted_close")
    means = [rec.span(f"ema{k}", "adjusted_close", k, max(10, k // 2)) for k, _ in scores.TREND_SPANS]
    s = Series.cut(rec.recursive_means(bars, means), 20)
    s = s.add(**{f"distance{k}": F.col("adjusted_close") / nonzero(f"ema{k}") - 1 for k, _ in scores.TREND_SPANS},
              **{f"slope{k}": fs.change(s, f"ema{k}", n) for k, n in scores.TREND_SPANS})
    out = s.done("adjusted_close")
    out = rounded(out, 3, *[c for c in out.columns if c.startswith("ema")])
    return rounded(out, 5, *[c for c in out.columns if c.startswith(("dist", "slope"))])


OSC = f"""{NUMBERED},
m AS (SELECT *, CASE WHEN delta IS NULL THEN NULL ELSE greatest(delta, 0) END AS gain,
  CASE WHEN delta IS NULL THEN NULL ELSE greatest(-delta, 0) END AS loss, {TR_ADJ} AS tr FROM n)"""
OSC_MEANS = ema_cte("e", "m", [
    *[(f"{side[0]}{n}", side, 1 / n) for n in (6, 14, 21) for side in ("gain", "loss")],
    ("atr", "tr", 1 / 14), ("e12", "adjusted_close", 2 / 13), ("e26", "adjusted_close", 2 / 27),
])


def rsi_sql(n: int) -> str:
    # 2 * (100 - 100 / (1 + g/l)) - 100, missing before n differences or with no loss
    return f"CASE WHEN j.rn > {n} AND l{n} <> 0 THEN greatest(-100.0, least(100.0, 2 * (100 - 100 / (1 + g{n} / l{n})) - 100)) END"


OSC_ALL = f"""{recursive(OSC, OSC_MEANS)},
j AS (SELECT m.*, e.* EXCLUDE (symbol, rn), e12 - e26 AS macd FROM m JOIN e ON m.symbol = e.symbol AND m.rn = e.rn),
{ema_cte('sg', 'j', [('sig', 'macd', 0.2)])},
o AS (SELECT j.symbol, j.date, j.rn, {', '.join(f'{rsi_sql(n)} AS rsi_{n}' for n in (6, 14, 21))},
    CASE WHEN j.rn >= 14 THEN atr / adjusted_close END AS atr_pct,
    100 * tanh((macd - sig) / nullif(CASE WHEN j.rn >= 14 THEN atr END, 0)) AS macd_score
  FROM j JOIN sg ON j.symbol = sg.symbol AND j.rn = sg.rn)"""


@query("ts13_ts15_oscillators", f"""{OSC_ALL}
SELECT symbol, date, {', '.join(r(f'rsi_{n}', f'rsi_{n}', 3) for n in (6, 14, 21))}, {r('atr_pct', 'atr_pct', 4)}, {r('macd_score', 'macd_score', 3)} FROM o""")
def _(spark, sf):
    out = scores.oscillators(fx.daily_bars(spark, sf)).select(*KEY, "rsi_6", "rsi_14", "rsi_21", "atr_pct", "macd_score")
    return rounded(rounded(out, 3, "rsi_6", "rsi_14", "rsi_21", "macd_score"), 4, "atr_pct")


# --- volume flow, momentum, gaps -----------------------------------------------------------------------------

LOCATION = """CASE WHEN a_high > a_low THEN greatest(-1.0, least(1.0, (2 * adjusted_close - a_high - a_low) / (a_high - a_low))) END"""


def share_sql(x: str, k: int, minimum: int) -> str:
    return f"({gated_sql('sum', x, k, minimum)}) / ({gated_sql('sum', 'volume', k, minimum)}) * 100"


VOLUME = f"""v AS (SELECT *, {LOCATION} AS loc FROM n),
u AS (SELECT *, coalesce(nullif(sign(ret), 0), loc) * volume AS signed_volume, loc * volume AS flow FROM v),
f AS (SELECT *, {share_sql('signed_volume', 5, 5)} AS b5, {share_sql('signed_volume', 20, 15)} AS b20, {share_sql('flow', 20, 15)} AS m20 FROM u)"""


@query("ts16_ts19_volume_flow", f"""WITH {NUMBERED}, {VOLUME}
SELECT symbol, date, {r('signed_volume', 'signed_volume')}, {r('b5', 'balance5')}, {r('b20', 'balance20')}, {r('m20', 'money_flow20')},
  {r('b5 * 0.5::DOUBLE + b20 * 0.3::DOUBLE + m20 * 0.2::DOUBLE', 'volume_flow')} FROM f""")
def _(spark, sf):
    s = Series.cut(scores.adjust_ohlc(fx.daily_bars(spark, sf)), 21)
    s = s.add(ret=fs.change(s, "a_close"), loc=fs.close_location("a_high", "a_low", "a_close"))
    s = s.add(signed_volume=fs.signed_volume("ret", "loc", "volume"), flow=F.col("loc") * F.col("volume"))
    s = s.add(balance5=fs.volume_share(s, "signed_volume", "volume", 5, 5),
              balance20=fs.volume_share(s, "signed_volume", "volume", 20, 15),
              money_flow20=fs.volume_share(s, "flow", "volume", 20, 15))
    names = ["signed_volume", "balance5", "balance20", "money_flow20", "volume_flow"]
    mix = F.col("balance5") * 0.5 + F.col("balance20") * 0.3 + F.col("money_flow20") * 0.2
    return rounded(s.done().withColumn("volume_flow", mix).select(*KEY, *names), 4, *names)


MOMENTUM = f"""h AS (SELECT *, nullif({gated_sql('stddev_samp', 'ret', 20, 15)}, 0) AS vol FROM n),
k AS (SELECT *, {', '.join(f'100 * tanh((adjusted_close / lag(adjusted_close, {n}) OVER w - 1) / (vol * sqrt({n}))) AS t{n}' for n in (3, 5, 10, 20))},
  100 * tanh((a_open / prev - 1) / vol) AS gap,
  CASE WHEN rn >= 20 THEN greatest(-100.0, least(100.0, 100 + 1000 * (adjusted_close / max(adjusted_close) OVER {frame(20)} - 1))) END AS d20,
  CASE WHEN rn >= 60 THEN greatest(-100.0, least(100.0, 100 + 500 * (adjusted_close / max(adjusted_close) OVER {frame(60)} - 1))) END AS d60
  FROM h WINDOW w AS (PARTITION BY symbol ORDER BY date)),
mo AS (SELECT *, {skip_mean_sql('t3', 't5', 't10', 't20')} AS mom, {skip_mean_sql('d20', 'd60')} AS dd FROM k)"""


@query("ts20_ts22_urgency_parts", f"WITH {NUMBERED}, {MOMENTUM} SELECT symbol, date, {r('mom', 'momentum')}, {r('dd', 'drawdown_score')}, {r('gap', 'gap_score')} FROM mo")
def _(spark, sf):
    s = Series.cut(scores.adjust_ohlc(fx.daily_bars(spark, sf)), 60)
    s = s.add(ret=fs.change(s, "a_close"))
    s = s.add(vol=nonzero(fs.rolling_std(s, "ret", 20, 15)))
    s = s.add(momentum=fs.tanh_momentum(s, "a_close", "vol"), drawdown_score=fs.drawdown_score(s, "a_close"),
              gap_score=fs.gap_score(s, "a_open", "a_close", "vol"))
    return rounded(s.done().select(*KEY, "momentum", "drawdown_score", "gap_score"), 4, "momentum", "drawdown_score", "gap_score")


@query("ts23_jn1_align_ffill", f"""WITH {fx.BARS}, {fx.SECOND}, {fx.UNDERLYING},
j AS (SELECT b.symbol, b.date, u.adjusted_close AS x FROM bars b LEFT JOIN underlying u ON u.symbol = b.symbol AND u.date = b.date)
SELECT symbol, date, {r("last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", 'other_close', 2)} FROM j""")
def _(spark, sf):
    s = align_ffill(fx.daily_bars(spark, sf), fx.underlying_bars(spark, sf))
    return rounded(s.done().select(*KEY, "other_close"), 2, "other_close")


@query("ts25_changes", f"""WITH {NUMBERED}
SELECT symbol, date, ret AS change_1, adjusted_close / lag(adjusted_close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change_5,
  delta AS difference_1 FROM n""")
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 5)
    s = s.add(change_1=fs.change(s, "adjusted_close"), change_5=fs.change(s, "adjusted_close", 5),
              difference_1=fs.difference(s, "adjusted_close"))
    return s.done().select(*KEY, "change_1", "change_5", "difference_1")


# --- smoothing -----------------------------------------------------------------------------------------------

# The close is blanked on two of three days so that there are gaps to fill.
GAPPY = f"""{fx.BARS}, g AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  CASE WHEN date_diff('day', DATE '1970-01-01', date) % 16 < 2 THEN close END AS x FROM bars),
b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS r0, last_value(x IGNORE NULLS) OVER p AS x0,
    first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS r1, first_value(x IGNORE NULLS) OVER f AS x1
  FROM g WINDOW p AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT symbol, date, rn, CASE WHEN x IS NOT NULL THEN x
    WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND (rn - r0 <= 12 OR r1 - rn <= 12) THEN x0 + (x1 - x0) * (rn - r0) / (r1 - r0)
    WHEN x1 IS NULL AND rn - r0 <= 12 THEN x0 WHEN x0 IS NULL AND r1 - rn <= 12 THEN x1 END AS filled FROM b)"""


def gappy(spark, sf):
    keep = (F.unix_date("date") % 16) < 2
    return fx.daily_bars(spark, sf).select(*KEY, F.when(keep, F.col("close")).alias("x"))


@query("ts24_interpolate_smooth", f"""WITH {GAPPY}
SELECT symbol, date, filled, median(filled) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM i""")
def _(spark, sf):
    out = smooth(interpolate(place(gappy(spark, sf), 1, 1), "x", "filled", 12), "filled", "smooth")
    return out.select(*KEY, "filled", "smooth")


@query("ts24_resample_linear", f"""WITH {fx.BARS}, p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS x,
  count(*) OVER (PARTITION BY symbol) AS n, date, close FROM bars),
q AS (SELECT symbol, date, date_diff('day', min(date) OVER (PARTITION BY symbol), date)::DOUBLE
  / greatest(1, date_diff('day', min(date) OVER (PARTITION BY symbol), max(date) OVER (PARTITION BY symbol))) * (n - 1) AS at FROM p)
SELECT q.symbol, q.date, {r('a.close + (coalesce(b.close, a.close) - a.close) * (q.at - floor(q.at))', 'sampled', 3)}
FROM q JOIN p a ON a.symbol = q.symbol AND a.x = floor(q.at) LEFT JOIN p b ON b.symbol = q.symbol AND b.x = floor(q.at) + 1""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf).select(*KEY, "close")
    bounds = bars.groupBy("symbol").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.count(F.lit(1)).alias("n"))
    at = F.datediff("date", "d0") / F.greatest(F.lit(1), F.datediff("d1", "d0")) * (F.col("n") - 1)
    wanted = bars.join(bounds, "symbol").select(*KEY, at.alias("at"))
    return rounded(resample_linear(bars, "close", wanted, "at", "sampled").select(*KEY, "sampled"), 3, "sampled")


# --- filters over scores -------------------------------------------------------------------------------------

# A bounded input for the filters: squashed daily return, missing when the return is tiny.
DRIVER = f"{NUMBERED}, d AS (SELECT symbol, date, rn, CASE WHEN abs(ret) > 0.02 THEN 100 * tanh(ret) END AS x FROM n), dv AS (SELECT symbol, date, x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM d WHERE x IS NOT NULL)"


def driver(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 1)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    return s.done().select(*KEY, F.when(F.abs("ret") > 0.02, tanh_score("ret", 1.0)).alias("x"))


def asym_cte(name: str, source: str, x: str) -> str:
    return (f"{name} AS (SELECT symbol, rn, {x} AS y FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, "
            f"CASE WHEN s.{x} < e.y THEN 0.55::DOUBLE * s.{x} + (1 - 0.55::DOUBLE) * e.y ELSE 0.25::DOUBLE * s.{x} + (1 - 0.25::DOUBLE) * e.y END "
            f"FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)")


@query("ts26_asymmetric_filter", f"""{recursive(DRIVER, asym_cte('a', 'dv', 'x'))}
SELECT d.symbol, d.date, {r('a.y', 'filtered')} FROM d LEFT JOIN dv ON dv.symbol = d.symbol AND dv.date = d.date LEFT JOIN a ON a.symbol = dv.symbol AND a.rn = dv.rn""")
def _(spark, sf):
    return rounded(rec.asymmetric(driver(spark, sf), "x", "filtered").drop("x"), 4, "filtered")


@query("ts27_ar1", f"""{recursive(DRIVER, '''a AS (SELECT symbol, rn, (1 - 0.5::DOUBLE) * x AS y FROM dv WHERE rn = 1 UNION ALL
SELECT s.symbol, s.rn, (1 - 0.5::DOUBLE) * s.x + 0.5::DOUBLE * e.y FROM a e JOIN dv s ON s.symbol = e.symbol AND s.rn = e.rn + 1)''')}
SELECT d.symbol, d.date, {r('a.y', 'latent')} FROM d LEFT JOIN dv ON dv.symbol = d.symbol AND dv.date = d.date LEFT JOIN a ON a.symbol = dv.symbol AND a.rn = dv.rn""")
def _(spark, sf):
    return rounded(rec.ar1(driver(spark, sf), "x", 0.5, "latent").drop("x"), 4, "latent")


@query("ts28_ts29_running_drawdown_rebased", f"""WITH {fx.BARS}
SELECT symbol, date, {r('max(adjusted_close) OVER w', 'peak')}, {r('adjusted_close / max(adjusted_close) OVER w - 1', 'drawdown', 6)},
  {r('adjusted_close / first_value(adjusted_close) OVER w', 'rebased', 6)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    close = F.col("adjusted_close")
    out = running(fx.daily_bars(spark, sf).select(*KEY, "adjusted_close"), peak=("max", close), _first=("first", close))
    out = out.withColumns({"drawdown": close / F.col("peak") - 1, "rebased": close / F.col("_first")})
    return rounded(rounded(out.select(*KEY, "peak", "drawdown", "rebased"), 4, "peak"), 6, "drawdown", "rebased")


@query("ts31_last_rows", f"""WITH {fx.BARS} SELECT symbol, date, close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60""")
def _(spark, sf):
    return last_rows(fx.daily_bars(spark, sf), 60).select(*KEY, "close")


# --- composites ----------------------------------------------------------------------------------------------

FOUR = f"""{recursive(NUMBERED, fx.SECOND, fx.UNDERLYING, TREND_MEANS)},
f0 AS (SELECT n.*, {', '.join(f'CASE WHEN n.rn >= {max(10, k // 2)} THEN e{k} END AS e{k}' for k in (20, 60, 200))}, u.adjusted_close AS u0
  FROM n JOIN e ON n.symbol = e.symbol AND n.rn = e.rn LEFT JOIN underlying u ON u.symbol = n.symbol AND u.date = n.date),
f1 AS (SELECT *, last_value(u0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS uc, {TR_RAW} AS tr,
  adjusted_close / ({gated_sql('max', 'adjusted_close', 252, 63)}) - 1 AS dd,
  ({gated_sql('stddev_samp', 'ret', 20, 15)}) AS v20, ({gated_sql('stddev_samp', 'ret', 60, 30)}) AS v60,
  {', '.join(f'adjusted_close / e{k} - 1 AS dist{k}, e{k} / lag(e{k}, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1 AS slope{k}' for k, n in ((20, 3), (60, 6), (200, 20)))} FROM f0),
f2 AS (SELECT *, ({gated_sql('avg', 'tr', 20, 15)}) / close AS atr FROM f1),
{rank_cte('f3', 'f2', [
    *[(f'm{k}', 'uc', k, m) for k, m in ((63, 31), (126, 63), (252, 126))],
    *[(f'p{k}', 'adjusted_close', k, m) for k, m in ((63, 31), (126, 63), (252, 126))],
    ('pdd', 'dd', 252, 63), ('pv20', 'v20', 252, 63), ('pv60', 'v60', 252, 63), ('patr', 'atr', 252, 63),
    *[(f'p{part}{k}', f'{part}{k}', 252, 63) for k in (20, 60, 200) for part in ('dist', 'slope')]])},
f4 AS (SELECT *, {skip_mean_sql('m63', 'm126', 'm252')} AS market, {skip_mean_sql('p63', 'p126', 'p252')} AS price FROM f3),
f5 AS (SELECT *, market * 200 - 100 AS market_position, ({skip_mean_sql('price', 'pdd')}) * 200 - 100 AS etf_position,
  (1 - ({skip_mean_sql('pv20', 'pv60', 'patr')})) * 200 - 100 AS volatility,
  ({skip_mean_sql(*[f'p{part}{k}' for k in (20, 60, 200) for part in ('dist', 'slope')])}) * 200 - 100 AS trend FROM f4),
four AS (SELECT symbol, date, rn, open, close, adjusted_close, open * adjusted_close / close AS execution_open, uc, market_position, etf_position, volatility, trend,
  (market_position + etf_position + volatility + trend) * 0.25::DOUBLE AS score FROM f5
  WHERE market_position + etf_position + volatility + trend IS NOT NULL)"""


@query("sc1_four_factor", f"""{FOUR} SELECT symbol, date, {', '.join(r(c, c, 3) for c in ('market_position', 'etf_position', 'volatility', 'trend', 'score'))} FROM four""")
def _(spark, sf):
    out = scores.four_factor_score(fx.daily_bars(spark, sf), fx.underlying_bars(spark, sf))
    names = [*scores.FOUR_FACTOR_WEIGHTS, "score"]
    return rounded(out.select(*KEY, *names), 3, *names)


FIVE = f"""{OSC_ALL}, {VOLUME}, {MOMENTUM},
c0 AS (SELECT n.*, o.* EXCLUDE (symbol, date, rn), f.b5, f.b20, f.m20, mo.mom, mo.dd, mo.gap, {', '.join(f'{stochastic_column(f"s{k}", k)}' for k in (21, 60, 252)).replace('a_high', 'n.a_high').replace('a_low', 'n.a_low').replace('adjusted_close', 'n.adjusted_close').replace('PARTITION BY symbol ORDER BY date', 'PARTITION BY n.symbol ORDER BY n.date')}
  FROM n JOIN o ON n.symbol = o.symbol AND n.rn = o.rn JOIN f ON n.symbol = f.symbol AND n.rn = f.rn JOIN mo ON n.symbol = mo.symbol AND n.rn = mo.rn),
{rank_cte('c1', 'c0', [('rk', 'adjusted_close', 252, 126), ('ark', 'atr_pct', 252, 126)], True)},
c2 AS (SELECT symbol, date, rn, (s21 + s60 + s252 + rk * 200 - 100) / 4 AS price_position, (rsi_6 + rsi_14 + rsi_21 + macd_score) / 4 AS momentum,
  b5 * 0.5::DOUBLE + b20 * 0.3::DOUBLE + m20 * 0.2::DOUBLE AS volume_flow, -(ark * 200 - 100) AS volatility_state, (mom + dd + gap) / 3 AS urgency FROM c1),
c3 AS (SELECT *, 100 * tanh((price_position * 0.3::DOUBLE + momentum * 0.2::DOUBLE + volume_flow * 0.25::DOUBLE + volatility_state * 0.1::DOUBLE + urgency * 0.15::DOUBLE) / 50) AS score_raw FROM c2),
c4 AS (SELECT symbol, date, score_raw, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM c3 WHERE score_raw IS NOT NULL),
{asym_cte('c5', 'c4', 'score_raw')},
five AS (SELECT c3.*, c5.y AS score FROM c3 LEFT JOIN c4 ON c4.symbol = c3.symbol AND c4.date = c3.date LEFT JOIN c5 ON c5.symbol = c4.symbol AND c5.rn = c4.rn)"""


@query("sc2_five_component", f"""{FIVE} SELECT symbol, date, {', '.join(r(c, c, 3) for c in ('price_position', 'momentum', 'volume_flow', 'volatility_state', 'urgency', 'score_raw', 'score'))} FROM five""")
def _(spark, sf):
    out = scores.five_component_score(fx.daily_bars(spark, sf))
    names = [*scores.FIVE_COMPONENT_WEIGHTS, "score_raw", "score"]
    return rounded(out.select(*KEY, *names), 3, *names)


P = FROZEN_PARAMETERS
TWO = f"""{OSC_ALL},
t0 AS (SELECT n.*, o.rsi_14, {stochastic_column('s21', 21)}, {stochastic_column('s252', 252)} FROM n JOIN o USING (symbol, rn, date)),
{rank_cte('t1', 't0', [('rk', 'rsi_14', 252, 126)], True)},
t2 AS (SELECT symbol, date, {P[0]!r}::DOUBLE + (s21 * {P[1]!r}::DOUBLE + s252 * 0 + (rk * 200 - 100) * {P[3]!r}::DOUBLE) / 100 AS drive, adjusted_close, a_open FROM t1),
t3 AS (SELECT symbol, date, drive, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM t2 WHERE drive IS NOT NULL),
t4 AS (SELECT symbol, rn, (1 - {P[4]!r}::DOUBLE) * drive AS latent FROM t3 WHERE rn = 1 UNION ALL
  SELECT s.symbol, s.rn, (1 - {P[4]!r}::DOUBLE) * s.drive + {P[4]!r}::DOUBLE * e.latent FROM t4 e JOIN t3 s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
t5 AS (SELECT t2.symbol, t2.date, t2.adjusted_close AS close, t2.a_open AS open, greatest(-99.0, least(99.0, 100 * tanh(latent))) AS raw, latent
  FROM t2 LEFT JOIN t3 ON t3.symbol = t2.symbol AND t3.date = t2.date LEFT JOIN t4 ON t4.symbol = t3.symbol AND t4.rn = t3.rn),
t6 AS (SELECT symbol, date, close, open, CASE WHEN latent IS NOT NULL THEN raw END AS score FROM t5),
t7 AS (SELECT *, list(score) FILTER (score IS NOT NULL) OVER {PRIOR} AS l FROM t6),
two AS (SELECT symbol, date, close, open, score, CASE WHEN score IS NOT NULL AND len(l) >= 504 THEN 100 * len(list_filter(l, lambda v: v <= score))::DOUBLE / len(l) END AS score_rank,
  CASE WHEN score IS NOT NULL AND len(l) >= 126 THEN 100 * len(list_filter(l, lambda v: v <= score))::DOUBLE / len(l) END AS score_partial_rank FROM t7)"""


@query("sc3_two_input", f"""{TWO} SELECT symbol, date, close, open, {r('score', 'score')}, {r('score_rank', 'score_rank')},
  {r('score_partial_rank', 'score_partial_rank')} FROM two""")
def _(spark, sf):
    out = scores.two_input_score(fx.daily_bars(spark, sf), FROZEN_PARAMETERS)
    return rounded(out, 4, "score", "score_rank", "score_partial_rank")

