"""Performance, account and distribution metrics of curves and trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.functions.scalars import BAND_EDGES, band, finite
from quoteflow.operators.timeline import CHUNK_ROWS, Series, as_list, last_rows, running, running_on

# Trading days per year, days per calendar year, thresholds of the distribution table.
YEAR = 252
CALENDAR_YEAR = 365.25
DISTRIBUTION = (
    (-80, "<="), (-60, "<="), (-40, "<="), (-20, "<="), (0, "<="), (0, ">"), (20, ">="), (40, ">="), (60, ">="), (80, ">="),
)


def running_drawdown(curve: DataFrame, key="symbol", ts: str = "date", value: str = "equity", floor: float | None = None,
                     size: int = CHUNK_ROWS) -> DataFrame:
    """Running peak (not below ``floor``) and drawdown per row."""
    out = running(curve, key, ts, size, peak=("max", F.col(value)))
    if floor is not None:
        out = out.withColumn("peak", F.greatest(F.col("peak"), F.lit(float(floor))))
    return out.withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def max_drawdown(curve: DataFrame, key="symbol", ts: str = "date", value: str = "equity") -> DataFrame:
    return running_drawdown(curve, key, ts, value).groupBy(*as_list(key)).agg(F.min("drawdown").alias("max_drawdown"))


def curve_statistics(curve: DataFrame, key="symbol", ts: str = "date", value: str = "equity", size: int = CHUNK_ROWS) -> DataFrame:
    """Per key: rows, ends, mean and deviation of row changes, share of gains, worst drawdown."""
    keys = as_list(key)
    s = Series.cut(curve.select(*keys, ts, value), 1, keys, ts, size)
    s = running_on(s.add(_r=fs.change(s, value)), _peak=("max", F.col(value)))
    return s.done().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last"),
        F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"), F.avg((F.col("_r") > 0).cast("double")).alias("_gains"),
        F.min(F.col(value) / F.col("_peak") - 1).alias("_mdd"),
    )


def performance(curve: DataFrame, trades: DataFrame | None = None, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Return, CAGR, drawdown, Sharpe, Calmar and trade counts per key; zeros for curves shorter than two rows.

    ``trades`` has the key, side, value and realized_pnl.
    """
    keys = as_list(key)
    table = curve_statistics(curve, keys, ts, "equity", size)
    if trades is not None:
        counted = trades.groupBy(*keys).agg(
            F.count(F.lit(1)).cast("double").alias("_t"), F.sum(F.abs("value")).alias("_turn"),
            F.count_if(F.col("side") == "sell").alias("_exits"),
            F.count_if((F.col("side") == "sell") & (F.col("realized_pnl") > 0)).alias("_wins"),
        )
        table = table.join(counted, keys, "left")
    else:
        table = table.withColumns({"_t": F.lit(0.0), "_turn": F.lit(0.0), "_exits": F.lit(0), "_wins": F.lit(0)})
    return table.select(*keys, *performance_columns())


def performance_columns() -> list[Column]:
    """The metrics from the statistics of :func:`curve_statistics` and trade counts."""
    enough = F.col("_n") >= 2
    growth = F.col("_last") / F.col("_first")
    cagr = F.pow(growth, 1 / F.greatest(F.col("_n") / YEAR, F.lit(1 / YEAR))) - 1
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * YEAR**0.5).otherwise(0.0)
    calmar = F.when(F.col("_mdd") < 0, cagr / F.abs("_mdd")).otherwise(0.0)
    wins = F.when(F.coalesce("_exits", F.lit(0)) > 0, F.col("_wins") / F.col("_exits")).otherwise(0.0)
    values = {
        "total_return": growth - 1, "cagr": cagr, "max_drawdown": F.col("_mdd"), "sharpe": sharpe, "calmar": calmar,
        "trades": F.coalesce("_t", F.lit(0.0)), "turnover": F.coalesce("_turn", F.lit(0.0)), "win_rate": wins,
        "positive_days": F.coalesce("_gains", F.lit(0.0)),
    }
    return [F.when(enough, v).otherwise(F.lit(0.0)).alias(name) for name, v in values.items()]


def account_metrics(curve: DataFrame, initial: float, key="symbol", ts: str = "date") -> DataFrame:
    """Account view: return on the fixed start, drawdown with the peak floored at it, CAGR by calendar days from a year on."""
    keys = as_list(key)
    rows = running_drawdown(curve, keys, ts, "equity", initial)
    table = rows.groupBy(*keys).agg(
        F.max_by("equity", ts).alias("ending_value"), F.count(F.lit(1)).alias("sessions"), F.min("drawdown").alias("_mdd"),
        F.datediff(F.max(ts), F.min(ts)).alias("_days"),
    )
    growth = F.col("ending_value") / initial
    return table.select(
        *keys, ((growth - 1) * 100).alias("return_pct"), (F.col("_mdd") * 100).alias("drawdown_pct"),
        F.when(F.col("_days") >= 365, (F.pow(growth, CALENDAR_YEAR / F.col("_days")) - 1) * 100).alias("cagr_pct"),
        "ending_value", "sessions",
    )


def annual_rollup(curve: DataFrame, trades: DataFrame, initial: float, key="symbol", ts: str = "date") -> DataFrame:
    """Per key and year: start (previous year's end), end, return, drawdown, trades, fees and profit."""
    keys = as_list(key)
    rows = curve.withColumn("year", F.year(ts))
    ends = rows.groupBy(*keys, "year").agg(F.max_by("equity", ts).alias("end_equity"), F.max(ts).alias("through"))
    by_key = Window.partitionBy(*keys).orderBy("year")  # one row per year
    ends = ends.withColumn("start_equity", F.coalesce(F.lag("end_equity").over(by_key), F.lit(float(initial))))
    peaks = running(rows, [*keys, "year"], ts, peak=("max", F.col("equity"))).join(ends.select(*keys, "year", "start_equity"), [*keys, "year"])
    worst = peaks.groupBy(*keys, "year").agg(
        F.min(F.col("equity") / F.greatest("peak", "start_equity") - 1).alias("_mdd")
    )
    counted = trades.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"),
        F.sum("fee").alias("fees"), F.sum("realized_pnl").alias("realized_pnl"),
    )
    table = ends.join(worst, [*keys, "year"]).join(counted, [*keys, "year"], "left")
    table = table.na.fill(0, ["buys", "sells"]).na.fill(0.0, ["fees", "realized_pnl"])
    return table.select(
        *keys, "year", "start_equity", "end_equity", ((F.col("end_equity") / F.col("start_equity") - 1) * 100).alias("return_pct"),
        (F.col("_mdd") * 100).alias("max_drawdown_pct"), "buys", "sells", "fees", "realized_pnl", "through",
    )


def median_of_counts(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median through value counts: the window sees distinct values, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumns({
        "_hi": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy(*keys)),
    }).withColumn("_lo", F.col("_hi") - F.col("_n"))
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    at = lambda rank: F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col(value)))
    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(out))


def trade_stats(trades: DataFrame, key="symbol") -> DataFrame:
    """Buys, sells, fees and the median holding days of sells (NULL when none)."""
    keys = as_list(key)
    counted = trades.groupBy(*keys).agg(
        F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.sum("fee").alias("fees")
    )
    held = median_of_counts(trades.where("side = 'sell'"), keys, "hold_days", "median_hold_days")
    return counted.join(held, keys, "left")


def threshold_distribution(df: DataFrame, n: int = 0, key="symbol", ts: str = "date", score: str = "score") -> DataFrame:
    """Counts and shares of valid scores beyond each threshold in the last ``n`` rows (0 = all)."""
    keys = as_list(key)
    latest = df.groupBy(*keys).agg(F.max_by(finite(score), ts).alias("_latest"))
    rows = last_rows(df, n, keys, ts).join(latest, keys)
    x = finite(score)
    beyond = {"<=": lambda t: x <= t, ">": lambda t: x > t, ">=": lambda t: x >= t}
    counts = [F.count_if(beyond[op](t)).alias(f"_c{i}") for i, (t, op) in enumerate(DISTRIBUTION)]
    table = rows.groupBy(*keys).agg(
        F.count(x).alias("observations"), F.min(x).alias("observed_min"), F.max(x).alias("observed_max"),
        F.when(F.first("_latest").isNotNull(), F.count_if(x >= F.col("_latest"))).alias("at_or_above_current"), *counts,
    )
    bins = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.lit(op).alias("operator"), F.col(f"_c{i}").alias("count"))
        for i, (t, op) in enumerate(DISTRIBUTION)
    ])
    fixed = [*keys, "observations", "observed_min", "observed_max", "at_or_above_current"]
    out = table.select(*fixed, F.inline(bins))
    return out.withColumn("pct", F.col("count") / F.nullif(F.col("observations"), F.lit(0)) * 100)


def band_histogram(df: DataFrame, n: int = 0, key="symbol", ts: str = "date", score: str = "score") -> DataFrame:
    """Count and share per score band over the last ``n`` rows; every band appears for every key."""
    keys = as_list(key)
    rows = last_rows(df, n, keys, ts)
    bands = range(len(BAND_EDGES) - 1)
    table = rows.groupBy(*keys).agg(
        F.count(finite(score)).alias("observations"), *[F.count_if(band(score) == b).alias(f"_b{b}") for b in bands]
    )
    parts = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"_b{b}").alias("count")) for b in bands])
    out = table.select(*keys, "observations", F.inline(parts))
    return out.withColumn("share", F.col("count") / F.nullif(F.col("observations"), F.lit(0)))


def own_percentile(df: DataFrame, n: int = 0, key="symbol", ts: str = "date", score: str = "score") -> DataFrame:
    """Percent of valid scores at most the latest one, over the last ``n`` rows."""
    keys = as_list(key)
    latest = df.groupBy(*keys).agg(F.max_by(finite(score), ts).alias("current"))
    x = finite(score)
    rows = last_rows(df, n, keys, ts).join(latest, keys)
    return rows.groupBy(*keys).agg(
        F.first("current").alias("current"),
        (F.avg(F.when(x.isNotNull(), (x <= F.col("current")).cast("double"))) * 100).alias("percentile"),
    )


def catalog(df: DataFrame, today: Column, key="symbol", ts: str = "date") -> DataFrame:
    """First and last date, newest complete row, valid days, readiness and age. Input: close, score, score_rank."""
    keys = as_list(key)
    complete = finite("score").isNotNull() & finite("score_rank").isNotNull()
    newest = F.max_by(F.struct("close", "score", "score_rank", ts), F.when(complete, F.col(ts)))
    table = df.groupBy(*keys).agg(
        F.min(ts).alias("first_date"), F.max(ts).alias("latest_date"), F.count(finite("score")).alias("valid_score_days"),
        F.count_if(complete).alias("_ready"), newest.alias("_row"),
    )
    row = lambda c: F.when(F.col("_ready") > 0, F.col("_row")[c])
    return table.select(
        *keys, "first_date", "latest_date", row(ts).alias("score_date"), row("close").alias("close"), row("score").alias("score"),
        row("score_rank").alias("percentile"), "valid_score_days", (F.col("_ready") > 0).alias("ready"),
        F.datediff(today, "latest_date").alias("snapshot_age_days"),
    )


def mean_exposure(curve: DataFrame, key="symbol") -> DataFrame:
    return curve.groupBy(*as_list(key)).agg((F.avg(1 - F.col("cash") / F.col("equity")) * 100).alias("mean_exposure_pct"))


def weighted_hold(b: DataFrame, weights: Mapping[str, float], initial: float, cost: float, dates: DataFrame | None = None,
                  key: str = "symbol", ts: str = "date") -> DataFrame:
    """Net value per date of a portfolio bought once, at the first adjusted open, and held."""
    pairs = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    rows = b.where(F.col(key).isin(list(weights)))
    if dates is not None:
        rows = rows.join(dates.select(ts), ts, "left_semi")
    rows = rows.select(key, ts, (F.col("open") * F.col("adjusted_close") / F.col("close")).alias("_open"), "adjusted_close")
    first = rows.groupBy(key).agg(F.min_by("_open", ts).alias("_open0"))
    shares = first.select(key, (initial * pairs[F.col(key)] / (1 + cost) / F.col("_open0")).alias("_shares"))
    return rows.join(shares, key).groupBy(ts).agg(F.sum(F.col("_shares") * F.col("adjusted_close")).alias("equity"))


def board_counts(board: DataFrame) -> DataFrame:
    """Active signals, scores in fear, scores in greed (a missing score counts as 0)."""
    score = F.coalesce("score", F.lit(0.0))
    return board.agg(
        F.count_if(F.col("action").isNotNull() & (F.col("action") != "hold")).alias("active"),
        F.count_if(score <= -60).alias("fear"), F.count_if(score >= 60).alias("greed"),
    )


def cumulative_fees(trades: DataFrame, key="symbol", ts: str = "date") -> DataFrame:
    """Fills and fees per day with the running fee total."""
    daily = trades.groupBy(*as_list(key), ts).agg(F.count(F.lit(1)).alias("fills"), F.sum("fee").alias("fees"))
    return running(daily, key, ts, fees_cumulative=("sum", F.col("fees")))


def curve_array(curve: DataFrame, key="symbol", ts: str = "date") -> DataFrame:
    """Rounded curve of one run as an array of structs, the stored shape of a run (bounded by its days)."""
    money = ["equity", "buy_hold", "underlying_buy_hold", "cash"]
    point = F.struct(F.col(ts), *[F.round(c, 6).alias(c) for c in money], F.round("position", 4).alias("position"))
    return curve.groupBy(*as_list(key)).agg(
        F.min(ts).alias("start_date"), F.max(ts).alias("end_date"), F.array_sort(F.collect_list(point)).alias("equity_curve")
    )
