"""Evaluating ladder thresholds on scored bars: one run, a sweep over a grid, and the choice among its results.

A run is not a loop over days. Crossings give the decisions (a 256-state scan), each decision fills at the next open, and
the account only compounds between flat points: a cycle from flat to flat has at most six fills because every level fires
once per cycle. Cycles are folded independently from a unit of cash and scaled by the product of the cycles before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.operators.joins import DEFAULT_BUYS, DEFAULT_SELLS
from quoteflow.operators.metrics import performance_columns
from quoteflow.operators.ranking import argmax_first
from quoteflow.operators.signals import STEPS, crossing_events, ladder_on
from quoteflow.operators.timeline import CHUNK, CHUNK_ROWS, PRED, SUCC, Series, as_list, place, placement_of, positions, running_on, unplace
from quoteflow.session import settle

# Sweep grid, spacing of the levels, friction in basis points, gates of the choice.
GRID_BUYS = range(-45, -81, -5)
GRID_SELLS = range(45, 81, 5)
SPACING, LEVEL_LIMIT = 15, 95
FRICTIONS = (5, 15, 30)
MIN_ROWS, MIN_FOLD, MIN_RUN = 504, 100, 3
MIN_TRADES = 6


def walk_split(df: DataFrame, share: float = 0.8, folds: int = 3, key="symbol", ts: str = "date") -> DataFrame:
    """Chronological split: training folds 1..n of near-equal size (short ones dropped), then fold 0 = holdout."""
    rows = positions(df, key, ts)
    train = F.floor(F.col("n") * share)
    small, extra = F.floor(train / folds), train % folds
    edge = extra * (small + 1)
    fold = F.when(F.col("pos") <= edge, F.ceil(F.col("pos") / (small + 1))).otherwise(extra + F.ceil((F.col("pos") - edge) / small))
    rows = rows.withColumn("fold", F.when(F.col("pos") > train, 0).otherwise(fold).cast("int"))
    length = small + (F.col("fold") <= extra).cast("int")
    return rows.where((F.col("fold") == 0) | (length >= MIN_FOLD))


def threshold_levels(first: int, direction: int) -> list[float]:
    return [float(direction * min(LEVEL_LIMIT, abs(first) + SPACING * i)) for i in range(STEPS)]


def grid_array(pairs: Sequence[tuple[Sequence[float], Sequence[float]]]) -> Column:
    """The threshold pairs of a sweep as one literal array (its size is fixed by the grid, not by data)."""
    return F.array(*[
        F.struct(F.lit(i).alias("run"), F.array(*map(F.lit, map(float, b))).alias("buys"), F.array(*map(F.lit, map(float, s))).alias("sells"))
        for i, (b, s) in enumerate(pairs)
    ])


def sweep_pairs() -> list[tuple[list[float], list[float]]]:
    return [(threshold_levels(b, -1), threshold_levels(s, 1)) for b in GRID_BUYS for s in GRID_SELLS]


def prepare(scored: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Usable rows (placed) with the score and close before, and the next row's date and open.

    ``scored`` has open, close, score and optionally execution_open/execution_close (used instead when present).
    """
    keys = as_list(key)
    rows = scored.na.drop(subset=["open", "close", "score"])
    price = lambda c: F.col(f"execution_{c}") if f"execution_{c}" in scored.columns else F.col(c)
    rows = rows.select(*keys, ts, price("open").alias("_open"), price("close").alias("_close"), "score")
    s = Series.cut(place(rows, 1, 1, keys, ts, size), 1, keys, ts, ahead=1)
    return s.add(
        prev=F.coalesce(F.lag("score").over(s.window()), F.col("score")), _before=F.lag("_close").over(s.window()),
        fill_date=F.lead(ts).over(s.window()), fill_price=F.lead("_open").over(s.window()),
    ).done()


def decisions(rows: DataFrame, pairs, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Ladder decisions of every threshold pair, with their fill; the last decision of a key never fills."""
    keys = as_list(key)
    runs = rows.select(*keys, ts, "score", "prev", "fill_date", "fill_price", *placement_of(rows), F.inline(grid_array(pairs)))
    levels = lambda c: [F.element_at(c, i + 1) for i in range(STEPS)]
    events = crossing_events(runs, levels("buys"), levels("sells")).drop("buys", "sells")
    return unplace(ladder_on(events, [*keys, "run"], ts, size)).where("delta <> 0 AND fill_date IS NOT NULL")


def _fill_step(friction: Column):
    """Fold of one cycle: state and the list of its fills, from one unit of cash.

    A fill moves the account to a share of its worth, so cash and units after it follow from the worth and the fee. The cost basis goes through an affine
    map a fill: a buy adds what it paid, a sell leaves the part that it does not sell and gains its proceeds less the rest.
    """

    def step(acc, fill):
        price, share = fill["price"], fill["steps"] / STEPS
        holding = acc["units"] * price
        worth = acc["cash"] + holding
        trade = worth * share - holding
        cost = friction * F.abs(trade)
        out = (trade <= 0) & (holding > 0)
        left = F.when(out, F.greatest(F.lit(0.0), 1 + trade / holding)).otherwise(1.0)
        paid = F.when(trade > 0, trade + cost).otherwise(0.0)
        basis = left * acc["basis"] + paid
        pnl = F.when(out, -trade - cost - (1 - left) * acc["basis"]).otherwise(0.0)
        cash, units = worth * (1 - share) - cost, F.when(fill["steps"] == 0, 0.0).otherwise(worth * share / price)
        record = F.struct(
            fill["date"].alias("date"), price.alias("price"), fill["steps"].alias("steps"), cash.alias("cash"), units.alias("units"),
            trade.alias("trade"), cost.alias("cost"), pnl.alias("realized_pnl"),
            acc["cash"].alias("cash0"), acc["units"].alias("units0"),
        )
        return F.struct(cash.alias("cash"), units.alias("units"), basis.alias("basis"), F.array_append(acc["fills"], record).alias("fills"))

    return step


def fills(made: DataFrame, frictions: Sequence[float], key="symbol", size: int = CHUNK_ROWS) -> DataFrame:
    """Fills with the account after them, per (key, run, friction)."""
    run = [*as_list(key), "run", "friction"]
    cycle = made.groupBy(*as_list(key), "run", "cycle").agg(
        F.array_sort(F.collect_list(F.struct(F.col("fill_date").alias("date"), F.col("fill_price").alias("price"), "steps"))).alias("_fills")
    )
    each = cycle.withColumn("friction", F.explode(F.array(*[F.lit(float(f)) for f in frictions])))
    record = "array<struct<date:date,price:double,steps:int,cash:double,units:double,trade:double,cost:double,realized_pnl:double,cash0:double,units0:double>>"
    start = F.struct(F.lit(1.0).alias("cash"), F.lit(0.0).alias("units"), F.lit(0.0).alias("basis"), F.array().cast(record).alias("fills"))
    folded = each.withColumn("_end", F.aggregate("_fills", start, _fill_step(F.col("friction") / 10_000)))
    s = Series.cut(folded.select(*run, "cycle", "_end"), 1, run, "cycle", size)
    s = s.add(_gain=F.coalesce(s.let(F.lag(F.col("_end")["cash"]).over(s.window())), F.lit(1.0)))
    scaled = running_on(s, _scale=("product", F.col("_gain"))).done()
    rows = scaled.select(*run, "cycle", "_scale", F.inline(F.col("_end")["fills"]))
    money = ("cash", "units", "trade", "cost", "realized_pnl", "cash0", "units0")
    return rows.withColumns({c: F.col(c) * F.col("_scale") for c in money}).drop("_scale")


def trades_of(made: DataFrame) -> DataFrame:
    return made.withColumns({"side": F.when(F.col("trade") > 0, "buy").otherwise("sell"), "value": F.abs("trade")})


def curves(rows: DataFrame, filled: DataFrame, pairs, frictions, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> Series:
    """Equity, its change and the position per bar and run, still cut into chunks.

    The account before a row is the one before its fill, so the change needs no look-back at the curve itself.
    """
    keys = as_list(key)
    run = [*keys, "run", "friction"]
    ids = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(float(f)).alias("friction")) for i in range(len(pairs)) for f in frictions])
    state = filled.select(*run, F.col("date").alias(ts), F.struct("cash", "units", "steps", "cash0", "units0").alias("_state"))
    bars = rows.select(*keys, ts, "_close", "_before", *placement_of(rows), F.inline(ids)).join(state, [*run, ts], "left")
    s = running_on(Series.cut(bars, 0, run, ts, size), _last=("last", F.col("_state")))
    last, now = F.col("_last"), F.col("_state")
    worth = lambda account, cash, units, price: F.when(account.isNull(), 1.0).otherwise(account[cash] + account[units] * F.col(price))
    before = F.when(now.isNotNull(), worth(now, "cash0", "units0", "_before")).otherwise(worth(last, "cash", "units", "_before"))
    s = s.add(
        equity=worth(last, "cash", "units", "_close"), position=F.coalesce(last["steps"], F.lit(0)) / STEPS,
        _prior=F.when(F.col("_before").isNotNull(), before),
    )
    return s.add(change=F.col("equity") / F.col("_prior") - 1)


def evaluate(scored: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS, bps: float = 15,
             key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(equity curve, trades) of one threshold pair for every key. Keys with fewer than three usable rows give none."""
    keys = as_list(key)
    pairs = [(buys, sells)]
    rows = settle(enough_rows(prepare(scored, keys, ts, size), keys))  # read by the decision scan and by the curves
    filled = settle(fills(decisions(rows, pairs, keys, ts, size), [bps], keys, size))
    curve = unplace(curves(rows, filled, pairs, [bps], keys, ts, size).done())
    return curve.select(*keys, ts, "equity", "position"), trades_of(filled).drop("run", "friction", "cycle")


def enough_rows(rows: DataFrame, key) -> DataFrame:
    keys = as_list(key)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= MIN_RUN)
    return rows.join(counted.select(*keys), keys, "left_semi")  # whole keys go, so the placement stays valid


#: runs whose equity is held at once per chunk; bounds the memory of a task
RUN_BLOCK = 48
PARTIAL = "run int, friction double, _n long, _first double, _last double, _k long, _m double, _m2 double, _up long, _mdd double, _top double"


def _paths(bars: pd.DataFrame, states: pd.DataFrame, ts: str, frictions: Sequence[float], columns: np.ndarray):
    """(equity, change) of the given runs over a chunk's bars, one column each; ``states`` are its fills, and with a null time what came before the chunk."""
    close, before = bars["_close"].to_numpy(dtype=float)[:, None], bars["_before"].to_numpy(dtype=float)[:, None]
    column = states["run"].to_numpy(dtype=np.int64) * len(frictions) + np.searchsorted(frictions, states["friction"].to_numpy(dtype=float))
    wanted = np.isin(column, columns)
    states, column = states[wanted], np.searchsorted(columns, column[wanted])
    cash, units = states["cash"].to_numpy(dtype=float), states["units"].to_numpy(dtype=float)
    seed, when = states[ts].isna().to_numpy(), pd.to_datetime(states[ts]).to_numpy()
    # row 0 is the account before the chunk, one unit of cash where there was no fill yet; k + 1 is the one after bar k
    held = np.full((len(bars) + 1, len(columns)), -1, dtype=np.int64)
    row = np.where(seed, 0, np.searchsorted(pd.to_datetime(bars[ts]).to_numpy(), when) + 1)
    order = np.lexsort([row])
    held[row[order], column[order]] = np.arange(len(order))
    held = np.maximum.accumulate(held, axis=0)
    cash, units = np.append(cash[order], 1.0)[held], np.append(units[order], 0.0)[held]
    equity, prior = cash[1:] + units[1:] * close, cash[:-1] + units[:-1] * before
    return equity, equity / prior - 1


def _partials(ts: str, n_pairs: int, frictions: Sequence[float], tops_only: bool):
    """One row per run of what a chunk adds to its metrics; with ``tops_only`` just the highest equity."""
    levels = np.array(sorted(frictions), dtype=float)

    def run(bars: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        bars, out = bars.sort_values(ts), []
        for start in range(0, n_pairs * len(levels), RUN_BLOCK) if len(bars) else ():
            columns = np.arange(start, min(start + RUN_BLOCK, n_pairs * len(levels)))
            equity, change = _paths(bars, states, ts, levels, columns)
            names = {"run": columns // len(levels), "friction": levels[columns % len(levels)]}
            if tops_only:
                out.append(pd.DataFrame({**names, "_top": equity.max(axis=0)}))
                continue
            before = np.full(len(columns), -np.inf)
            seeds = states[states[ts].isna() & states["_top"].notna()]
            at = seeds["run"].to_numpy(dtype=np.int64) * len(levels) + np.searchsorted(levels, seeds["friction"].to_numpy(dtype=float)) - start
            mine = (at >= 0) & (at < len(columns))
            before[at[mine]] = seeds["_top"].to_numpy(dtype=float)[mine]
            peak = np.maximum(np.maximum.accumulate(equity, axis=0), before)
            known = np.isfinite(change)
            k = known.sum(axis=0)
            mean = np.where(known, change, 0.0).sum(axis=0) / np.maximum(k, 1)
            off = np.where(known, change - mean, 0.0)
            out.append(pd.DataFrame({
                **names, "_n": len(bars), "_first": equity[0], "_last": equity[-1], "_k": k, "_m": mean, "_m2": (off * off).sum(axis=0),
                "_up": (known & (change > 0)).sum(axis=0), "_mdd": (equity / peak - 1).min(axis=0), "_top": equity.max(axis=0),
            }))
        head = bars.iloc[[0]][[c for c in bars.columns if c not in (ts, "_close", "_before")]]
        return head.merge(pd.concat(out), how="cross") if out else pd.DataFrame()

    return run


def _renewed(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own: both sides of a cogroup come from the bars here."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def run_metrics(rows: DataFrame, pairs, frictions, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Performance of every (key, run, friction).

    Bars are never copied per run: each chunk of bars meets the fills of all runs in it, and gives one row a run. A chunk that has others before it also
    gets each run's account and highest equity from them.
    """
    keys = as_list(key)
    run, part = [*keys, "run", "friction"], [*keys, CHUNK]
    rows = settle(rows)  # both are read twice
    filled = settle(fills(decisions(rows, pairs, keys, ts, size), frictions, keys, size))
    bars = rows.select(*part, ts, "_close", "_before")
    placed = filled.withColumnRenamed("date", ts) if ts != "date" else filled
    own = placed.join(rows.select(*keys, ts, CHUNK), [*keys, ts]).select(*part, "run", "friction", ts, "cash", "units")
    blank = {ts: F.lit(None).cast(rows.schema[ts].dataType), "_top": F.lit(None).cast("double")}

    # only keys of several chunks have rows from here on
    cut = rows.where(F.col(PRED).isNotNull() | F.col(SUCC).isNotNull()).select(*part).distinct()
    ids = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(float(f)).alias("friction")) for i in range(len(pairs)) for f in frictions])
    grid = cut.select(*part, F.inline(ids))
    ends = own.groupBy(*part, "run", "friction").agg(F.max_by(F.struct("cash", "units"), ts).alias("_end"))
    earlier = Window.partitionBy(*run).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk and run
    seeds = grid.join(ends, [*part, "run", "friction"], "left").withColumn("_seed", F.last("_end", ignorenulls=True).over(earlier))
    seeds = seeds.select(*part, "run", "friction", "_seed.cash", "_seed.units").withColumns(blank)
    states = own.withColumn("_top", blank["_top"]).unionByName(seeds.where("cash IS NOT NULL"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in part)
    tops = bars.join(cut, part, "left_semi").groupBy(*part).cogroup(_renewed(states).groupBy(*part)).applyInPandas(
        _partials(ts, len(pairs), frictions, True), f"{head}, run int, friction double, _top double")
    before = tops.withColumn("_top", F.max("_top").over(earlier)).where("_top IS NOT NULL")
    seeded = seeds.drop("_top").join(before, [*part, "run", "friction"], "left")
    first = F.coalesce("cash", F.lit(1.0)).alias("cash"), F.coalesce("units", F.lit(0.0)).alias("units")
    states = own.withColumn("_top", blank["_top"]).unionByName(seeded.select(*part, "run", "friction", ts, *first, "_top"))
    partial = bars.groupBy(*part).cogroup(_renewed(states).groupBy(*part)).applyInPandas(_partials(ts, len(pairs), frictions, False), f"{head}, {PARTIAL}")
    table = partial.groupBy(*run).agg(
        F.sum("_n").alias("_n"), F.min_by("_first", CHUNK).alias("_first"), F.max_by("_last", CHUNK).alias("_last"), F.min("_mdd").alias("_mdd"),
        F.sum("_k").alias("_k"), (F.sum(F.col("_k") * F.col("_m")) / F.nullif(F.sum("_k"), F.lit(0))).alias("_mean"),
        (F.sum("_m2") + F.sum(F.col("_k") * F.col("_m") * F.col("_m"))).alias("_squares"), (F.sum("_up") / F.nullif(F.sum("_k"), F.lit(0))).alias("_gains"),
    )
    spread = F.col("_squares") - F.col("_k") * F.col("_mean") * F.col("_mean")
    table = table.withColumn("_std", F.when(F.col("_k") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("_k") - 1))))
    made = trades_of(filled).groupBy(*run).agg(
        F.count(F.lit(1)).cast("double").alias("_t"), F.sum("value").alias("_turn"), F.count_if(F.col("side") == "sell").alias("_exits"),
        F.count_if((F.col("side") == "sell") & (F.col("realized_pnl") > 0)).alias("_wins"),
    )
    return table.join(made, run, "left").select(*run, *performance_columns())


def sweep(scored: DataFrame, pairs=None, frictions: Sequence[float] = FRICTIONS, key: str = "symbol", ts: str = "date",
          size: int = CHUNK_ROWS) -> DataFrame:
    """Metrics of every threshold pair, friction and fold (0 = holdout) of the keys with enough history."""
    pairs = pairs or sweep_pairs()
    usable = scored.na.drop(subset=["open", "close", "score"])
    split = walk_split(usable, key=key, ts=ts).where(F.col("n") >= MIN_ROWS)
    rows = prepare(split, [key, "fold"], ts, size)
    return run_metrics(rows, pairs, frictions, [key, "fold"], ts, size)


def sweep_best(results: DataFrame, key: str = "symbol") -> DataFrame:
    """Best run per key over the training folds: median Calmar + median Sharpe / 4 - median turnover / 50.

    Runs need six trades in total and a positive worst Calmar; the first run of the grid wins ties.
    The medians are over folds x frictions, at most nine values.
    """
    table = results.where("fold > 0").groupBy(key, "run").agg(
        F.sum("trades").alias("total_trades"), F.min("calmar").alias("min_calmar"),
        (F.median("calmar") + 0.25 * F.median("sharpe") - 0.02 * F.median("turnover")).alias("training_robust_score"),
    )
    eligible = table.where((F.col("total_trades") >= MIN_TRADES) & (F.col("min_calmar") > 0))
    return argmax_first(eligible, "training_robust_score", ["run"], key)


def holdout_gate(keys: DataFrame, best: DataFrame, results: DataFrame, key: str = "symbol") -> DataFrame:
    """Confidence per key: the chosen run must trade and earn on the holdout, else the default thresholds (run NULL) stay."""
    held = results.where("fold = 0").join(best.select(key, "run", "training_robust_score"), [key, "run"])
    table = held.groupBy(key).agg(
        F.first("run").alias("_run"), F.first("training_robust_score").alias("training_robust_score"),
        F.sum("trades").alias("holdout_trades"), F.median("total_return").alias("holdout_median_return"),
        F.median("calmar").alias("holdout_median_calmar"),
    )
    passed = (F.col("holdout_trades") >= 1) & (F.col("holdout_median_return") > 0)
    level = F.when((F.col("holdout_trades") >= MIN_TRADES) & (F.col("holdout_median_calmar") >= 0.5), "high").otherwise("medium")
    joined = keys.select(key).distinct().join(table, key, "left")
    return joined.withColumns({
        "run": F.when(passed, F.col("_run")),
        "confidence": F.when(F.coalesce(passed, F.lit(False)), level).otherwise("low"),
    }).drop("_run")


def rotate_profiles(profiles: DataFrame, new: DataFrame, now: Column, days: int = 30, key: str = "symbol") -> DataFrame:
    """Deactivate the active profile of keys due for calibration and append the new row.

    Due: the newest active profile is the fallback, or at least ``days`` old, or there is none.
    """
    current = profiles.where("active").groupBy(key).agg(F.max_by(F.struct("created_at", "method"), "created_at").alias("_p"))
    fresh = (F.col("_p")["method"] != "fallback") & (F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("_p")["created_at"])) / 86400) < days)
    due = new.select(key).join(current, key, "left").where(~F.coalesce(fresh, F.lit(False))).select(key, F.lit(True).alias("_due"))
    kept = profiles.join(due, key, "left").withColumn("active", F.col("active") & F.col("_due").isNull()).drop("_due")
    added = new.join(due, key, "left_semi").withColumns({"active": F.lit(True), "created_at": now})
    return kept.unionByName(added)
