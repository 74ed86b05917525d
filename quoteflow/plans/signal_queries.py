"""Registered queries: crossings, ladder, evaluation and sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.operators import signals as sg
from quoteflow.operators.joins import next_open_fill
from quoteflow.operators.signals import ladder
from quoteflow.plans import evaluation as ev
from quoteflow.plans import fixtures as fx
from quoteflow.plans import observation as ob
from quoteflow.plans.registry import query, r, rounded
from quoteflow.plans.series_queries import NUMBERED, recursive

KEY = ["symbol", "date"]

# Score of the examples: the close inside its 21-row adjusted range, a quick -100..100 series.
SCORED = f"""{NUMBERED},
sc AS (SELECT symbol, date, rn AS bar, open * (adjusted_close / close) AS eo, adjusted_close AS ec,
  CASE WHEN count(*) OVER w >= 21 AND max(a_high) OVER w > min(a_low) OVER w THEN
    greatest(-100.0, least(100.0, (adjusted_close - min(a_low) OVER w) / (max(a_high) OVER w - min(a_low) OVER w) * 200 - 100)) END AS score
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
q AS (SELECT symbol, date, eo, ec, score, row_number() OVER w AS rn, coalesce(lag(score) OVER w, score) AS prev,
  lead(date) OVER w AS fill_date, lead(eo) OVER w AS fill_price
  FROM sc WHERE score IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def scored(spark, sf):
    from quoteflow.functions import series as fs
    from quoteflow.operators.timeline import Series
    from quoteflow.plans.scores import adjust_ohlc

    s = Series.cut(adjust_ohlc(fx.daily_bars(spark, sf)), 21)
    s = s.add(score=fs.stochastic(s, "a_high", "a_low", "a_close", 21))
    return s.done().select(
        *KEY, "open", "close", "score", F.col("a_open").alias("execution_open"), F.col("a_close").alias("execution_close"), "adjusted_close"
    )


LEVELS = [(-60, "down"), (-75, "down"), (-90, "down"), (60, "up"), (75, "up"), (90, "up")]


@query("sg1_crossings", f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT symbol, date, {r('prev', 'prev')}, {r('score', 'score')}, {level}::DOUBLE AS level, '{d}' AS direction FROM q WHERE "
    + (f"prev > {level} AND {level} >= score" if d == "down" else f"prev < {level} AND {level} <= score") for level, d in LEVELS))
def _(spark, sf):
    return rounded(sg.crossings(scored(spark, sf)), 4, "prev", "score")


def bits_sql(hit: str, mask: str, bit: int) -> str:
    return f"(CASE WHEN {hit} AND ({mask} & {1 << bit}) = 0 THEN {1 << bit} ELSE 0 END)"


def lowest_sql(bits: str, count: str) -> str:
    """The ``count`` lowest of three bits."""
    first = f"({bits} & 1)"
    second = f"(CASE WHEN ({bits} & 2) > 0 AND {count} > ({bits} & 1) THEN 2 ELSE 0 END)"
    third = f"(CASE WHEN ({bits} & 4) > 0 AND {count} > ({bits} & 1) + (({bits} & 2) // 2) THEN 4 ELSE 0 END)"
    return f"(CASE WHEN {count} > 0 THEN {first} + {second} + {third} ELSE 0 END)"


def ladder_cte(name: str, source: str, keys: str, buys: list[str], sells: list[str], account: bool = False, friction: str = "0") -> str:
    """Row by row walk of the ladder (and optionally of the account) as a recursive CTE over ``source`` numbered by rn."""
    on = " AND ".join(f"s.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    down = " + ".join(f"(CASE WHEN s.prev > {b} AND {b} >= s.score THEN {1 << i} ELSE 0 END)" for i, b in enumerate(buys))
    up = " + ".join(f"(CASE WHEN s.prev < {u} AND {u} <= s.score THEN {1 << i} ELSE 0 END)" for i, u in enumerate(sells))
    keyed = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    walk = f"""{name}_b AS (SELECT s.*, {down} AS down, {up} AS up FROM {source} s),
{name} AS (
  SELECT {keyed}, s.rn, 0 AS delta, 0 AS steps, 0 AS bm, 0 AS sm{', 1.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 0.0::DOUBLE AS basis, 0.0::DOUBLE AS trade, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pnl, 0 AS filled' if account else ''}
    FROM {name}_b s WHERE s.rn = 1
  UNION ALL
  SELECT {keyed.replace('s.', 'd.')}, d.rn, d.delta, d.steps + d.delta AS steps,
    CASE WHEN d.steps + d.delta = 0 AND d.delta < 0 THEN 0 WHEN d.delta > 0 THEN d.bm + d.take ELSE d.bm END AS bm,
    CASE WHEN d.steps + d.delta = 0 AND d.delta < 0 THEN 0 WHEN d.delta < 0 THEN d.sm + d.take ELSE d.sm END AS sm
    {', d.cash2, d.units2, d.basis2, d.trade, d.cost, d.pnl, d.filled' if account else ''}
  FROM (SELECT c.*, CASE WHEN nb > 0 THEN nb WHEN ns > 0 THEN -ns ELSE 0 END AS delta,
      CASE WHEN nb > 0 THEN {lowest_sql('fb', 'nb')} ELSE {lowest_sql('fs', 'ns')} END AS take
    FROM (SELECT b.*, least(bit_count(fb), 3 - steps) AS nb, least(bit_count(fs), steps) AS ns
      FROM (SELECT {keyed}, s.rn, e.steps, e.bm, e.sm, s.down & ~e.bm AS fb, s.up & ~e.sm AS fs{account_sql(friction) if account else ''}
        FROM {name} e JOIN {name}_b s ON {on} AND s.rn = e.rn + 1) b) c) d)"""
    return walk


def account_sql(friction: str) -> str:
    """Account after the open of row s, given the state e after row s-1 (a decision of row s-1 fills here)."""
    trade = "((e.cash + e.units * s.eo) * (e.steps / 3) - e.units * s.eo)"
    cost = f"(abs({trade}) * {friction})"
    sold = f"least(1.0, abs({trade} / s.eo) / e.units)"
    return f""", (e.delta <> 0)::INT AS filled,
  CASE WHEN e.delta <> 0 THEN {trade} ELSE 0 END AS trade, CASE WHEN e.delta <> 0 THEN {cost} ELSE 0 END AS cost,
  CASE WHEN e.delta <> 0 AND {trade} <= 0 AND e.units > 0 THEN abs({trade}) - {cost} - e.basis * {sold} ELSE 0 END AS pnl,
  CASE WHEN e.delta <> 0 THEN e.cash - ({trade} + {cost}) ELSE e.cash END AS cash2,
  CASE WHEN e.delta <> 0 THEN CASE WHEN e.steps = 0 THEN 0 ELSE e.units + {trade} / s.eo END ELSE e.units END AS units2,
  CASE WHEN e.delta = 0 THEN e.basis WHEN {trade} > 0 THEN e.basis + {trade} + {cost} WHEN e.units > 0 THEN e.basis - e.basis * {sold} ELSE e.basis END AS basis2"""


BUYS, SELLS = ["-60", "-75", "-90"], ["60", "75", "90"]
ACTION = """CASE WHEN w.delta > 0 THEN CASE WHEN w.steps = w.delta THEN 'buy' ELSE 'add' END
  WHEN w.delta < 0 THEN CASE WHEN w.steps = 0 THEN 'exit' ELSE 'reduce' END ELSE 'hold' END"""


@query("sg2_ladder", f"""{recursive(SCORED, ladder_cte('w', 'q', 'symbol', BUYS, SELLS))}
SELECT q.symbol, q.date, {r('q.score', 'score')}, w.delta, w.steps, w.bm AS buy_mask, w.sm AS sell_mask, {ACTION} AS action,
  sum((w.delta > 0 AND w.steps = w.delta)::INT) OVER (PARTITION BY w.symbol ORDER BY w.rn)::BIGINT AS cycle
FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn WHERE w.delta <> 0""")
def _(spark, sf):
    return rounded(ladder(scored(spark, sf)), 4, "score")


@query("jn9_next_open_fill", f"""{recursive(SCORED, ladder_cte('w', 'q', 'symbol', BUYS, SELLS))}
SELECT q.symbol, q.date, w.delta, q.fill_date, q.fill_price FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn WHERE w.delta <> 0""")
def _(spark, sf):
    rows = scored(spark, sf)
    return next_open_fill(ladder(rows).select(*KEY, "delta"), rows.where("score IS NOT NULL"), price="execution_open")


ACCOUNT = recursive(SCORED, ladder_cte("w", "q", "symbol", BUYS, SELLS, True, "0.0015::DOUBLE"))


@query("sg5_equity_curve", f"""{ACCOUNT}
SELECT q.symbol, q.date, {r('ln(w.cash + w.units * q.ec)', 'log_equity', 6)}, {r('(w.steps - w.delta) / 3', 'position', 6)} FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn""")
def _(spark, sf):
    curve, _ = ev.evaluate(scored(spark, sf))
    return rounded(curve.select(*KEY, F.log("equity").alias("log_equity"), "position"), 6, "log_equity", "position")


@query("sg5_trades", f"""{ACCOUNT}
SELECT q.symbol, q.date, q.eo AS price, CASE WHEN w.trade > 0 THEN 'buy' ELSE 'sell' END AS side, {r('ln(abs(w.trade))', 'log_value', 6)}, {r('w.cost / abs(w.trade)', 'cost_share', 6)},
  {r('w.pnl / abs(w.trade)', 'pnl_share', 6)} FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn WHERE w.filled = 1""")
def _(spark, sf):
    _, trades = ev.evaluate(scored(spark, sf))
    out = trades.select(
        *KEY, "price", "side", F.log("value").alias("log_value"), (F.col("cost") / F.col("value")).alias("cost_share"),
        (F.col("realized_pnl") / F.col("value")).alias("pnl_share"),
    )
    return rounded(out, 6, "log_value", "cost_share", "pnl_share")


@query("ts30_walk_split", f"""WITH {SCORED}, t AS (SELECT symbol, date, rn, count(*) OVER (PARTITION BY symbol) AS n FROM q),
f AS (SELECT symbol, date, rn, n, ntile(3) OVER (PARTITION BY symbol ORDER BY rn) AS fold FROM t WHERE rn <= floor(n * 0.8::DOUBLE)),
g AS (SELECT *, count(*) OVER (PARTITION BY symbol, fold) AS size FROM f)
SELECT symbol, date, rn AS pos, n, fold::INT AS fold FROM g WHERE size >= 100 UNION ALL SELECT symbol, date, rn, n, 0 FROM t WHERE rn > floor(n * 0.8::DOUBLE)""")
def _(spark, sf):
    return ev.walk_split(scored(spark, sf).where("score IS NOT NULL").select(*KEY)).select(*KEY, "pos", "n", "fold")


SWEEP = recursive(
    SCORED,
    """t AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM q),
f AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY rn) AS fold FROM t WHERE rn <= floor(n * 0.8::DOUBLE) AND n >= 504),
g AS (SELECT symbol, date, eo, ec, score, rn, fold FROM f UNION ALL SELECT symbol, date, eo, ec, score, rn, 0 FROM t WHERE rn > floor(n * 0.8::DOUBLE) AND n >= 504),
p AS (SELECT symbol, date, eo, ec, score, fold, count(*) OVER (PARTITION BY symbol, fold) AS size, row_number() OVER w AS rn, coalesce(lag(score) OVER w, score) AS prev
  FROM g WINDOW w AS (PARTITION BY symbol, fold ORDER BY rn)),
grid AS (SELECT (b.i * 8 + s.i)::INT AS run, -45 - 5 * b.i AS b1, 45 + 5 * s.i AS s1, f.friction::DOUBLE AS friction
  FROM range(8) b(i), range(8) s(i), (VALUES (5), (15), (30)) f(friction)),
gr AS (SELECT *, -least(95, -b1 + 15) AS b2, -least(95, -b1 + 30) AS b3, least(95, s1 + 15) AS s2, least(95, s1 + 30) AS s3 FROM grid),
x AS (SELECT p.*, gr.* FROM p, gr WHERE fold = 0 OR size >= 100)""",
    ladder_cte("w", "x", "symbol, fold, run, friction", [f"s.b{i}" for i in (1, 2, 3)], [f"s.s{i}" for i in (1, 2, 3)], True, "(s.friction / 10000)"),
    """c AS (SELECT w.symbol, w.fold, w.run, w.friction, w.rn, w.cash + w.units * p.ec AS equity FROM w JOIN p ON p.symbol = w.symbol AND p.fold = w.fold AND p.rn = w.rn),
d AS (SELECT *, equity / lag(equity) OVER v - 1 AS r, equity / max(equity) OVER (v ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c WINDOW v AS (PARTITION BY symbol, fold, run, friction ORDER BY rn)),
m AS (SELECT symbol, fold, run, friction, count(*) AS n, arg_min(equity, rn) AS e0, arg_max(equity, rn) AS e1, avg(r) AS mean, stddev_samp(r) AS std, min(dd) AS mdd FROM d GROUP BY ALL),
tr AS (SELECT symbol, fold, run, friction, count(*)::DOUBLE AS trades, sum(abs(trade)) AS turnover FROM w WHERE filled = 1 GROUP BY ALL),
k AS (SELECT m.symbol, m.fold, m.run, m.friction, e1 / e0 - 1 AS total_return, (e1 / e0) ** (252 / n) - 1 AS cagr, mdd, CASE WHEN std > 0 THEN mean / std * sqrt(252) ELSE 0 END AS sharpe,
  coalesce(trades, 0) AS trades, coalesce(turnover, 0) AS turnover FROM m LEFT JOIN tr USING (symbol, fold, run, friction)),
res AS (SELECT *, CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0 END AS calmar FROM k)""",
)


@query("sg6_sweep", f"""{SWEEP} SELECT symbol, fold::INT AS fold, run, friction, {r('ln(1 + total_return)', 'log_return', 4)}, {r('sharpe', 'sharpe', 4)}, {r('mdd', 'max_drawdown', 4)},
  {r('ln(1 + abs(calmar))', 'log_calmar', 4)}, trades, {r('ln(1 + turnover)', 'log_turnover', 4)} FROM res""")
def _(spark, sf):
    return sweep_table(ev.sweep(scored(spark, sf)))


def sweep_table(results):
    out = results.select(
        "symbol", "fold", "run", "friction", F.log(1 + F.col("total_return")).alias("log_return"), "sharpe", "max_drawdown",
        F.log(1 + F.abs("calmar")).alias("log_calmar"), "trades", F.log(1 + F.col("turnover")).alias("log_turnover"),
    )
    return rounded(out, 4, "log_return", "sharpe", "max_drawdown", "log_calmar", "log_turnover")


@query("agg17_agg18_sweep_choice", f"""{SWEEP},
b0 AS (SELECT symbol, run, median(calmar) + 0.25::DOUBLE * median(sharpe) - 0.02::DOUBLE * median(turnover) AS sc FROM res WHERE fold > 0 GROUP BY symbol, run
  HAVING sum(trades) >= 6 AND min(calmar) > 0),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sc DESC, run) = 1),
h AS (SELECT symbol, run, sc, sum(trades) AS t, median(total_return) AS mr, median(calmar) AS mc FROM res JOIN b USING (symbol, run) WHERE fold = 0 GROUP BY ALL)
SELECT s.symbol, {r('ln(abs(sc))', 'log_robust_score', 4)}, t AS holdout_trades, {r('ln(1 + mr)', 'log_median_return', 4)}, {r('ln(1 + abs(mc))', 'log_median_calmar', 4)},
  CASE WHEN t >= 1 AND mr > 0 THEN run END AS run, CASE WHEN t >= 1 AND mr > 0 THEN CASE WHEN t >= 6 AND mc >= 0.5 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence
FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN h USING (symbol)""")
def _(spark, sf):
    rows = scored(spark, sf)
    results = ev.sweep(rows)
    out = ev.holdout_gate(rows, ev.sweep_best(results), results)
    out = out.select(
        "symbol", F.log(F.abs("training_robust_score")).alias("log_robust_score"), "holdout_trades", "run", "confidence",
        F.log(1 + F.col("holdout_median_return")).alias("log_median_return"), F.log(1 + F.abs("holdout_median_calmar")).alias("log_median_calmar"),
    )
    return rounded(out, 4, "log_robust_score", "log_median_return", "log_median_calmar")


@query("sc5_signal_history", f"""{recursive(SCORED, ladder_cte('w', 'q', 'symbol', BUYS, SELLS))},
l AS (SELECT sc.symbol, sc.date, n.close AS price, score FROM sc JOIN n ON n.symbol = sc.symbol AND n.date = sc.date QUALIFY row_number() OVER (PARTITION BY sc.symbol ORDER BY sc.date DESC) <= 756),
m AS (SELECT q.symbol, q.date, w.delta, w.steps, {ACTION} AS action FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn WHERE w.delta <> 0)
SELECT l.symbol, l.date, price, {r('l.score', 'score')}, coalesce(m.action, 'hold') AS action, m.steps FROM l LEFT JOIN m ON m.symbol = l.symbol AND m.date = l.date""")
def _(spark, sf):
    out = ob.signal_history(scored(spark, sf), [float(b) for b in BUYS], [float(x) for x in SELLS])
    return rounded(out.drop("buy_thresholds", "sell_thresholds"), 4, "score")
