"""Registered queries: joins, rates, splits, books, metrics, distributions, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.functions import scalars as sc
from quoteflow.operators import books, joins, metrics, ranking
from quoteflow.plans import fixtures as fx
from quoteflow.plans import scores
from quoteflow.plans.evaluation import rotate_profiles
from quoteflow.plans.registry import query, r, rounded

KEY = ["symbol", "date"]

# --- projections ---------------------------------------------------------------------------------------------

PRICED = f"{fx.BARS}, sx AS (SELECT symbol, date, open, high, low, close, adjusted_close, (adjusted_close / close - 0.95) * 2000 AS score FROM bars)"


def with_score(spark, sf):
    """A score per bar derived from its adjustment: 100 at no discount, -100 at ten percent."""
    return fx.daily_bars(spark, sf).withColumn("score", (F.col("adjusted_close") / F.col("close") - 0.95) * 2000)


@query("prj1_adjust_ohlc", f"""WITH {fx.BARS} SELECT symbol, date, open * (adjusted_close / close) AS a_open, high * (adjusted_close / close) AS a_high,
  low * (adjusted_close / close) AS a_low, adjusted_close AS a_close FROM bars""")
def _(spark, sf):
    return scores.adjust_ohlc(fx.daily_bars(spark, sf)).select(*KEY, "a_open", "a_high", "a_low", "a_close")


@query("prj2_prj4_labels", f"""WITH {PRICED} SELECT symbol, date,
  CASE WHEN score <= -60 THEN 'extreme_fear' WHEN score <= -20 THEN 'fear' WHEN score < 20 THEN 'neutral' WHEN score < 60 THEN 'greed' ELSE 'extreme_greed' END AS phase,
  CASE WHEN score < -50 OR score > 50 THEN -1 WHEN score < -40 THEN 0 WHEN score < -20 THEN 1 WHEN score < 0 THEN 2 WHEN score < 20 THEN 3 WHEN score < 40 THEN 4 ELSE 5 END AS band,
  {r('greatest(0, least(100, (score + 100) / 2))', 'marker')}, CASE WHEN score <= -60 THEN 'fear' WHEN score >= 60 THEN 'greed' ELSE 'neutral' END AS tone FROM sx""")
def _(spark, sf):
    out = with_score(spark, sf).select(*KEY, sc.phase("score").alias("phase"), sc.band("score").alias("band"), sc.gauge("score").alias("g"))
    return rounded(out.select(*KEY, "phase", "band", "g.marker", "g.tone"), 4, "marker")


@query("prj5_nearest_threshold", f"""WITH {PRICED}, l AS (SELECT symbol, date, score, unnest([-60.0, -75.0, -90.0, 60.0, 75.0, 90.0]::DOUBLE[]) AS level, unnest(range(6)) AS i FROM sx)
SELECT symbol, date, level AS next_threshold, {r('abs(level - score)', 'distance_to_threshold')} FROM l QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY abs(level - score), i) = 1""")
def _(spark, sf):
    levels = F.array(*[F.lit(x) for x in (*joins.DEFAULT_BUYS, *joins.DEFAULT_SELLS)])
    out = with_score(spark, sf).select(*KEY, F.inline(F.array(sc.nearest_threshold("score", levels))))
    return rounded(out, 4, "distance_to_threshold")


@query("prj6_contributions", f"""WITH {PRICED} SELECT symbol, date, c.component, c.weight, c.value, c.value * c.weight AS contribution
FROM (SELECT symbol, date, unnest([{{'component': 'open', 'weight': 0.25::DOUBLE, 'value': open}}, {{'component': 'score', 'weight': 0.75::DOUBLE, 'value': score}}]) AS c FROM sx)""")
def _(spark, sf):
    return scores.contributions(with_score(spark, sf), {"open": 0.25, "score": 0.75})


@query("prj7_attainable_range", """WITH p AS (SELECT l_returnflag AS model, avg(l_discount) - 0.05 AS b, [avg(l_tax) * 10, -avg(l_discount) * 4, 0.0] AS w FROM lineitem GROUP BY 1)
SELECT model, round(greatest(-99, least(99, 100 * tanh(least(0, b - list_sum(list_transform(w, lambda x: abs(x))))))), 4) + 0.0 AS attainable_min,
  round(greatest(-99, least(99, 100 * tanh(greatest(0, b + list_sum(list_transform(w, lambda x: abs(x))))))), 4) + 0.0 AS attainable_max FROM p""")
def _(spark, sf):
    models = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        (F.avg("l_discount") - 0.05).alias("b"), F.array(F.avg("l_tax") * 10, -F.avg("l_discount") * 4, F.lit(0.0)).alias("w"))
    out = models.select("model", F.inline(F.array(sc.attainable_range("b", "w"))))
    return rounded(out, 4, "attainable_min", "attainable_max")


@query("prj8_with_previous", f"""WITH {PRICED} SELECT symbol, date, (close / lag(close) OVER w - 1) * 100 AS price_change_pct, lag(score) OVER w AS previous_score
FROM sx WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, sf):
    return scores.with_previous(with_score(spark, sf)).select(*KEY, "price_change_pct", "previous_score")


@query("prj9_age_days", f"""WITH {fx.BARS} SELECT symbol, date_diff('day', max(date), DATE '2002-01-03')::INT AS age_days, date_diff('day', max(date), DATE '2002-01-03') > 5 AS stale FROM bars GROUP BY 1""")
def _(spark, sf):
    last = fx.daily_bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("d"))
    return last.select("symbol", F.inline(F.array(sc.age_days("d", F.lit("2002-01-03").cast("date")))))


# An account curve per symbol: the adjusted close as equity, a quarter of it and a bit more in cash.
CURVE = f"{fx.BARS}, curve AS (SELECT symbol, date, adjusted_close AS equity, adjusted_close * 0.25::DOUBLE + volume AS cash FROM bars)"
MOVES = """moves AS (SELECT l_returnflag || '-' || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side,
  l_quantity AS value, l_tax AS fee, l_discount - 0.05 AS realized_pnl, l_suppkey % 37 AS hold_days FROM lineitem)"""


def curve(spark, sf):
    return fx.daily_bars(spark, sf).select(*KEY, F.col("adjusted_close").alias("equity"), (F.col("adjusted_close") * 0.25 + F.col("volume")).alias("cash"))


def moves(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("value"),
        F.col("l_tax").alias("fee"), (F.col("l_discount") - 0.05).alias("realized_pnl"), (F.col("l_suppkey") % 37).alias("hold_days"),
    )


@query("prj10_curve_array", f"""WITH {CURVE}, o AS (SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS points,
    list(round(equity, 6) ORDER BY date)[1] AS first_equity, list(round(equity, 6) ORDER BY date)[-1] AS last_equity FROM curve GROUP BY 1)
SELECT symbol, start_date, end_date, points, {r('first_equity', 'first_equity', 3)}, {r('last_equity', 'last_equity', 3)} FROM o""")
def _(spark, sf):
    rows = curve(spark, sf).select(*KEY, "equity", F.col("equity").alias("buy_hold"), F.lit(1.0).alias("underlying_buy_hold"), "cash", F.lit(0.5).alias("position"))
    out = metrics.curve_array(rows)
    points = F.col("equity_curve")
    out = out.select("symbol", "start_date", "end_date", F.size(points).cast("bigint").alias("points"),
                     F.element_at(points, 1)["equity"].alias("first_equity"), F.element_at(points, -1)["equity"].alias("last_equity"))
    return rounded(out, 3, "first_equity", "last_equity")


# --- joins ---------------------------------------------------------------------------------------------------


@query("jn2_set2_common_dates", f"""WITH {fx.SECOND}, d AS (SELECT date FROM second WHERE symbol IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT symbol) = 3)
SELECT date, false AS is_warmup FROM d WHERE date BETWEEN DATE '1996-05-01' AND DATE '1997-04-30' UNION ALL SELECT max(date), true FROM d WHERE date < DATE '1996-05-01' HAVING max(date) IS NOT NULL""")
def _(spark, sf):
    return joins.common_dates(fx.second_bars(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"], "1996-05-01", "1997-04-30")


@query("jn3_overlap", f"""WITH {fx.BARS}, {fx.ALTERNATE} SELECT b.symbol, b.date, b.adjusted_close AS adjusted_close_a, x.adjusted_close AS adjusted_close_b
FROM bars b JOIN alternate x ON b.symbol = x.symbol AND b.date = x.date""")
def _(spark, sf):
    return joins.overlap(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf), ["adjusted_close"])


@query("jn4_top1_latest_board", f"""WITH {PRICED},
i AS (SELECT DISTINCT symbol, NOT symbol LIKE '%F' OR symbol = 'A-F' AS enabled FROM sx),
g AS (SELECT symbol, max(date) AS date, arg_max(score, date) AS score FROM sx GROUP BY 1)
SELECT i.symbol, g.date, {r('g.score', 'score')}, CASE WHEN i.symbol LIKE 'A%' THEN -50.0::DOUBLE ELSE -60.0::DOUBLE END AS buy_1, CASE WHEN i.symbol LIKE 'A%' THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN i.symbol LIKE 'A%' THEN 'walk' ELSE 'fallback' END AS method, CASE WHEN i.symbol LIKE 'N%' THEN 2 ELSE 0 END AS position_steps, CASE WHEN i.symbol LIKE 'N%' THEN -1 ELSE 0 END AS pending_delta
FROM i LEFT JOIN g USING (symbol) WHERE enabled""")
def _(spark, sf):
    rows = with_score(spark, sf)
    symbols = rows.select("symbol").distinct()
    s = F.col("symbol")
    instruments = symbols.withColumn("enabled", ~s.endswith("F") | (s == "A-F"))
    level = lambda x: F.lit(float(x))
    profiles = symbols.where(s.startswith("A")).select(
        "symbol", level(-50).alias("buy_1"), level(-65).alias("buy_2"), level(-80).alias("buy_3"), level(50).alias("sell_1"),
        level(65).alias("sell_2"), level(80).alias("sell_3"), F.lit("high").alias("confidence"), F.lit("walk").alias("method"),
        F.lit(True).alias("active"), F.lit("2001-01-01").cast("timestamp").alias("created_at"),
    )
    states = symbols.where(s.startswith("N")).select("symbol", F.lit(2).alias("position_steps"), F.lit(-1).alias("pending_delta"))
    board = joins.latest_board(instruments, rows.select(*KEY, "score"), profiles, states)
    out = board.select(*KEY, "score", F.element_at("buys", 1).alias("buy_1"), "confidence", "method", "position_steps", "pending_delta")
    return rounded(out, 4, "score")


@query("jn5_latest_fx", f"""WITH {fx.FX}, l AS (SELECT base, quote, arg_max(rate, date) AS rate FROM fx GROUP BY 1, 2),
p AS (SELECT 'C' || n_nationkey AS base, 'C0' AS quote FROM nation)
SELECT p.base, p.quote, {r("CASE WHEN p.base = p.quote THEN 1 WHEN d.rate IS NOT NULL THEN d.rate ELSE 1 / nullif(i.rate, 0) END", 'rate', 8)}
FROM p LEFT JOIN l d ON d.base = p.base AND d.quote = p.quote LEFT JOIN l i ON i.base = p.quote AND i.quote = p.base""")
def _(spark, sf):
    pairs = fx.currencies(spark, sf).select(F.col("currency").alias("base"), F.lit("C0").alias("quote"))
    return rounded(joins.latest_fx(fx.fx_rates(spark, sf), pairs), 8, "rate")


@query("jn6_split_product", f"""WITH {fx.INSTRUMENT_BARS}, {fx.TRADES}, s AS (SELECT instrument, date, max(split_factor) AS f FROM ibars WHERE split_factor <> 1 GROUP BY 1, 2),
g AS (SELECT DISTINCT instrument, date FROM trades)
SELECT g.instrument, g.date, coalesce(product(s.f), 1) AS split_product FROM g LEFT JOIN s ON s.instrument = g.instrument AND s.date > g.date AND s.date <= DATE '2000-06-30' GROUP BY ALL""")
def _(spark, sf):
    days = fx.trades(spark, sf).select("instrument", "date").distinct().withColumn("until", F.lit("2000-06-30").cast("date"))
    return joins.split_product(days, fx.instrument_bars(spark, sf), "date", "until").drop("until")


@query("jn7_next_session", f"""WITH {fx.CALENDAR}, c AS (SELECT session FROM calendar WHERE dayofweek(session) BETWEEN 1 AND 5), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.date, c.session AS next_session FROM d ASOF LEFT JOIN c ON c.session > d.date""")
def _(spark, sf):
    sessions = fx.calendar(spark, sf).where(F.dayofweek("session").between(2, 6))
    days = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return joins.next_session(days, sessions)


@query("jn8_last_session", f"""WITH {fx.CALENDAR}, c AS (SELECT session FROM calendar WHERE dayofweek(session) BETWEEN 1 AND 5),
m AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes((o_orderkey * 37 % 1440)::BIGINT) AS moment FROM orders),
l AS (SELECT o_orderkey, timezone('America/New_York', timezone('UTC', moment)) AS local FROM m),
k AS (SELECT o_orderkey, CASE WHEN strftime(local, '%H:%M') >= '16:30' THEN CAST(local AS DATE) ELSE CAST(local AS DATE) - 1 END AS day FROM l)
SELECT k.o_orderkey, c.session AS last_session FROM k ASOF LEFT JOIN c ON c.session <= k.day""")
def _(spark, sf):
    sessions = fx.calendar(spark, sf).where(F.dayofweek("session").between(2, 6))
    minutes = F.expr("make_dt_interval(0, 0, CAST(o_orderkey * 37 % 1440 AS INT), 0)")
    moments = fx.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + minutes).alias("moment"))
    return joins.last_session(moments, sessions, "moment").drop("moment")


# Every other event and the one of another kind before it, by user; one user holds a third of all events.
@query("jn_as_of_instants", """WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS who, ts, value FROM events),
r AS (SELECT who, ts, max(event_id) AS other, arg_max(value, event_id) AS other_value FROM e WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN other END AS other, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN other_value END AS other_value
FROM (SELECT * FROM e WHERE event_id % 2 = 0) l ASOF LEFT JOIN r ON r.who = l.who AND r.ts < l.ts""")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("who"), "ts", "value")
    other = rows.where("event_id % 2 = 1").withColumnRenamed("event_id", "other")
    met = joins.as_of(rows.where("event_id % 2 = 0"), other, ["other", "value"], "who", "ts", strict=True, tolerance=6 * 3600, order=["other"], size=400)
    return met.select("event_id", F.col("matched.other").alias("other"), F.col("matched.value").alias("other_value"))


@query("jn10_unmatched_fills", f"""WITH {fx.BARS}, {fx.CALENDAR}, n AS (SELECT session, lead(session) OVER (ORDER BY session) AS nxt FROM calendar),
i AS (SELECT n.nxt AS date, symbol, CASE WHEN close < open THEN 'buy' ELSE 'sell' END AS side FROM bars b JOIN n ON n.session = b.date WHERE nxt IS NOT NULL)
SELECT f.symbol, f.date, f.side FROM (SELECT symbol, date, CASE WHEN volume % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM bars) f
WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.date = f.date AND i.symbol = f.symbol AND i.side = f.side)""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf)
    fills = bars.select(*KEY, F.when(F.col("volume") % 2 == 0, "buy").otherwise("sell").alias("side"))
    intents = bars.select(*KEY, F.when(F.col("close") < F.col("open"), "buy_candidate").otherwise("sell").alias("side"))
    return joins.unmatched_fills(fills, intents, fx.calendar(spark, sf))


@query("jn11_with_instrument", """SELECT o_orderkey, c_custkey AS symbol, c_name, c_name IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey
WHERE c_custkey IS NOT NULL UNION ALL SELECT o_orderkey, o_custkey, NULL, false FROM orders WHERE o_custkey % 3 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def _(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"))
    dim = fx.table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("symbol"), "c_name")
    return joins.with_instrument(rows, dim)


@query("jn12_restrict", f"""WITH {fx.BARS}, {fx.CALENDAR} SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT symbol FROM bars WHERE symbol LIKE 'A%')
AND date IN (SELECT session FROM calendar WHERE dayofweek(session) = 1)""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf)
    mondays = fx.calendar(spark, sf).where(F.dayofweek("session") == 2).select(F.col("session").alias("date"))
    return joins.restrict(bars, bars.where(F.col("symbol").startswith("A")).select("symbol").distinct(), mondays).select(*KEY, "close")


# --- books ---------------------------------------------------------------------------------------------------

BOOK = f"""{fx.TRADES}, {fx.INSTRUMENT_BARS}, s AS (SELECT instrument, date, max(split_factor) AS f FROM ibars WHERE split_factor <> 1 GROUP BY 1, 2),
ev AS (SELECT kind, instrument, date, 1 AS step, side, quantity::DOUBLE AS q, price::DOUBLE AS p, fee::DOUBLE AS fee, 1.0::DOUBLE AS f, o1, o2, o3, o4 FROM trades
  UNION ALL SELECT k.kind, s.instrument, s.date, 0, 'split', 0, 0, 0, s.f, 0, 0, 0, 0 FROM s JOIN (SELECT DISTINCT kind, instrument FROM trades) k USING (instrument)),
fold AS (SELECT kind, instrument, list_reduce(list({{'q': q, 'c': p, 'r': fee, 'f': f, 'side': side, 'o': 0::BIGINT}} ORDER BY date, step, o1, o2, o3, o4), lambda a, e: {{
    'q': CASE e.side WHEN 'split' THEN a.q * e.f WHEN 'buy' THEN a.q + e.q ELSE a.q - least(a.q, e.q) END,
    'c': CASE WHEN e.side = 'buy' THEN a.c + e.q * e.c + e.r WHEN e.side = 'sell' AND a.q > 0 THEN a.c - a.c * least(a.q, e.q) / a.q ELSE a.c END,
    'r': CASE WHEN e.side = 'sell' AND a.q > 0 THEN a.r + e.q * e.c - e.r - a.c * least(a.q, e.q) / a.q ELSE a.r END,
    'f': a.f + CASE WHEN e.side = 'split' THEN 0 ELSE e.r END, 'side': 'x', 'o': a.o + CASE WHEN e.side = 'sell' AND e.q > a.q THEN 1 ELSE 0 END}},
    {{'q': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'f': 0.0::DOUBLE, 'side': 'x', 'o': 0::BIGINT}}) AS b FROM ev GROUP BY 1, 2)"""


def book(spark, sf):
    return books.average_cost_book(fx.trades(spark, sf), fx.instrument_bars(spark, sf), order=fx.TRADE_ORDER)


@query("agg10_average_cost_book", f"""WITH {BOOK}
SELECT kind, instrument, {r('b.q', 'quantity', 4)}, {r('b.c', 'cost', 2)}, {r('b.r', 'realized_pnl', 2)}, {r('b.f', 'fees', 4)}, b.o AS oversold,
  (SELECT count(*) FROM trades t WHERE t.kind = fold.kind AND t.instrument = fold.instrument) AS trades FROM fold""")
def _(spark, sf):
    return rounded(rounded(book(spark, sf), 4, "quantity", "fees"), 2, "cost", "realized_pnl")


POSITIONS = f"""WITH {BOOK}, {fx.FX}, lp AS (SELECT instrument, arg_max(close, date) AS last_price, max(date) AS latest_price_date FROM ibars GROUP BY 1),
ps AS (SELECT kind, instrument, b.q AS quantity, b.c AS cost, b.r AS realized_pnl, b.f AS fees, last_price, latest_price_date, b.q * last_price AS market_value, b.q * last_price - b.c AS unrealized_pnl
  FROM fold JOIN lp USING (instrument))"""


@query("agg11_positions", f"""{POSITIONS} SELECT kind, instrument, last_price, latest_price_date, {r('CASE WHEN quantity <> 0 THEN cost / quantity ELSE 0 END', 'average_cost')},
  {r('market_value', 'market_value', 2)}, {r('unrealized_pnl', 'unrealized_pnl', 2)} FROM ps""")
def _(spark, sf):
    out = books.positions_view(book(spark, sf), fx.instrument_bars(spark, sf))
    out = out.select("kind", "instrument", "last_price", "latest_price_date", "average_cost", "market_value", "unrealized_pnl")
    return rounded(rounded(out, 4, "average_cost"), 2, "market_value", "unrealized_pnl")


@query("agg9_portfolio_totals", f"""{POSITIONS}, l AS (SELECT base, quote, arg_max(rate, date) AS rate FROM fx GROUP BY 1, 2),
c AS (SELECT ps.*, 'C' || instrument AS currency, CASE WHEN instrument = 0 THEN 1 WHEN d.rate IS NOT NULL THEN d.rate ELSE 1 / i.rate END AS rate FROM ps
  LEFT JOIN l d ON d.base = 'C' || instrument AND d.quote = 'C0' LEFT JOIN l i ON i.base = 'C0' AND i.quote = 'C' || instrument)
SELECT {r('sum(market_value * rate)', 'market_value', 0)}, {r('sum(cost * rate)', 'cost', 0)}, {r('sum(realized_pnl * rate)', 'realized_pnl', 0)},
  {r('sum(unrealized_pnl * rate)', 'unrealized_pnl', 0)}, {r('sum(fees * rate)', 'fees', 2)},
  (SELECT string_agg(DISTINCT currency, ',' ORDER BY currency) FROM c WHERE rate IS NULL) AS missing_fx, 'C0' AS base_currency FROM c""")
def _(spark, sf):
    rows = books.positions_view(book(spark, sf), fx.instrument_bars(spark, sf)).withColumn("currency", F.concat(F.lit("C"), F.col("instrument")))
    out = books.portfolio_totals(rows, fx.fx_rates(spark, sf), "C0").withColumn("missing_fx", F.array_join("missing_fx", ","))
    return rounded(rounded(out, 0, "market_value", "cost", "realized_pnl", "unrealized_pnl"), 2, "fees")


@query("agg12_open_quantity", f"WITH {BOOK} SELECT {r('b.q', 'quantity', 4)} FROM fold WHERE kind = 'paper' AND instrument = 7")
def _(spark, sf):
    return rounded(books.open_quantity(book(spark, sf), kind="paper", instrument=7), 4, "quantity")


# --- metrics -------------------------------------------------------------------------------------------------


@query("agg1_agg2_performance", f"""WITH {CURVE}, {MOVES},
d AS (SELECT symbol, date, equity, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT symbol, count(*) AS n, arg_max(equity, date) / arg_min(equity, date) AS g, avg(r) AS mean, stddev_samp(r) AS std, min(dd) AS mdd, avg((r > 0)::INT) AS pos FROM d GROUP BY 1),
t AS (SELECT symbol, count(*)::DOUBLE AS trades, sum(abs(value)) AS turnover, count_if(side = 'sell' AND realized_pnl > 0) / nullif(count_if(side = 'sell'), 0) AS wins FROM moves GROUP BY 1)
SELECT symbol, {r('g - 1', 'total_return', 6)}, {r('g ** (252 / n) - 1', 'cagr', 6)}, {r('mdd', 'max_drawdown', 6)}, {r('mean / std * sqrt(252)', 'sharpe', 6)},
  {r('(g ** (252 / n) - 1) / abs(mdd)', 'calmar', 6)}, trades, turnover, {r('wins', 'win_rate', 6)}, {r('pos', 'positive_days', 6)} FROM m JOIN t USING (symbol)""")
def _(spark, sf):
    out = metrics.performance(curve(spark, sf), moves(spark, sf))
    return rounded(out, 6, "total_return", "cagr", "max_drawdown", "sharpe", "calmar", "win_rate", "positive_days")


@query("agg3_account_metrics", f"""WITH {CURVE}, d AS (SELECT symbol, date, equity, equity / greatest(5000, max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM curve)
SELECT symbol, {r('(arg_max(equity, date) / 5000 - 1) * 100', 'return_pct')}, {r('min(dd) * 100', 'drawdown_pct')},
  {r("CASE WHEN date_diff('day', min(date), max(date)) >= 365 THEN ((arg_max(equity, date) / 5000) ** (365.25::DOUBLE / date_diff('day', min(date), max(date))) - 1) * 100 END", 'cagr_pct')},
  arg_max(equity, date) AS ending_value, count(*) AS sessions FROM d GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.account_metrics(curve(spark, sf), 5000.0), 4, "return_pct", "drawdown_pct", "cagr_pct")


@query("agg4_annual_rollup", f"""WITH {CURVE}, {MOVES}, y AS (SELECT symbol, year(date) AS year, arg_max(equity, date) AS e, max(date) AS through FROM curve GROUP BY 1, 2),
s AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY year), 5000) AS b FROM y),
d AS (SELECT c.symbol, s.year, min(equity / greatest(b, peak) - 1) AS mdd FROM (SELECT *, max(equity) OVER (PARTITION BY symbol, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve) c
  JOIN s ON s.symbol = c.symbol AND s.year = year(c.date) GROUP BY 1, 2),
t AS (SELECT symbol, year(date) AS year, count_if(side = 'buy') AS buys, count_if(side = 'sell') AS sells, sum(fee) AS fees, sum(realized_pnl) AS pnl FROM moves GROUP BY 1, 2)
SELECT s.symbol, s.year::INT AS year, b AS start_equity, e AS end_equity, {r('(e / b - 1) * 100', 'return_pct')}, {r('mdd * 100', 'max_drawdown_pct')}, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells,
  {r('coalesce(fees, 0)', 'fees')}, {r('coalesce(pnl, 0)', 'realized_pnl')}, through FROM s JOIN d USING (symbol, year) LEFT JOIN t USING (symbol, year)""")
def _(spark, sf):
    out = metrics.annual_rollup(curve(spark, sf), moves(spark, sf), 5000.0)
    return rounded(out, 4, "return_pct", "max_drawdown_pct", "fees", "realized_pnl")


@query("agg5_trade_stats", f"""WITH {MOVES} SELECT symbol, count_if(side = 'buy') AS buys, count_if(side = 'sell') AS sells, {r('sum(fee)', 'fees')},
  median(hold_days) FILTER (side = 'sell') AS median_hold_days FROM moves GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.trade_stats(moves(spark, sf)), 4, "fees")


THRESHOLDS = ", ".join(f"({i}, {t}, '{op}')" for i, (t, op) in enumerate(metrics.DISTRIBUTION))


@query("agg6_threshold_distribution", f"""WITH {PRICED}, w AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 600),
l AS (SELECT symbol, arg_max(score, date) AS cur FROM sx GROUP BY 1)
SELECT w.symbol, count(*) AS observations, {r('min(score)', 'observed_min')}, {r('max(score)', 'observed_max')}, count_if(score >= cur) AS at_or_above_current, t::INT AS threshold, op AS operator,
  count_if(CASE op WHEN '<=' THEN score <= t WHEN '>' THEN score > t ELSE score >= t END) AS count,
  {r("count_if(CASE op WHEN '<=' THEN score <= t WHEN '>' THEN score > t ELSE score >= t END) / count(*) * 100", 'pct')}
FROM w JOIN l USING (symbol), (VALUES {THRESHOLDS}) v(i, t, op) GROUP BY w.symbol, i, t, op""")
def _(spark, sf):
    return rounded(metrics.threshold_distribution(with_score(spark, sf), 600), 4, "observed_min", "observed_max", "pct")


@query("agg7_band_histogram", f"""WITH {PRICED}, w AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 600),
b AS (SELECT symbol, CASE WHEN score < -50 OR score > 50 THEN -1 WHEN score < -40 THEN 0 WHEN score < -20 THEN 1 WHEN score < 0 THEN 2 WHEN score < 20 THEN 3 WHEN score < 40 THEN 4 ELSE 5 END AS band FROM w)
SELECT b.symbol, count(*) AS observations, v.i::INT AS band, count_if(b.band = v.i) AS count, {r('count_if(b.band = v.i) / count(*)', 'share', 6)} FROM b, range(6) v(i) GROUP BY b.symbol, v.i""")
def _(spark, sf):
    return rounded(metrics.band_histogram(with_score(spark, sf), 600), 6, "share")


@query("agg8_own_percentile", f"""WITH {PRICED}, l AS (SELECT symbol, arg_max(score, date) AS current FROM sx GROUP BY 1)
SELECT symbol, {r('current', 'current')}, {r('avg((score <= current)::INT) * 100', 'percentile')} FROM sx JOIN l USING (symbol) GROUP BY symbol, current""")
def _(spark, sf):
    return rounded(metrics.own_percentile(with_score(spark, sf)), 4, "current", "percentile")


@query("agg13_catalog", f"""WITH {PRICED}, c AS (SELECT *, CASE WHEN day(date) % 2 = 0 THEN score END AS rk FROM sx)
SELECT symbol, min(date) AS first_date, max(date) AS latest_date, max(date) FILTER (rk IS NOT NULL) AS score_date, arg_max(close, date) FILTER (rk IS NOT NULL) AS close,
  {r('arg_max(score, date) FILTER (rk IS NOT NULL)', 'score')}, {r('arg_max(rk, date) FILTER (rk IS NOT NULL)', 'percentile')}, count(score) AS valid_score_days,
  count(rk) > 0 AS ready, date_diff('day', max(date), DATE '2002-01-03')::INT AS snapshot_age_days FROM c GROUP BY 1""")
def _(spark, sf):
    rows = with_score(spark, sf).withColumn("score_rank", F.when(F.dayofmonth("date") % 2 == 0, F.col("score")))
    return rounded(metrics.catalog(rows, F.lit("2002-01-03").cast("date")), 4, "score", "percentile")


@query("agg15_mean_exposure", f"WITH {CURVE} SELECT symbol, {r('avg(1 - cash / equity) * 100', 'mean_exposure_pct')} FROM curve GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.mean_exposure(curve(spark, sf)), 4, "mean_exposure_pct")


@query("agg16_weighted_hold", f"""WITH {fx.SECOND}, w AS (SELECT * FROM (VALUES ('1-URGENT', 0.4), ('2-HIGH', 0.3), ('5-LOW', 0.3)) v(symbol, w)),
d AS (SELECT date FROM second JOIN w USING (symbol) GROUP BY 1 HAVING count(*) = 3),
b AS (SELECT s.symbol, s.date, open * adjusted_close / close AS o, adjusted_close AS c, w.w FROM second s JOIN w USING (symbol) WHERE s.date IN (SELECT date FROM d)),
h AS (SELECT symbol, 100000 * any_value(w)::DOUBLE / 1.001::DOUBLE / arg_min(o, date) AS shares FROM b GROUP BY 1)
SELECT date, {r('sum(shares * c)', 'equity', 3)} FROM b JOIN h USING (symbol) GROUP BY 1""")
def _(spark, sf):
    bars, weights = fx.second_bars(spark, sf), {"1-URGENT": 0.4, "2-HIGH": 0.3, "5-LOW": 0.3}
    days = joins.common_dates(bars, list(weights)).select("date")
    return rounded(metrics.weighted_hold(bars, weights, 100000.0, 0.001, days), 3, "equity")


@query("agg19_board_counts", f"""WITH {PRICED} SELECT count_if(close < 2000) AS active, count_if(score <= -60) AS fear, count_if(score >= 60) AS greed FROM sx""")
def _(spark, sf):
    return metrics.board_counts(with_score(spark, sf).withColumn("action", F.when(F.col("close") < 2000, "buy").otherwise("hold")))


@query("agg20_cumulative_fees", f"""WITH {MOVES}, d AS (SELECT symbol, date, count(*) AS fills, sum(fee) AS fees FROM moves GROUP BY 1, 2)
SELECT symbol, date, fills, {r('fees', 'fees')}, {r('sum(fees) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)', 'fees_cumulative')} FROM d""")
def _(spark, sf):
    return rounded(metrics.cumulative_fees(moves(spark, sf)), 4, "fees", "fees_cumulative")


# --- top-k and sets ------------------------------------------------------------------------------------------


@query("top1_latest", f"WITH {fx.BARS} SELECT symbol, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY 1")
def _(spark, sf):
    return joins.latest(fx.daily_bars(spark, sf).select(*KEY, "close", "volume"), ["date"])


@query("top2_top5_page", f"WITH {fx.BARS} SELECT symbol, date, close FROM bars ORDER BY date DESC, symbol LIMIT 25 OFFSET 25")
def _(spark, sf):
    return ranking.page(fx.daily_bars(spark, sf).select(*KEY, "close"), 2, 25, F.col("date").desc(), "symbol")


# Candidates: parts ordered on a day; new when the part number is even. Cash and slots differ by day.
@query("top3_budgeted_topk", """WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, l_partkey AS symbol, (l_partkey * 7919 % 201 - 100)::DOUBLE AS priority, l_partkey % 2 = 0 AS is_new
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT *, 1000.0::DOUBLE + 500 * day(date) AS cash, 2 + day(date) % 5 AS slots FROM c),
s AS (SELECT *, CASE WHEN is_new THEN row_number() OVER (PARTITION BY date, is_new ORDER BY priority, symbol) ELSE 0 END AS nr FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY priority, symbol) AS rk FROM s WHERE nr <= slots)
SELECT date, symbol, rk AS accepted_rank FROM k WHERE rk <= floor((cash - 600 + 1e-9) / 900)""")
def _(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    part = F.col("l_partkey")
    cands = fx.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "date", part.alias("symbol"), (part * 7919 % 201 - 100).cast("double").alias("priority"), (part % 2 == 0).alias("is_new")).distinct()
    day = F.dayofmonth("date")
    accounts = orders.select("date").distinct().select(
        "date", (1000.0 + 500 * day).alias("cash"), F.lit(600.0).alias("reserve"), F.lit(900.0).alias("budget"), (2 + day % 5).alias("slots"))
    return ranking.budgeted_topk(cands, accounts).select("date", "symbol", "accepted_rank")


@query("top4_argmax_first", """SELECT l_suppkey AS symbol, l_quantity AS v, l_partkey AS run FROM (SELECT DISTINCT l_suppkey, l_quantity, l_partkey FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey) = 1""")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_quantity").alias("v"), F.col("l_partkey").alias("run"))
    return ranking.argmax_first(rows, "v", ["run"])


@query("top6_retain", f"""WITH {fx.CALENDAR}, w AS (SELECT max(session) AS session FROM calendar GROUP BY date_trunc('week', session) ORDER BY 1 DESC LIMIT 3)
SELECT session AS date FROM w UNION (SELECT session FROM calendar ORDER BY 1 DESC LIMIT 7)""")
def _(spark, sf):
    return ranking.retain(fx.calendar(spark, sf).select(F.col("session").alias("date")))


@query("set1_union_newer", f"""WITH {fx.BARS}, {fx.ALTERNATE}, o AS (SELECT symbol, date, adjusted_close FROM bars WHERE date <= DATE '1999-12-31' AND symbol <> 'R-O')
SELECT * FROM o UNION ALL SELECT x.symbol, x.date, x.adjusted_close FROM alternate x LEFT JOIN (SELECT symbol, max(date) AS d FROM o GROUP BY 1) e USING (symbol) WHERE d IS NULL OR x.date > d""")
def _(spark, sf):
    columns = [*KEY, "adjusted_close"]
    base = fx.daily_bars(spark, sf).select(*columns).where((F.col("date") <= "1999-12-31") & (F.col("symbol") != "R-O"))
    return ranking.union_newer(base, fx.alternate_bars(spark, sf).select(*columns))


@query("set2_intersect_dates", f"""WITH {fx.BARS}, {fx.SECOND} SELECT date FROM bars WHERE symbol = 'A-F' INTERSECT SELECT date FROM second WHERE symbol = '5-LOW' INTERSECT SELECT date FROM second WHERE symbol = '2-HIGH'""")
def _(spark, sf):
    second = fx.second_bars(spark, sf)
    return ranking.intersect_dates([fx.daily_bars(spark, sf).where("symbol = 'A-F'"), second.where("symbol = '5-LOW'"), second.where("symbol = '2-HIGH'")])


@query("set3_set5_difference", f"""WITH {fx.BARS}, {fx.ALTERNATE} SELECT symbol, date FROM bars EXCEPT SELECT symbol, date FROM alternate""")
def _(spark, sf):
    return ranking.difference(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf), KEY)


@query("set4_ordered_union", """WITH a AS (SELECT c_mktsegment AS symbol, 0 AS list_no, c_custkey AS position FROM customer UNION ALL SELECT o_orderpriority, 1, o_orderkey FROM orders
  UNION ALL SELECT c_mktsegment, 2, c_custkey FROM customer)
SELECT symbol, list_no::INT AS list_no, position FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY list_no, position) = 1""")
def _(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol"), F.col("c_custkey").alias("position"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("position"))
    return ranking.ordered_union([customers, orders, customers])


@query("sg7_rotate_profiles", """WITH p AS (SELECT c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'fallback' ELSE 'walk' END AS method,
  TIMESTAMP '2001-01-01' + to_days((c_custkey % 60)::INT) AS created_at, true AS active FROM customer),
d AS (SELECT symbol FROM p WHERE method = 'fallback' OR date_diff('day', created_at, TIMESTAMP '2001-03-01') >= 30)
SELECT symbol, method, CAST(created_at AS DATE) AS created, symbol NOT IN (SELECT symbol FROM d) AS active FROM p UNION ALL SELECT symbol, 'walk2', DATE '2001-03-01', true FROM d""")
def _(spark, sf):
    key = F.col("c_custkey")
    created = F.col("base") + F.expr("make_dt_interval(CAST(c_custkey % 60 AS INT), 0, 0, 0)")
    base = fx.table(spark, sf, "customer").withColumn("base", F.lit("2001-01-01").cast("timestamp"))
    profiles = base.select(key.alias("symbol"), F.when(key % 3 == 0, "fallback").otherwise("walk").alias("method"), created.alias("created_at"), F.lit(True).alias("active"))
    new = profiles.select("symbol", F.lit("walk2").alias("method"))
    out = rotate_profiles(profiles, new, F.lit("2001-03-01").cast("timestamp"))
    return out.select("symbol", "method", F.to_date("created_at").alias("created"), "active")


