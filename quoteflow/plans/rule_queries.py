"""Registered queries: snapshot rules, stored signals, ledger audits, observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.operators import audit, rules
from quoteflow.operators import signals as sg
from quoteflow.operators.timeline import running
from quoteflow.plans import fixtures as fx
from quoteflow.plans import observation as ob
from quoteflow.plans import scores
from quoteflow.plans.book_queries import PRICED, with_score
from quoteflow.plans.registry import query, r, rounded
from quoteflow.plans.series_queries import FIVE, FROZEN_PARAMETERS, TWO

KEY = ["symbol", "date"]

# A position and a signal per bar, spread over every branch of the rules by the bar's volume.
STATE = f"""{PRICED}, st AS (SELECT symbol, date AS signal_date, score, close, volume::BIGINT AS v, volume AS shares, open * volume AS cost_basis, date - (volume::BIGINT % 90)::INT AS first_date,
  date - (volume::BIGINT % 40)::INT AS last_action_date, CASE WHEN volume::BIGINT % 3 = 0 THEN date - (volume::BIGINT % 7)::INT END AS last_sell_date, high AS peak_price,
  volume::BIGINT % 2 = 0 AS armed, volume::BIGINT % 4 AS sold_lots FROM (SELECT sx.*, bars.volume FROM sx JOIN bars USING (symbol, date)))"""


def state(spark, sf):
    v = F.col("volume").cast("bigint")
    back = lambda n: F.date_sub("date", (v % n).cast("int"))
    return with_score(spark, sf).select(
        "symbol", F.col("date").alias("signal_date"), "score", "close", v.alias("v"), F.col("volume").alias("shares"),
        (F.col("open") * F.col("volume")).alias("cost_basis"), back(90).alias("first_date"), back(40).alias("last_action_date"),
        F.when(v % 3 == 0, back(7)).alias("last_sell_date"), F.col("high").alias("peak_price"), (v % 2 == 0).alias("armed"), (v % 4).alias("sold_lots"),
    )


ON = ["symbol", "signal_date"]


@query("sg8_next_open_intents", f"""WITH {STATE}, i AS (SELECT symbol, signal_date, (score + 100) / 2 AS percentile,
  CASE WHEN v % 5 > 0 AND close / (cost_basis / shares) - 1 >= 0.55::DOUBLE THEN 'sell' WHEN (score + 100) / 2 <= 20 AND (v % 5 = 0 OR v % 2 = 0 OR close <= peak_price * (1 - 0.05::DOUBLE)) THEN 'buy_candidate' END AS side FROM st)
SELECT symbol, signal_date, side, CASE WHEN side = 'sell' THEN 'profit_target' ELSE 'fear_and_gap' END AS reason, CASE WHEN side <> 'sell' THEN {r('percentile', 'percentile')[:-len(' AS percentile')]} END AS percentile FROM i WHERE side IS NOT NULL""")
def _(spark, sf):
    st = state(spark, sf)
    sig = st.select(*ON, "close", ((F.col("score") + 100) / 2).alias("percentile"))
    pos = st.where("v % 5 > 0").select(*ON, "shares", "cost_basis", F.when(F.col("v") % 2 != 0, F.col("peak_price")).alias("last_buy"))
    return rounded(rules.next_open_intents(sig, pos, on=ON), 4, "percentile")


def exit_sql(mode: str) -> str:
    hit = "(score >= 40 OR profit >= 0.3::DOUBLE)"
    pullback = "close <= peak * (1 - 0.1::DOUBLE)"
    step = "profit >= 0.3::DOUBLE + 0.1::DOUBLE * sold_lots"
    trigger, reason = {
        "score_or_profit": (hit, "CASE WHEN score >= 40 THEN 'greed' ELSE 'profit_target' END"),
        "trail": (f"((armed OR {hit}) AND {pullback})", "'pullback'"),
        "step_trail": (f"(CASE WHEN sold_lots = 0 THEN {hit} ELSE {step} OR {pullback} END)",
                       f"CASE WHEN sold_lots = 0 THEN 'first_lot' WHEN {step} THEN 'next_step' ELSE 'pullback' END"),
    }[mode]
    armed = "armed" if mode == "score_or_profit" else f"(armed OR {hit})"
    return f"""WITH {STATE}, a AS (SELECT *, close / (cost_basis / shares) - 1 AS profit, greatest(peak_price, close) AS peak, date_diff('day', first_date, signal_date) >= 60 AS aged FROM st),
b AS (SELECT *, {trigger} AS trig, date_diff('day', last_action_date, signal_date) >= 20 AND abs(profit) <= 0.05 AS idle, profit <= -0.5 AS loss,
  coalesce(date_diff('day', last_sell_date, signal_date) < 3, false) AS waiting FROM a),
c AS (SELECT *, (trig OR aged OR idle OR loss) AND (aged OR loss OR NOT waiting) AS fired FROM b)
SELECT symbol, signal_date, {r('profit', 'profit', 6)}, peak AS peak_price, {armed} AS armed, fired AS exit,
  CASE WHEN fired THEN CASE WHEN loss THEN 'stop_loss' WHEN aged THEN 'age' WHEN trig THEN {reason} ELSE 'idle' END END AS reason FROM c"""


def _exits(mode):
    def run(spark, sf):
        st = state(spark, sf)
        pos = st.drop("score", "close", "v")
        rule = rules.Rule(exit_mode=mode, idle_exit_days=20, stop_loss=0.5)
        return rounded(rules.exit_triggers(pos, st.select(*ON, "score", "close"), rule, ON).select(
            "symbol", "signal_date", "profit", "peak_price", "armed", "exit", "reason"), 6, "profit")

    return run


for _mode in ("score_or_profit", "trail", "step_trail"):
    query(f"sg9_exit_{_mode}", exit_sql(_mode))(_exits(_mode))


ELIGIBLE = f"""WITH {STATE}, a AS (SELECT *, v % 3 > 0 AS held, v % 11 = 0 AS selling, v % 6 AS lots, CASE WHEN v % 4 = 0 THEN last_action_date END AS flat_date FROM st),
c AS (SELECT * FROM a WHERE NOT selling AND lots < 4 AND score <= -20 AND CASE WHEN held THEN close <= peak_price * (1 - 0.1::DOUBLE) AND date_diff('day', first_date, signal_date) >= 7
  ELSE NOT coalesce(date_diff('day', flat_date, signal_date) < 7, false) END)"""


@query("sg10_suppressed", f"{ELIGIBLE} SELECT signal_date, count(*) AS suppressed FROM c WHERE day(signal_date) >= 25 GROUP BY 1")
def _(spark, sf):
    st = state(spark, sf)
    return rules.suppressed_candidates(_gated(st), _lots(st), on=ON)


@query("sg10_entry_candidates", f"""{ELIGIBLE} SELECT symbol, signal_date, {r('score', 'priority')}, NOT held AS is_new, CASE WHEN held THEN 'add_after_drop' ELSE 'fear' END AS reason FROM c WHERE day(signal_date) < 25""")
def _(spark, sf):
    st = state(spark, sf)
    return rounded(rules.entry_candidates(_gated(st), _lots(st), on=ON), 4, "priority")


def _gated(st):
    """Signals; nothing is bought on the last days of a month."""
    return st.select(*ON, "score", "close", (F.dayofmonth("signal_date") < 25).alias("buy_allowed"))


def _lots(st):
    v = F.col("v")
    return st.select(
        *ON, F.when(v % 3 > 0, 1.0).otherwise(0.0).alias("shares"), (v % 6).alias("lots"), (v % 11 == 0).alias("selling"), F.lit(False).alias("sold_now"),
        F.when(v % 4 == 0, F.col("last_action_date")).alias("flat_date"), F.col("peak_price").alias("last_buy"), F.col("first_date").alias("last_buy_date"))


@query("sg11_desk_actions", f"""WITH {STATE}, a AS (SELECT *, v % 13 > 0 AS covered, v % 17 > 0 AS cur, v % 3 > 0 AS held, (close / (cost_basis / shares) - 1) * 100 AS p, date_diff('day', first_date, signal_date) AS d,
  CASE v % 7 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side, v % 2 = 0 AS has_plan FROM st),
b AS (SELECT *, CASE WHEN NOT covered THEN 'observe' WHEN NOT cur THEN 'recompute' WHEN held AND d >= 60 THEN 'exit_candidate' WHEN held AND (score >= 40 OR p >= 0.3::DOUBLE * 100) THEN 'sell_candidate'
  WHEN held AND NOT v % 11 = 0 AND v % 6 < 4 AND score <= -20 AND close <= peak_price * (1 - 0.1::DOUBLE) THEN 'add_candidate' WHEN held THEN 'hold' WHEN score <= -20 THEN 'first_buy_candidate' ELSE 'wait' END AS act FROM a)
SELECT symbol, signal_date, CASE WHEN has_plan AND covered THEN CASE WHEN side = 'buy' THEN 'planned_buy' WHEN side = 'sell' THEN 'planned_sell' WHEN act LIKE '%_candidate' THEN 'no_order' ELSE act END ELSE act END AS action,
  {" ".join(["CASE action"] + [f"WHEN '{k}' THEN '{v}'" for k, v in rules.DESK_REASONS.items()])} END AS reason, {r("CASE WHEN held THEN peak_price * (1 - 0.1::DOUBLE) END", 'protect_price', 8)} FROM b""")
def _(spark, sf):
    st = state(spark, sf)
    v = F.col("v")
    sig = st.select(*ON, "score", "close", (v % 13 > 0).alias("covered"), (v % 17 > 0).alias("current"), (v % 2 == 0).alias("has_plan"))
    pos = st.where("v % 3 > 0").select(
        *ON, ((F.col("close") / (F.col("cost_basis") / F.col("shares")) - 1) * 100).alias("profit_pct"), F.datediff("signal_date", "first_date").alias("holding_days"),
        (v % 6).alias("lots"), (v % 11 == 0).alias("selling"), F.col("peak_price").alias("last_buy_price"), "peak_price", F.lit(False).alias("exit_armed"), F.lit(0).alias("sold_lots"))
    plan = st.where("v % 7 < 2").select(*ON, F.when(v % 7 == 0, "buy").otherwise("sell").alias("side"))
    return rounded(rules.desk_actions(sig, pos, plan, on=ON), 8, "protect_price")


@query("sg12_kickoff_candidates", f"""WITH {PRICED}, p AS (SELECT symbol || date AS symbol, CASE WHEN day(date) > 1 THEN (score + 100) / 2 END AS percentile FROM sx)
SELECT symbol, {r('percentile', 'percentile')}, CASE WHEN percentile IS NULL THEN 'missing_signal' ELSE 'candidate' END AS status FROM p WHERE percentile IS NULL OR percentile <= 20""")
def _(spark, sf):
    sig = with_score(spark, sf).select(
        F.concat("symbol", F.col("date").cast("string")).alias("symbol"), F.when(F.dayofmonth("date") > 1, (F.col("score") + 100) / 2).alias("percentile"))
    return rounded(rules.kickoff_candidates(sig), 4, "percentile")


# Decisions that arrive for keys with and without a pending fill; every second date is stored already.
@query("sg3_store_signals", f"""WITH {STATE}, n AS (SELECT symbol, signal_date AS date, score, close, (v % 3 - 1) AS delta, CASE WHEN v % 3 = 2 THEN 1 + v % 2 ELSE v % 3 END AS steps, v % 5 = 0 AS waiting, v % 8 AS mask FROM st)
SELECT symbol, date, {r('score', 'score')}, CASE WHEN waiting THEN 'hold' WHEN delta > 0 THEN CASE WHEN steps = delta THEN 'buy' ELSE 'add' END WHEN delta < 0 THEN CASE WHEN steps = 0 THEN 'exit' ELSE 'reduce' END ELSE 'hold' END AS action,
  CASE WHEN waiting THEN 0 ELSE delta END::INT AS target_step_delta, CASE WHEN waiting THEN 0 ELSE mask END::INT AS buy_mask, CASE WHEN waiting THEN 7 ELSE mask END::INT AS sell_mask,
  CASE WHEN waiting THEN 1 ELSE delta END::INT AS pending_delta, close AS price, 'high' AS confidence, 'ok' AS quality_status, 4 AS threshold_profile_id,
  CASE WHEN waiting THEN 'waits for a pending fill; ' ELSE '' END || 'steps ' || steps AS reason FROM n WHERE day(date) % 2 = 0""")
def _(spark, sf):
    st = state(spark, sf)
    v = F.col("v")
    new = st.select(
        "symbol", F.col("signal_date").alias("date"), "score", (v % 3 - 1).cast("int").alias("delta"), F.when(v % 3 == 2, 1 + v % 2).otherwise(v % 3).cast("int").alias("steps"),
        F.when(v % 5 == 0, 1).otherwise(0).alias("pending_delta"), (v % 8).cast("int").alias("buy_mask"), (v % 8).cast("int").alias("sell_mask"),
        F.lit(0).alias("old_buy_mask"), F.lit(7).alias("old_sell_mask"), F.col("close").alias("price"), F.lit("high").alias("confidence"),
        F.lit("ok").alias("quality_status"), F.lit(4).alias("threshold_profile_id"))
    new = new.withColumn("reason", F.concat(F.lit("steps "), F.col("steps").cast("string")))
    new = new.unionByName(new.withColumn("score", F.col("score") + 1))  # a second decision for the same day does not count
    return rounded(sg.store_signals(st.where(F.dayofmonth("signal_date") % 2 == 1).select("symbol", F.col("signal_date").alias("date")), new), 4, "score")


@query("sg4_size_fills", f"""WITH {STATE}, f AS (SELECT symbol, signal_date, (v % 3 + 1)::INT AS d, (v % 4)::INT AS steps, v % 5 AS held, floor(close) AS price FROM st),
g AS (SELECT *, CASE WHEN held % 2 = 0 THEN d ELSE -d END AS delta FROM f)
SELECT symbol, signal_date, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, {r('CASE WHEN delta < 0 AND (steps <= 0 OR held <= 0) THEN NULL WHEN delta > 0 THEN 10000 * delta / 3 / price ELSE held * -delta / steps END', 'quantity', 6)},
  {r('0.0015 * price * CASE WHEN delta < 0 AND (steps <= 0 OR held <= 0) THEN NULL WHEN delta > 0 THEN 10000 * delta / 3 / price ELSE held * -delta / steps END', 'fee', 6)},
  CASE WHEN delta < 0 AND (steps <= 0 OR held <= 0) THEN steps ELSE greatest(0, least(3, steps + delta)) END::INT AS steps_after,
  (5 + CASE WHEN NOT (delta < 0 AND (steps <= 0 OR held <= 0)) AND steps + delta <= 0 THEN 1 ELSE 0 END)::INT AS cycle_after FROM g""")
def _(spark, sf):
    st = state(spark, sf)
    v = F.col("v")
    sign = F.when((v % 5) % 2 == 0, 1).otherwise(-1)
    fills = st.select(*ON, ((v % 3 + 1) * sign).cast("int").alias("delta"), (v % 4).cast("int").alias("position_steps"), (v % 5).alias("held"),
                      F.lit(10000).alias("capital"), F.floor("close").alias("fill_price"), F.lit(5).alias("cycle_id"))
    out = sg.size_fills(fills).select(*ON, "side", "quantity", "fee", "steps_after", "cycle_after")
    return rounded(out, 6, "quantity", "fee")


# --- ledgers -------------------------------------------------------------------------------------------------

# A record per symbol and day: the text is the day's close; on day 50 of a year the link is wrong.
CHAIN = f"""{fx.BARS}, {fx.CALENDAR}, rec AS (SELECT symbol AS ledger, date, symbol || ':' || date || ':' || volume::BIGINT AS body FROM bars),
k AS (SELECT *, lag(sha256(body)) OVER (PARTITION BY ledger ORDER BY date) AS prev, lag(date) OVER (PARTITION BY ledger ORDER BY date) AS pd FROM rec),
nx AS (SELECT session, lead(session) OVER (ORDER BY session) AS nxt FROM calendar)"""


def chain(spark, sf):
    from quoteflow.operators.timeline import Series

    body = F.concat_ws(":", "symbol", F.col("date").cast("string"), F.col("volume").cast("bigint").cast("string"))
    records = fx.daily_bars(spark, sf).select(F.col("symbol").alias("ledger"), "date", body.alias("body"))
    s = Series.cut(records, 1, "ledger")
    s = s.add(_p=F.lag(F.sha2("body", 256)).over(s.window()))
    link = F.when(F.dayofyear("date") == 50, "broken").otherwise(F.coalesce("_p", F.sha2(F.lit("lock"), 256)))
    return s.add(previous_sha256=link).done("_p")


@query("sg13_verify_chain", f"""WITH {CHAIN} SELECT ledger, count(*) AS records, count_if(dayofyear(date) = 50) AS broken_links, count_if(pd IS NOT NULL AND nxt IS DISTINCT FROM date) AS skipped_sessions,
  count_if(dayofyear(date) = 50) = 0 AND count_if(pd IS NOT NULL AND nxt IS DISTINCT FROM date) = 0 AS valid FROM k LEFT JOIN nx ON nx.session = k.pd GROUP BY 1""")
def _(spark, sf):
    return audit.verify_chain(chain(spark, sf), fx.calendar(spark, sf), F.sha2(F.lit("lock"), 256))


@query("sg14_recompute_diff", f"""WITH {fx.BARS}, {fx.ALTERNATE} SELECT b.symbol AS ledger, b.date FROM bars b LEFT JOIN alternate x ON x.symbol = b.symbol AND x.date = b.date
WHERE x.symbol IS NULL OR x.adjusted_close <> b.adjusted_close""")
def _(spark, sf):
    payload = lambda df: df.select(F.col("symbol").alias("ledger"), "date", "close", "adjusted_close")
    return audit.recompute_diff(payload(fx.daily_bars(spark, sf)), payload(fx.alternate_bars(spark, sf))).select("ledger", "date")


# An account record per symbol and day, with unbalanced days and wrong fee totals among the first twenty of some symbols.
LEDGER = f"""{fx.BARS}, num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, volume::BIGINT AS v FROM bars),
lg AS (SELECT symbol AS ledger, rn, v, close, v % 4 = 0 AS off, (v % 3)::DOUBLE AS fee, v % 2 = 0 AS filled, lag(v % 3 = 0) OVER (PARTITION BY symbol ORDER BY date) AS allowed,
  (v % 11 = 0) <> coalesce(lag(v % 11 = 0) OVER (PARTITION BY symbol ORDER BY date), false) AS fee_off FROM num)"""


@query("agg14_audit_ledger", f"""WITH {LEDGER}, w AS (SELECT *, last_value(close) OVER (PARTITION BY ledger ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM lg WHERE rn <= 20)
SELECT ledger, count(*) AS observed_sessions, count_if(off)::BIGINT AS balance_issues, count_if(fee_off)::BIGINT AS fee_issues, sum(CASE WHEN filled AND NOT coalesce(allowed, true) THEN 1 ELSE 0 END)::BIGINT AS unmatched_fills,
  count_if(v % 6 = 0) AS delayed_recordings, count_if(v % 7 = 0) AS late_signals, any_value(last) AS pool_return_pct, min(close) AS pool_max_drawdown_pct, any_value(last) AS benchmark_return_pct,
  min(close) AS benchmark_max_drawdown_pct, count(*) = 20 AND count_if(off) = 0 AND count_if(fee_off) = 0 AND sum(CASE WHEN filled AND NOT coalesce(allowed, true) THEN 1 ELSE 0 END) = 0 AS ready_for_review,
  count(*) = 20 AND count_if(off) = 0 AND count_if(fee_off) = 0 AND sum(CASE WHEN filled AND NOT coalesce(allowed, true) THEN 1 ELSE 0 END) = 0 AND count_if(v % 7 = 0) = 0 AS clean_forward_sample FROM w GROUP BY 1""")
def _(spark, sf):
    v = F.col("volume").cast("bigint")
    fee = F.when(v % 2 == 0, (v % 3).cast("double")).otherwise(0.0)
    rows = running(fx.daily_bars(spark, sf), fees_cumulative=("sum", fee))
    value = F.col("close") * 2
    fill = F.struct(F.lit("X").alias("symbol"), F.lit("buy").alias("side"), (v % 3).cast("double").alias("fee"))
    empty = F.array().cast("array<struct<symbol:string,side:string,fee:double>>")
    held = F.create_map(F.lit("X"), F.struct(value.alias("market_value")))

    def account(equity, fills, fees):
        return F.struct(F.lit(100.0).alias("cash"), equity.alias("equity"), fees.alias("fees_cumulative"), F.col("close").alias("return_pct"),
                        F.col("close").alias("drawdown_pct"), held.alias("positions"), fills.alias("fills"))

    records = rows.select(
        F.col("symbol").alias("ledger"), "date",
        account(100 + value + F.when(v % 4 == 0, 1.0).otherwise(0.0), F.when(v % 2 == 0, F.array(fill)).otherwise(empty),
                F.col("fees_cumulative") + F.when(v % 11 == 0, 0.5).otherwise(0.0)).alias("pool"),
        account(100 + value, empty, F.lit(0.0)).alias("benchmark"),
        F.when(v % 3 == 0, F.array(F.struct(F.lit("X").alias("symbol"), F.lit("buy_candidate").alias("side")))).otherwise(
            F.array().cast("array<struct<symbol:string,side:string>>")).alias("intents"),
        F.array(F.lit("X")).alias("kickoff"), F.when(v % 6 == 0, 1).otherwise(0).alias("recording_delay_days"), (v % 7 != 0).alias("precommitted"),
    )
    return audit.audit_ledger(records)


@query("sg15_ledger_state", f"""WITH {STATE} SELECT symbol, signal_date, CASE WHEN v % 29 = 0 THEN 'not_precommitted' WHEN v % 23 = 0 THEN 'audit_failed' WHEN v % 19 = 0 AND signal_date >= DATE '1996-01-01' THEN 'data_lag'
  WHEN v % 17 = 0 THEN 'recording_gap' WHEN v % 41 = 0 THEN 'waiting_first_session' WHEN v % 41 >= 20 THEN 'observation_complete' ELSE 'recording' END AS state FROM st""")
def _(spark, sf):
    v = F.col("v")
    facts = state(spark, sf).select(
        *ON, (v % 29 != 0).alias("precommitted"), (v % 23 == 0).cast("int").alias("issues"), F.col("signal_date").alias("completed"),
        F.when(v % 19 == 0, F.date_sub("signal_date", 1)).otherwise(F.col("signal_date")).alias("cutoff"), F.lit("1996-01-01").cast("date").alias("start"),
        (v % 17 == 0).cast("int").alias("missing"), (v % 41).alias("recorded"))
    return audit.ledger_state(facts).select(*ON, "state")


# --- observation and history ---------------------------------------------------------------------------------


# Sessions are the days on which at least two symbols other than R-F traded; a symbol without a bar on one of them is blocked.
@query("sc4_observation", f"""{FIVE}, l AS (SELECT symbol, count(*) AS bars, min(date) AS first_date, max(date) AS last_date, arg_max(rn, date) AS rn FROM five GROUP BY 1),
ses AS (SELECT date FROM bars WHERE symbol <> 'R-F' GROUP BY 1 HAVING count(DISTINCT symbol) >= 2),
gap AS (SELECT DISTINCT l.symbol FROM l JOIN ses ON ses.date BETWEEN first_date AND last_date WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = l.symbol AND b.date = ses.date))
SELECT l.symbol, CASE WHEN g.symbol IS NOT NULL THEN 'blocked' WHEN f.score IS NULL THEN 'insufficient' WHEN l.last_date < (SELECT max(date) FROM bars) THEN 'stale' ELSE 'ok' END AS status, bars, last_date,
  {', '.join(r(f'CASE WHEN g.symbol IS NULL THEN f.{c} END', c, 3) for c in ('price_position', 'momentum', 'volume_flow', 'volatility_state', 'urgency', 'score'))}
FROM l JOIN five f ON f.symbol = l.symbol AND f.rn = l.rn LEFT JOIN gap g ON g.symbol = l.symbol""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf)
    sessions = bars.where("symbol <> 'R-F'").groupBy(F.col("date").alias("session")).agg(F.count_distinct("symbol").alias("n")).where("n >= 2").select("session")
    status, _points = ob.observation(bars, sessions, bars.agg(F.max("date").alias("expected_date")))
    return rounded(status, 3, *scores.FIVE_COMPONENT_WEIGHTS, "score")


@query("sc4_points", f"""{FIVE} SELECT symbol, date, {r('score', 'score', 3)} FROM five QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 756""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf)
    none = bars.select(F.col("date").alias("session")).where(F.lit(False))
    _status, points = ob.observation(bars, none, bars.agg(F.max("date").alias("expected_date")))
    return rounded(points, 3, "score")


# Requests made from customers: symbol lists with unknown and repeated names, ranges and windows of different length.
@query("flt2_request_problems", f"""WITH {fx.BARS}, q AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ['A-F', 'R-F'] WHEN 1 THEN ['A-F', 'X'] WHEN 2 THEN ['N-O', 'N-O'] WHEN 3 THEN []::VARCHAR[] ELSE ['A-F', 'N-O', 'R-F'] END AS symbols,
  c_custkey % 7 AS years, c_custkey % 11 AS k FROM customer)
SELECT id, concat_ws(',', CASE WHEN id % 5 IN (1, 3, 4) THEN 'symbols' END, CASE WHEN years = 0 OR years > 5 THEN 'range' END, CASE WHEN k = 0 OR k > 9 THEN 'limit' END) AS problems FROM q""")
def _(spark, sf):
    names = {0: ["A-F", "R-F"], 1: ["A-F", "X"], 2: ["N-O", "N-O"], 4: ["A-F", "N-O", "R-F"]}
    rest = F.col("c_custkey") % 5
    chosen = F.array().cast("array<string>")
    for k, v in names.items():
        chosen = F.when(rest == k, F.array(*[F.lit(x) for x in v])).otherwise(chosen)
    start = F.lit("1995-01-01").cast("date")
    end = F.date_add(start, (365 * (F.col("c_custkey") % 7) - 1).cast("int"))
    requests = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), chosen.alias("symbols"), start.alias("start"), end.alias("end"), ((F.col("c_custkey") % 11) * 500 - 1).alias("limit"))
    found = ob.request_problems(requests, fx.daily_bars(spark, sf), most_symbols=2, most_days=365 * 5, most_rows=4500)
    return found.select("id", F.array_join("problems", ",").alias("problems"))


@query("sc4_contributions", f"""{FIVE}, l AS (SELECT * FROM five WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
{' UNION ALL '.join(f"SELECT symbol, date, '{c}' AS component, {w}::DOUBLE AS weight, {r(c, 'value', 3)}, {r(f'{c} * {w}::DOUBLE', 'contribution', 3)} FROM l" for c, w in scores.FIVE_COMPONENT_WEIGHTS.items())}""")
def _(spark, sf):
    from quoteflow.operators.joins import latest

    scored = ob.scored_bars(fx.daily_bars(spark, sf)).where("score IS NOT NULL").select(*KEY, *scores.FIVE_COMPONENT_WEIGHTS)
    return rounded(scores.contributions(latest(scored, ["date"]), scores.FIVE_COMPONENT_WEIGHTS), 3, "value", "contribution")


@query("sc5_indicator_history", f"""{TWO} SELECT symbol, date, close AS price, {r('score', 'score')}, {r('score_rank', 'percentile')} FROM two
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 756""")
def _(spark, sf):
    out = ob.indicator_history(scores.two_input_score(fx.daily_bars(spark, sf), FROZEN_PARAMETERS))
    return rounded(out, 4, "score", "percentile")


@query("sc5_history_view", f"""{TWO}, w AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 600),
l AS (SELECT symbol, arg_max(coalesce(score, 'nan'::DOUBLE), date) AS cur FROM two GROUP BY 1)
SELECT w.symbol, count(score) AS observations, {r('min(score)', 'observed_min', 3)}, {r('max(score)', 'observed_max', 3)}, count_if(score <= -20) AS fear_days, count_if(score >= 20) AS greed_days,
  CASE WHEN NOT isnan(any_value(cur)) THEN count_if(score >= cur) END AS at_or_above_current FROM w JOIN l USING (symbol) GROUP BY 1""")
def _(spark, sf):
    _points, table = ob.history_view(scores.two_input_score(fx.daily_bars(spark, sf), FROZEN_PARAMETERS), 600)
    at = lambda t, op: F.max(F.when((F.col("threshold") == t) & (F.col("operator") == op), F.col("count")))
    out = table.groupBy("symbol", "observations", "observed_min", "observed_max", "at_or_above_current").agg(
        at(-20, "<=").alias("fear_days"), at(20, ">=").alias("greed_days"))
    return rounded(out, 3, "observed_min", "observed_max")


@query("flt1_predicates", """SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice IS NOT NULL AND o_custkey <> 1""")
def _(spark, sf):
    # every predicate is on a stored column, so the scan gets all of them
    return fx.table(spark, sf, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("o_totalprice").isNotNull() & (F.col("o_custkey") != 1)
    ).select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("date"), "o_totalprice")
