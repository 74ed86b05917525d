"""Registered queries: cleaning, verdicts and reconciliation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quoteflow.operators import quality as qc
from quoteflow.plans import daily
from quoteflow.plans import fixtures as fx
from quoteflow.plans.registry import query, r, rounded
from quoteflow.plans.series_queries import FROZEN_PARAMETERS
from quoteflow.session import settle
from quoteflow.sources.readers import active_snapshot
from quoteflow.sources.writers import scratch_path

KEY = ["symbol", "date"]

# Raw rows: every line item as a bar report of its day; some prices are unreadable, infinite or missing.
RAW = """raw AS (
  SELECT l_returnflag || '-' || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_partkey % 50 = 0 THEN 'n/a' WHEN l_partkey % 50 = 1 THEN 'Infinity' ELSE CAST(l_suppkey AS VARCHAR) END AS close_text,
    l_quantity AS q, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem)"""


@query("qc1_clean_bars", f"""WITH {RAW},
c AS (SELECT *, TRY_CAST(close_text AS DOUBLE) AS close FROM raw),
k AS (SELECT * FROM c WHERE close IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)
SELECT symbol, date, q AS open, q AS high, q AS low, close, close AS adjusted_close, coalesce(v, 0) AS volume, 1.0::DOUBLE AS split_factor
FROM k WHERE NOT isinf(close)""")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    part = F.col("l_partkey") % 50
    text = F.when(part == 0, "n/a").when(part == 1, "Infinity").otherwise(F.col("l_suppkey").cast("string"))
    raw = lines.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date"),
        *[F.col("l_quantity").alias(c) for c in ("open", "high", "low")], text.alias("close"), text.alias("adjusted_close"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity")).alias("volume"), F.lit(None).cast("double").alias("split_factor"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )
    return qc.clean_bars(raw, "seq").drop("seq")


VERDICT = f"""WITH {fx.BARS},
v AS (SELECT symbol, date, (low > least(open, close) OR high < greatest(open, close) OR least(open, high, low, close, adjusted_close) <= 0) AS bad,
  abs(adjusted_close / lag(adjusted_close) OVER (PARTITION BY symbol ORDER BY date) - 1) > 0.8::DOUBLE AS jump FROM bars),
g AS (SELECT symbol, count(*) AS bars, count_if(bad) AS invalid_bars, count_if(jump) AS jumps, max(date) AS last_date FROM v GROUP BY 1)"""


@query("qc2_series_verdict", f"""{VERDICT} SELECT symbol, bars, invalid_bars, jumps, last_date,
  CASE WHEN invalid_bars > 0 OR date_diff('day', last_date, DATE '2001-12-31') > 10 THEN 'blocked'
    WHEN jumps > 0 OR date_diff('day', last_date, DATE '2001-12-31') > 5 THEN 'warning' ELSE 'ok' END AS status,
  concat_ws('; ', CASE WHEN invalid_bars > 0 THEN invalid_bars || ' invalid bars' END, CASE WHEN jumps > 0 THEN 'adjusted move above 80 percent' END,
    CASE WHEN date_diff('day', last_date, DATE '2001-12-31') > 5 THEN 'last bar ' || last_date END) AS messages FROM g""")
def _(spark, sf):
    return qc.series_verdict(fx.daily_bars(spark, sf), F.lit("2001-12-31").cast("date")).withColumn("messages", F.array_join("messages", "; "))


TWO_SOURCES = f"""WITH {fx.BARS}, {fx.ALTERNATE},
j AS (SELECT b.symbol, b.date, b.adjusted_close AS a, x.adjusted_close AS b FROM bars b JOIN alternate x ON b.symbol = x.symbol AND b.date = x.date
  QUALIFY row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) <= 60),
m AS (SELECT symbol, a / lag(a) OVER w - 1 AS ra, b / lag(b) OVER w - 1 AS rb FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date)),
c AS (SELECT symbol, count(*) AS overlap, corr(ra, rb) AS correlation FROM m GROUP BY 1),
t AS (SELECT symbol, overlap, correlation, CASE WHEN overlap < 15 THEN 'warning' WHEN correlation IS NULL OR correlation < 0.95 THEN 'blocked' ELSE 'ok' END AS status FROM c)"""


@query("qc3_two_source_verdict", f"""{TWO_SOURCES} SELECT symbol, overlap, {r('correlation', 'correlation', 6)}, status,
  CASE WHEN overlap < 15 THEN 'too few common days' WHEN status = 'blocked' THEN 'sources disagree' END AS message FROM t""")
def _(spark, sf):
    return rounded(qc.two_source_verdict(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf)), 6, "correlation")


@query("qc4_choose_source", f"""{TWO_SOURCES},
s AS (SELECT symbol, CASE WHEN symbol LIKE 'A%' THEN NULL ELSE 'ok' END AS p, CASE WHEN symbol LIKE 'R%' THEN NULL ELSE 'ok' END AS f, status AS c FROM t)
SELECT symbol, CASE WHEN p IS NOT NULL THEN 'primary' ELSE 'fallback' END AS source,
  CASE WHEN p IS NULL THEN 'warning' WHEN f IS NULL THEN 'warning' WHEN c = 'blocked' THEN 'blocked' ELSE p END AS status,
  concat_ws('; ', CASE WHEN p IS NULL THEN 'short' ELSE symbol || ' is late' END, CASE WHEN p IS NULL THEN 'fallback used without a second source' WHEN f IS NULL THEN 'single source only' WHEN c = 'blocked' THEN 'sources disagree' END) AS messages FROM s""")
def _(spark, sf):
    compared = qc.two_source_verdict(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf))
    verdicts = compared.select(
        "symbol", F.when(~F.col("symbol").startswith("A"), "ok").alias("primary_status"),
        F.when(~F.col("symbol").startswith("R"), "ok").alias("fallback_status"),
        F.col("status").alias("comparison_status"), F.col("message").alias("comparison_message"),
        F.array(F.concat("symbol", F.lit(" is late"))).alias("primary_messages"), F.array(F.lit("short")).alias("fallback_messages"),
    )
    return qc.choose_source(verdicts).select("symbol", "source", "status", F.array_join("messages", "; ").alias("messages"))


# Two providers of the same bars: the first stops early for some symbols, the second never has symbol R-F's last day.
PROVIDERS = f"""WITH {fx.BARS}, e AS (SELECT max(date) AS expected FROM bars),
p AS (SELECT symbol, date, 'public' AS source FROM bars WHERE symbol NOT LIKE 'N%' AND symbol NOT LIKE 'R%' OR date < (SELECT expected - 3 FROM e)
  UNION ALL SELECT symbol, date, 'yahoo' FROM bars WHERE symbol <> 'R-F' OR date < (SELECT expected FROM e))"""


@query("qc5_freshest_source", f"""{PROVIDERS},
h AS (SELECT symbol, source, bool_or(date = (SELECT expected FROM e)) AS has FROM p GROUP BY ALL)
SELECT symbol, CASE WHEN bool_or(has AND source = 'public') THEN 'public' WHEN bool_or(has AND source = 'yahoo') THEN 'yahoo' END AS source,
  CASE WHEN bool_or(has) THEN 'ok' ELSE 'error' END AS status FROM h GROUP BY 1""")
def _(spark, sf):
    bars = fx.daily_bars(spark, sf).select(*KEY)
    end = bars.agg(F.max("date").alias("expected"))
    dated = bars.join(F.broadcast(end))
    late = F.col("symbol").startswith("N") | F.col("symbol").startswith("R")
    public = dated.where(~late | (F.col("date") < F.date_sub("expected", 3))).withColumn("source", F.lit("public"))
    yahoo = dated.where((F.col("symbol") != "R-F") | (F.col("date") < F.col("expected"))).withColumn("source", F.lit("yahoo"))
    return qc.freshest_source(public.unionByName(yahoo), F.col("expected"), ["public", "yahoo"])


# Three sources per order date and priority, identified by the order key.
REPORTS = """p AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, o_totalprice AS close,
  CASE o_orderkey % 3 WHEN 0 THEN 'stooq' WHEN 1 THEN 'desk' ELSE 'yahoo' END AS source FROM orders)"""


@query("qc6_prefer_source", f"""WITH {REPORTS} SELECT symbol, date, id, close, source FROM p
QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY CASE source WHEN 'yahoo' THEN 0 WHEN 'stooq' THEN 1 ELSE 2 END, id) = 1""")
def _(spark, sf):
    slot = F.col("o_orderkey") % 3
    reports = fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("close"), F.when(slot == 0, "stooq").when(slot == 1, "desk").otherwise("yahoo").alias("source"),
    )
    return qc.prefer_source(reports)


# Symbols of one letter get a zero volume on a few days, so that they are blocked.
def flawed(spark, sf):
    zero = F.col("symbol").startswith("R") & (F.dayofyear("date") == 42)
    return fx.daily_bars(spark, sf).withColumn("volume", F.when(zero, 0.0).otherwise(F.col("volume")))


@query("qc7_strict_gate", f"""WITH {fx.BARS},
f AS (SELECT *, CASE WHEN symbol LIKE 'R%' AND dayofyear(date) = 42 THEN 0 ELSE volume END AS vol FROM bars)
SELECT symbol, count_if(NOT (least(open, high, low, close, adjusted_close, vol) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high)))::BIGINT AS bad_rows,
  (count(*) - count(DISTINCT date))::BIGINT AS duplicate_rows,
  count_if(NOT (least(open, high, low, close, adjusted_close, vol) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high))) > 0 AS blocked
FROM f GROUP BY 1""")
def _(spark, sf):
    return qc.strict_gate(flawed(spark, sf))


@query("qc8_missing_sessions", f"""WITH {fx.BARS}, {fx.CALENDAR}, s AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1)
SELECT s.symbol, c.session AS date FROM s JOIN calendar c ON c.session BETWEEN s.lo AND s.hi
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.date = c.session)""")
def _(spark, sf):
    return qc.missing_sessions(fx.daily_bars(spark, sf), fx.calendar(spark, sf))


OVERLAP = f"""WITH {fx.BARS}, {fx.ALTERNATE},
j AS (SELECT b.symbol, abs(x.close / b.close - 1) AS raw, x.adjusted_close / b.adjusted_close AS ratio FROM bars b JOIN alternate x ON x.symbol = b.symbol AND x.date = b.date
  WHERE b.date BETWEEN DATE '1998-01-01' AND DATE '1998-02-15'),
g AS (SELECT symbol, count(*) AS days, max(raw) AS raw_error, median(ratio) AS factor FROM j GROUP BY 1),
e AS (SELECT j.symbol, max(abs(ratio / factor - 1)) AS ratio_error FROM j JOIN g USING (symbol) GROUP BY 1)"""


@query("qc9_overlap_factor", f"""{OVERLAP} SELECT g.symbol, days, {r('raw_error', 'raw_error', 8)}, {r('factor', 'factor', 8)}, {r('ratio_error', 'ratio_error', 8)},
  days >= 5 AND raw_error <= 0.002 AND factor BETWEEN 0.95 AND 1.05 AND ratio_error <= 1e-4 AS stable FROM g JOIN e USING (symbol)""")
def _(spark, sf):
    out = qc.overlap_factor(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf), "1998-01-01", "1998-02-15")
    return rounded(out, 8, "raw_error", "factor", "ratio_error")


# Reconciled append: the alternate source continues the F2 series after a cutoff, restated by 1.25 % or so.
@query("qc10_append_rebased", f"""WITH {fx.SECOND}, cut AS (SELECT DATE '2000-06-30' AS d),
f AS (SELECT symbol, date, open, high, low, close, adjusted_close * 1.02::DOUBLE AS adjusted_close, volume, split_factor FROM second),
w AS (SELECT symbol, median(f.adjusted_close / s.adjusted_close) AS factor FROM f JOIN second s USING (symbol, date) WHERE date BETWEEN DATE '2000-05-01' AND DATE '2000-06-30' GROUP BY 1)
SELECT symbol, date, adjusted_close FROM (
  SELECT symbol, date, round(adjusted_close, 4) + 0.0 AS adjusted_close FROM second WHERE date <= DATE '2000-06-30'
  UNION ALL SELECT symbol, date, round(f.adjusted_close / w.factor, 4) + 0.0 FROM f JOIN w USING (symbol) WHERE date > DATE '2000-06-30' AND date <= DATE '2000-12-31')""")
def _(spark, sf):
    bars = fx.second_bars(spark, sf)
    base = bars.where(F.col("date") <= "2000-06-30")
    fresh = bars.withColumn("adjusted_close", F.col("adjusted_close") * 1.02)
    factor = qc.overlap_factor(base, fresh, "2000-05-01", "2000-06-30")
    rebased = qc.rebase(base, fresh, factor.where("stable"), "2000-12-31")
    both = base.unionByName(rebased).select(*KEY, "adjusted_close")
    return rounded(both, 4, "adjusted_close")


AUDIT_SQL = f"""WITH {fx.SECOND}, {fx.CALENDAR},
f AS (SELECT symbol, date, open, high, low, close, adjusted_close * 1.02::DOUBLE AS adjusted_close, volume FROM second),
l AS (SELECT symbol, max(date) AS d FROM second WHERE date <= DATE '2000-06-30' GROUP BY 1),
x AS (SELECT f.* FROM f JOIN l USING (symbol) WHERE date > d AND date <= DATE '2000-12-31'),
n AS (SELECT symbol, count(*) AS new_rows FROM x GROUP BY 1),
m AS (SELECT l.symbol, count(*) AS missing FROM l JOIN calendar c ON c.session > l.d AND c.session <= DATE '2000-12-31'
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = l.symbol AND x.date = c.session) GROUP BY 1),
v AS (SELECT symbol, abs(adjusted_close / lag(adjusted_close) OVER (PARTITION BY symbol ORDER BY date) - 1) > 0.8::DOUBLE AS jump FROM x)
SELECT l.symbol, coalesce(new_rows, 0) AS new_rows, coalesce(missing, 0) AS missing,
  (SELECT CASE WHEN bool_or(jump) THEN 'warning' ELSE 'ok' END FROM v WHERE v.symbol = l.symbol) AS new_status, false AS accepted
FROM l LEFT JOIN n USING (symbol) LEFT JOIN m USING (symbol)"""


@query("qc10_append_audit", AUDIT_SQL)
def _(spark, sf):
    bars = fx.second_bars(spark, sf)
    base = bars.where(F.col("date") <= "2000-06-30")
    fresh = bars.withColumn("adjusted_close", F.col("adjusted_close") * 1.02)
    factor = qc.overlap_factor(base, fresh, "2000-05-01", "2000-06-30")
    _, audit = qc.append_rebased(base, fresh, factor, fx.calendar(spark, sf), "2000-12-31")
    return audit.select("symbol", "new_rows", "missing", "new_status", "accepted")


@query("qc11_prefix_equal", f"""WITH {fx.BARS}, {fx.ALTERNATE},
j AS (SELECT coalesce(b.symbol, x.symbol) AS symbol, b.symbol IS NOT NULL AS io, x.symbol IS NOT NULL AS inn, abs(b.close - x.close) AS d1,
  abs(b.adjusted_close - x.adjusted_close) AS d2 FROM bars b FULL JOIN alternate x ON b.symbol = x.symbol AND b.date = x.date)
SELECT symbol, count_if(NOT inn) AS only_old, count_if(NOT io) AS only_new, 0::BIGINT AS null_mismatches, {r('max(greatest(d1, d2))', 'max_deviation')}, false AS unchanged
FROM j GROUP BY 1""")
def _(spark, sf):
    out = qc.prefix_equal(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf), ["close", "adjusted_close"])
    return rounded(out, 4, "max_deviation")


@query("qc12_drift_guard", f"""WITH {fx.BARS}, {fx.ALTERNATE}
SELECT b.symbol, {r('max(abs(x.close / nullif(b.close, 0) - 1))', 'close_error', 8)}, {r('max(abs(x.adjusted_close - b.adjusted_close))', 'adjusted_close_error')},
  max(abs(x.close / nullif(b.close, 0) - 1)) <= 0.002 AND max(abs(x.adjusted_close - b.adjusted_close)) <= 0.1 AS within_limits
FROM bars b JOIN alternate x ON b.symbol = x.symbol AND b.date = x.date GROUP BY 1""")
def _(spark, sf):
    out = qc.drift_guard(fx.daily_bars(spark, sf), fx.alternate_bars(spark, sf), {"close": 0.002}, {"adjusted_close": 0.1})
    return rounded(rounded(out, 8, "close_error"), 4, "adjusted_close_error")


# Published: F1 adjusted closes up to the end of 1999.
PUBLISHED = f"""WITH {fx.BARS}, {fx.ALTERNATE}, pub AS (SELECT symbol, date, adjusted_close AS close FROM bars WHERE date <= DATE '1999-12-31'),
l AS (SELECT symbol, max(date) AS d, arg_max(close, date) AS c FROM pub GROUP BY 1),
s AS (SELECT l.symbol, l.d, l.c / nullif(x.adjusted_close, 0) AS continuity FROM l LEFT JOIN alternate x ON x.symbol = l.symbol AND x.date = l.d)"""


@query("qc13_anchor_continuity", f"""{PUBLISHED}
SELECT x.symbol, x.date, {r('s.continuity', 'continuity', 6)}, CASE WHEN x.date > s.d THEN x.adjusted_close * s.continuity
  WHEN p.symbol IS NOT NULL AND x.date > DATE '1999-10-31' THEN p.close ELSE x.adjusted_close END AS adjusted_close
FROM alternate x JOIN s ON s.symbol = x.symbol LEFT JOIN pub p ON p.symbol = x.symbol AND p.date = x.date""")
def _(spark, sf):
    published = fx.daily_bars(spark, sf).where(F.col("date") <= "1999-12-31").select(*KEY, F.col("adjusted_close").alias("close"))
    out = qc.anchor_continuity(published, fx.alternate_bars(spark, sf), "1999-10-31").select(*KEY, "continuity", "adjusted_close")
    return rounded(out, 6, "continuity")


@query("qc14_preserve_published", f"""WITH {fx.BARS}, {fx.ALTERNATE},
o AS (SELECT symbol, date, CASE WHEN day(date) = 1 THEN NULL ELSE adjusted_close END AS v FROM bars WHERE date <= DATE '1999-12-31')
SELECT x.symbol, x.date, CASE WHEN o.symbol IS NOT NULL THEN o.v ELSE x.adjusted_close END AS adjusted_close
FROM alternate x LEFT JOIN o ON o.symbol = x.symbol AND o.date = x.date""")
def _(spark, sf):
    old = fx.daily_bars(spark, sf).where(F.col("date") <= "1999-12-31").select(
        *KEY, F.when(F.dayofmonth("date") != 1, F.col("adjusted_close")).alias("adjusted_close"))
    new = fx.alternate_bars(spark, sf).select(*KEY, "adjusted_close")
    return qc.preserve_published(old, new, ["adjusted_close"])


@query("qc15_common_frontier", f"""WITH {fx.BARS}, {fx.CALENDAR},
d AS (SELECT c.session, count(DISTINCT b.symbol) AS n FROM calendar c LEFT JOIN bars b ON b.date = c.session WHERE c.session > DATE '1996-01-10' GROUP BY 1),
g AS (SELECT min(session) AS gap FROM d WHERE n < (SELECT count(DISTINCT symbol) FROM bars))
SELECT max(session) AS frontier FROM d, g WHERE gap IS NULL OR session < gap""")
def _(spark, sf):
    return qc.common_frontier(fx.daily_bars(spark, sf), fx.calendar(spark, sf), "1996-01-10")


@query("qc16_missing_symbols", f"""WITH {fx.BARS}, {fx.SECOND}
(SELECT symbol FROM second UNION SELECT symbol FROM bars) EXCEPT SELECT symbol FROM second WHERE date = DATE '1998-01-01'""")
def _(spark, sf):
    bars = fx.second_bars(spark, sf)
    wanted = bars.select("symbol").unionByName(fx.daily_bars(spark, sf).select("symbol"))
    return qc.missing_symbols(bars, F.lit("1998-01-01").cast("date"), wanted)


@query("qc17_observation_status", f"""WITH {fx.BARS}, {fx.CALENDAR},
g AS (SELECT symbol, count(*) AS bars, max(date) AS last_date, arg_max(close, date) AS latest,
  count_if(NOT (least(open, high, low, close, adjusted_close, CASE WHEN symbol LIKE 'R%' AND dayofyear(date) = 42 THEN 0 ELSE volume END) > 0)) > 0 AS blocked FROM bars GROUP BY 1)
SELECT symbol, bars, last_date, CASE WHEN blocked THEN 'blocked' WHEN latest < 1000 THEN 'insufficient' WHEN last_date < (SELECT max(session) FROM calendar) THEN 'stale'
  WHEN symbol LIKE 'A%' THEN 'warning' ELSE 'ok' END AS status FROM g""")
def _(spark, sf):
    bars = flawed(spark, sf)
    facts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("_c"))
    gate = qc.strict_gate(bars).select("symbol", F.col("blocked").alias("gate_blocked"))
    end = fx.calendar(spark, sf).agg(F.max("session").alias("expected_date"))
    table = facts.join(gate, "symbol").join(F.broadcast(end)).withColumns({
        "missing_sessions": F.lit(0), "worst_quality": F.when(F.col("symbol").startswith("A"), "warning").otherwise("ok"),
        "latest_score": F.when(F.col("_c") >= 1000, F.col("_c")),
    })
    return qc.observation_status(table).select("symbol", "bars", "last_date", "status")


@query("qc18_blocked_signal", f"""WITH {fx.BARS}, {fx.SECOND}
SELECT s.symbol, DATE '2002-01-02' AS date, s.price, coalesce(b.m, 0) AS market_position, coalesce(b.m, 0) / 2 AS etf_position, 0.0::DOUBLE AS volatility, 0.0::DOUBLE AS trend,
  coalesce(b.m, 0) / 4 AS score, 'data_blocked' AS action, 0 AS target_step_delta, 'blocked' AS confidence, 'blocked' AS quality_status, 'stale' AS reason
FROM (SELECT symbol, arg_max(close, date) AS price FROM second GROUP BY 1 UNION ALL SELECT symbol, arg_max(close, date) FROM bars GROUP BY 1) s
LEFT JOIN (SELECT symbol, arg_max(high, date) AS m FROM bars GROUP BY 1) b USING (symbol)""")
def _(spark, sf):
    bars, other = fx.daily_bars(spark, sf), fx.second_bars(spark, sf)
    high = F.col("high")
    stored = bars.select(*KEY, high.alias("market_position"), (high / 2).alias("etf_position"), F.lit(0.0).alias("volatility"),
                         F.lit(0.0).alias("trend"), (high / 4).alias("score"))
    blocked = bars.unionByName(other).groupBy("symbol").agg(F.max_by("close", "date").alias("price")).withColumns(
        {"date": F.lit("2002-01-02").cast("date"), "reason": F.lit("stale")})
    return qc.blocked_signal(stored, blocked)


@query("qc19_panel_price_check", f"""WITH {fx.SECOND}, {fx.CALENDAR}, d AS (SELECT session FROM calendar WHERE session BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')
SELECT s.symbol, (SELECT count(*) FROM d) - count(x.date) AS bad_days, (SELECT count(*) FROM d) = count(x.date) AS valid
FROM (SELECT DISTINCT symbol FROM second) s LEFT JOIN (SELECT symbol, date FROM second WHERE date IN (SELECT session FROM d) AND open > 0 AND close > 0) x ON x.symbol = s.symbol GROUP BY 1""")
def _(spark, sf):
    days = fx.calendar(spark, sf).where(F.col("session").between("1998-01-01", "1998-03-31")).withColumnRenamed("session", "date")
    return qc.panel_price_check(fx.second_bars(spark, sf), days)


# --- daily chain ---------------------------------------------------------------------------------------------

# Gentle prices on the second series' days, over the days that all its symbols have. Two days are published, each from a source with another adjustment; the
# third source is a percent off for one symbol in the overlap, so its day fails and the second one stays.
@query("e2_daily_chain", f"""WITH {fx.SECOND}, p AS (SELECT symbol, date, 100 + (date_diff('day', DATE '1970-01-01', date) % 17) / 100::DOUBLE AS close FROM second WHERE date <= DATE '1997-06-30')
SELECT symbol, count(*) AS bars, max(date) AS last_date, {r('sum(close)', 'close_sum', 3)}, DATE '1997-06-30' AS snapshot_date, 'failed' AS status, 'appended bars: 1-URGENT' AS reason FROM p GROUP BY 1""")
def _(spark, sf):
    days = fx.second_bars(spark, sf).select(*KEY)
    price = 100 + (F.unix_date("date") % 17) / 100
    bars = settle(days.select(*KEY, *[price.alias(c) for c in ("open", "high", "low", "close", "adjusted_close")], F.lit(10.0).alias("volume"), F.lit(1.0).alias("split_factor")))
    calendar = bars.groupBy(F.col("date").alias("session")).agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("session")
    base = bars.where("date <= DATE'1996-12-31'")
    root = scratch_path(spark, "daily")
    overlap = ("1996-10-01", "1996-12-31")
    for day, shift, wrong in ((date(1997, 3, 31), 1.02, 1.0), (date(1997, 6, 30), 1.03, 1.0), (date(1997, 9, 30), 1.01, 1.01)):
        off = F.when(F.col("symbol") == "1-URGENT", wrong).otherwise(1.0)
        fresh = bars.withColumns({"adjusted_close": F.col("adjusted_close") * shift, "close": F.col("close") * off})
        try:
            daily.update(spark, root, base, fresh, calendar, day, overlap, FROZEN_PARAMETERS)
        except daily.ChainStopped:
            pass
    active = active_snapshot(spark, root).select("snapshot_date")
    status = spark.read.schema("status STRING, reason STRING").json(f"{root}/status.json")
    rows = daily.published_inputs(spark, root, daily.published_day(spark, root)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_date"), F.sum("close").alias("close_sum"))
    return rounded(rows.join(F.broadcast(active)).join(F.broadcast(status)), 3, "close_sum")  # single rows
