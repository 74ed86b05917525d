"""Registered queries that run operators over many chunks of a key, with the SQL of their namesakes: what runs at scale must give the same answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.operators import books
from quoteflow.operators import recursive as rec
from quoteflow.operators.ranks import rolling_percentile, with_ranks
from quoteflow.operators.signals import ladder
from quoteflow.operators.timeline import Series
from quoteflow.plans import evaluation as ev
from quoteflow.plans import fixtures as fx
from quoteflow.plans import scores
from quoteflow.plans.registry import SQL, query, rounded
from quoteflow.plans.series_queries import KEY, driver
from quoteflow.plans.signal_queries import scored, sweep_table

#: rows of a chunk: a key of the bar fixture is about six of them, a book about four
ROWS = 400


@query("ts1_many_chunks", SQL["ts1_rolling_percentile"])
def _(spark, sf):
    s = Series.cut(fx.daily_bars(spark, sf), 252, size=ROWS)
    s = s.add(ret=fs.change(s, "adjusted_close"))
    return rounded(with_ranks(s, rolling_percentile("pct", "ret", 252)).done().select(*KEY, "pct"), 6, "pct")


@query("ts26_many_chunks", SQL["ts26_asymmetric_filter"])
def _(spark, sf):
    return rounded(rec.asymmetric(driver(spark, sf), "x", "filtered", size=ROWS).drop("x"), 4, "filtered")


@query("sc2_many_chunks", SQL["sc4_points"])
def _(spark, sf):
    from quoteflow.operators.timeline import last_rows

    out = scores.five_component_score(fx.daily_bars(spark, sf), size=ROWS).select(*KEY, "score")
    return rounded(last_rows(out, 756), 3, "score")


@query("sg2_many_chunks", SQL["sg2_ladder"])
def _(spark, sf):
    return rounded(ladder(scored(spark, sf), size=ROWS), 4, "score")


@query("sg5_many_chunks", SQL["sg5_equity_curve"])
def _(spark, sf):
    curve, _ = ev.evaluate(scored(spark, sf), size=ROWS)
    return rounded(curve.select(*KEY, F.log("equity").alias("log_equity"), "position"), 6, "log_equity", "position")


@query("agg10_many_chunks", SQL["agg10_average_cost_book"])
def _(spark, sf):
    book = books.average_cost_book(fx.trades(spark, sf), fx.instrument_bars(spark, sf), order=fx.TRADE_ORDER, size=ROWS)
    return rounded(rounded(book, 4, "quantity", "fees"), 2, "cost", "realized_pnl")


@query("sg6_many_chunks", SQL["sg6_sweep"])
def _(spark, sf):
    return sweep_table(ev.sweep(scored(spark, sf), size=250))
