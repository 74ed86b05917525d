"""Verification of recorded ledgers: hash chain, cash and fee balance, recomputation, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.operators.joins import next_session
from quoteflow.operators.timeline import Series, as_list, positions

TOLERANCE = 1e-6
WINDOW = 20


def verify_chain(records: DataFrame, calendar: DataFrame, lock: Column, key="ledger", ts: str = "date", session: str = "session") -> DataFrame:
    """Per ledger: records, broken links and skipped sessions. ``records``: body (recorded text), previous_sha256."""
    keys = as_list(key)
    dated = next_session(records.select(*keys, ts, "body", "previous_sha256"), calendar, ts, "_due", session)
    s = Series.cut(dated.withColumn("_digest", F.sha2("body", 256)), 1, keys, ts)
    s = s.add(_before=F.lag("_digest").over(s.window()), _expected=F.lag("_due").over(s.window()), _first=F.lag(ts).over(s.window()).isNull())
    link = F.when(F.col("_first"), lock).otherwise(F.col("_before"))
    table = s.done().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.coalesce(F.col("previous_sha256") == link, F.lit(False))).alias("broken_links"),
        F.count_if(~F.col("_first") & ~F.coalesce(F.col(ts) == F.col("_expected"), F.lit(False))).alias("skipped_sessions"),
    )
    return table.withColumn("valid", (F.col("broken_links") == 0) & (F.col("skipped_sessions") == 0))


def audit_ledger(records: DataFrame, tol: float = TOLERANCE, window: int = WINDOW, key="ledger", ts: str = "date") -> DataFrame:
    """Audit of the first ``window`` records of each ledger.

    ``records`` has structs ``pool`` and ``benchmark`` with cash, equity, fees_cumulative, return_pct, drawdown_pct,
    positions (map to struct with market_value) and fills (array of symbol, side, fee); ``intents`` (array of symbol, side),
    recording_delay_days and precommitted. The first record's fills are matched against ``kickoff`` (array of symbols).
    """
    keys = as_list(key)
    first = positions(records, keys, ts).where(F.col("pos") <= window)
    s = Series.cut(first, 1, keys, ts)
    fees0 = lambda account: F.coalesce(F.lag(F.col(account)["fees_cumulative"]).over(s.window()), F.lit(0.0))
    sides = F.transform("intents", lambda i: F.struct(i["symbol"].alias("symbol"), F.when(i["side"] == "buy_candidate", "buy").otherwise("sell").alias("side")))
    opening = F.transform("kickoff", lambda name: F.struct(name.alias("symbol"), F.lit("buy").alias("side")))
    s = s.add(_pool0=fees0("pool"), _bench0=fees0("benchmark"), _sides=sides)
    s = s.add(_allowed=F.coalesce(F.lag("_sides").over(s.window()), opening))
    rows = s.done()

    def unbalanced(account: str) -> Column:
        held = F.aggregate(F.map_values(F.col(account)["positions"]), F.lit(0.0), lambda a, p: a + p["market_value"])
        return F.abs(F.col(account)["cash"] + held - F.col(account)["equity"]) > tol

    def fees_off(account: str, before: str) -> Column:
        paid = F.aggregate(F.col(account)["fills"], F.lit(0.0), lambda a, f: a + f["fee"])
        return F.abs(F.col(before) + paid - F.col(account)["fees_cumulative"]) > tol

    made = F.transform(F.col("pool")["fills"], lambda f: F.struct(f["symbol"].alias("symbol"), f["side"].alias("side")))
    unmatched = F.size(F.filter(made, lambda f: ~F.array_contains(F.col("_allowed"), f)))
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed_sessions"),
        (F.count_if(unbalanced("pool")) + F.count_if(unbalanced("benchmark"))).alias("balance_issues"),
        (F.count_if(fees_off("pool", "_pool0")) + F.count_if(fees_off("benchmark", "_bench0"))).alias("fee_issues"),
        F.sum(unmatched).alias("unmatched_fills"), F.count_if(F.col("recording_delay_days") > 0).alias("delayed_recordings"),
        F.count_if(~F.col("precommitted")).alias("late_signals"),
        F.max_by(F.col("pool")["return_pct"], ts).alias("pool_return_pct"), F.min(F.col("pool")["drawdown_pct"]).alias("pool_max_drawdown_pct"),
        F.max_by(F.col("benchmark")["return_pct"], ts).alias("benchmark_return_pct"),
        F.min(F.col("benchmark")["drawdown_pct"]).alias("benchmark_max_drawdown_pct"),
    )
    clean = (F.col("balance_issues") == 0) & (F.col("fee_issues") == 0) & (F.col("unmatched_fills") == 0)
    ready = (F.col("observed_sessions") == window) & clean
    return table.withColumns({"ready_for_review": ready, "clean_forward_sample": ready & (F.col("late_signals") == 0)})


def recompute_diff(stored: DataFrame, fresh: DataFrame, on: Sequence[str] = ("ledger", "date")) -> DataFrame:
    """Recorded rows whose recomputed payload differs or is missing."""
    keys = list(on)
    columns = [c for c in stored.columns if c not in keys]
    left = stored.select(*keys, F.to_json(F.struct(*columns)).alias("stored_payload"))
    right = fresh.select(*keys, F.to_json(F.struct(*columns)).alias("fresh_payload"))
    both = left.join(right, keys, "left")
    return both.where(~F.col("stored_payload").eqNullSafe(F.col("fresh_payload")))


def ledger_state(df: DataFrame, target: int = WINDOW) -> DataFrame:
    """State label from facts: precommitted, issues, cutoff, completed, start, missing, recorded."""
    state = (
        F.when(~F.col("precommitted"), "not_precommitted")
        .when(F.col("issues") > 0, "audit_failed")
        .when((F.col("cutoff") < F.col("completed")) & (F.col("completed") >= F.col("start")), "data_lag")
        .when(F.col("missing") > 0, "recording_gap")
        .when(F.col("recorded") == 0, "waiting_first_session")
        .when(F.col("recorded") >= target, "observation_complete")
        .otherwise("recording")
    )
    return df.withColumn("state", state)
