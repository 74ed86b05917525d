"""Decision rules read off a snapshot of positions and signals: intents, exits, entries, desk labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.scalars import finite

HELD = 1e-9
MAX_LOTS = 4
STEP_PROFIT = 0.10


@dataclass(frozen=True)
class Rule:
    """Parameters of the execution rules (defaults are the published ones)."""

    buy_score: float = -20
    add_drop: float = 0.10
    buy_gap_days: int = 7
    sell_score: float = 40
    profit_target: float = 0.30
    max_hold_days: int = 60
    sell_gap_days: int = 3
    reentry_days: int = 7
    exit_mode: str = "score_or_profit"
    trailing_drop: float = 0.10
    stop_loss: float | None = None
    idle_exit_days: int | None = None
    idle_exit_band: float = 0.05


def _with_day(on: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*on, "signal_date"]))


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def next_open_intents(sig: DataFrame, pos: DataFrame, profit: float = 0.55, rank: float = 20, gap: float = 0.05,
                      on: Sequence[str] = ("symbol",)) -> DataFrame:
    """Intents for the next open: sell at the profit target, else a buy candidate at a low rank below the last buy.

    ``sig``: close, percentile. ``pos``: shares, cost_basis, last_buy.
    """
    rows = sig.join(pos, list(on), "left")
    shares = F.coalesce("shares", F.lit(0.0))
    gain = F.col("close") / (F.col("cost_basis") / shares) - 1
    selling = (shares > 1e-10) & (gain >= profit)
    low = finite("percentile").isNotNull() & (F.col("percentile") <= rank)
    below = F.col("last_buy").isNull() | (F.col("close") <= F.col("last_buy") * (1 - gap))
    side = F.when(F.coalesce(selling, F.lit(False)), "sell").when(low & below, "buy_candidate")
    return rows.withColumn("side", side).where(F.col("side").isNotNull()).select(
        *on, "side", F.when(F.col("side") == "sell", "profit_target").otherwise("fear_and_gap").alias("reason"),
        F.when(F.col("side") == "buy_candidate", F.col("percentile")).alias("percentile"),
    )


def exit_triggers(pos: DataFrame, sig: DataFrame, rule: Rule = Rule(), on: Sequence[str] = ("symbol",)) -> DataFrame:  # noqa: B008
    """Exit decision per open position with the updated peak and armed flag.

    ``pos``: shares, cost_basis, first_date, last_action_date, last_sell_date, peak_price, armed, sold_lots.
    ``sig``: signal_date, score, close, optionally sell_gate. Age and stop loss ignore the gap between sells. A position without a signal row
    is reported with the reason ``missing_signal``.
    """
    rows = pos.where(F.col("shares") > HELD).join(sig.withColumn("_seen", F.lit(True)), list(on), "left")
    score, close, day = F.col("score"), F.col("close"), F.col("signal_date")
    profit = close / (F.col("cost_basis") / F.col("shares")) - 1
    peak = F.greatest("peak_price", "close")
    score_hit = score >= _optional(rows, "sell_gate", F.lit(float(rule.sell_score)))
    profit_hit = profit >= rule.profit_target
    hit = score_hit | profit_hit
    pullback = close <= peak * (1 - rule.trailing_drop)
    armed = F.col("armed") | hit if rule.exit_mode in ("trail", "step_trail") else F.col("armed")
    if rule.exit_mode == "step_trail":
        step = profit >= rule.profit_target + STEP_PROFIT * F.col("sold_lots")
        first = F.col("sold_lots") == 0
        trigger = F.when(first, hit).otherwise(step | pullback)
        reason = F.when(first, "first_lot").when(step, "next_step").otherwise("pullback")
    elif rule.exit_mode == "trail":
        trigger, reason = armed & pullback, F.lit("pullback")
    else:
        trigger, reason = hit, F.when(score_hit, "greed").otherwise("profit_target")
    aged = F.datediff(day, "first_date") >= rule.max_hold_days
    idle = F.lit(False)
    if rule.idle_exit_days is not None:
        idle = (F.datediff(day, "last_action_date") >= rule.idle_exit_days) & (F.abs(profit) <= rule.idle_exit_band)
    loss = profit <= -rule.stop_loss if rule.stop_loss is not None else F.lit(False)
    reason = F.when(loss, "stop_loss").when(aged, "age").when(trigger, reason).when(idle, "idle")
    waiting = F.col("last_sell_date").isNotNull() & (F.datediff(day, "last_sell_date") < rule.sell_gap_days)
    wanted = trigger | aged | idle | loss
    fired = wanted & (aged | loss | ~F.coalesce(waiting, F.lit(False)))
    return rows.select(
        *_with_day(on), profit.alias("profit"), peak.alias("peak_price"), armed.alias("armed"),
        F.coalesce(fired, F.lit(False)).alias("exit"), F.when(F.col("_seen").isNull(), "missing_signal").when(fired, reason).alias("reason"),
    )


def entry_candidates(sig: DataFrame, pos: DataFrame, rule: Rule = Rule(), max_lots: int = MAX_LOTS,  # noqa: B008
                     on: Sequence[str] = ("symbol",)) -> DataFrame:
    """Names that may be bought at the next open, in budget order (priority, then symbol); none on days whose ``buy_allowed`` is false.

    ``sig``: signal_date, score, close, optionally buy_gate, priority and buy_allowed. ``pos``: shares, lots, selling, sold_now,
    flat_date, last_buy, last_buy_date (missing = never held).
    """
    chosen = _eligible(sig, pos, rule, max_lots, on).where("_allowed")
    return chosen.select(
        *_with_day(on), _optional(chosen, "priority", F.col("score")).alias("priority"), (~F.col("_open")).alias("is_new"),
        F.when(F.col("_open"), "add_after_drop").otherwise("fear").alias("reason"),
    )


def suppressed_candidates(sig: DataFrame, pos: DataFrame, rule: Rule = Rule(), max_lots: int = MAX_LOTS,  # noqa: B008
                          on: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per day, how many names would have been candidates if buying had been allowed."""
    held_back = _eligible(sig, pos, rule, max_lots, on).where("NOT _allowed")
    return held_back.groupBy("signal_date").agg(F.count(F.lit(1)).alias("suppressed"))


def _eligible(sig: DataFrame, pos: DataFrame, rule: Rule, max_lots: int, on: Sequence[str]) -> DataFrame:
    rows = sig.join(pos, list(on), "left")
    open_ = F.coalesce(F.col("shares") > HELD, F.lit(False))
    busy = F.coalesce("sold_now", F.lit(False)) | F.coalesce("selling", F.lit(False)) | (F.coalesce("lots", F.lit(0)) >= max_lots)
    low = F.col("score") <= _optional(rows, "buy_gate", F.lit(float(rule.buy_score)))
    cooling = F.col("flat_date").isNotNull() & (F.datediff("signal_date", "flat_date") < rule.reentry_days)
    dropped = F.col("close") <= F.col("last_buy") * (1 - rule.add_drop)
    rested = F.datediff("signal_date", "last_buy_date") >= rule.buy_gap_days
    eligible = F.when(open_, low & dropped & rested).otherwise(low & ~cooling)
    allowed = F.coalesce(_optional(rows, "buy_allowed", F.lit(True)), F.lit(True))
    return rows.where(~busy & F.coalesce(eligible, F.lit(False))).withColumns({"_open": open_, "_allowed": allowed})


def desk_actions(sig: DataFrame, pos: DataFrame, plan: DataFrame, rule: Rule = Rule(), on: Sequence[str] = ("symbol",)) -> DataFrame:  # noqa: B008
    """Label per symbol with its reason, and the protect price of what is held. ``sig``: score, close, covered, current (plan and data dates agree), has_plan.

    ``pos``: profit_pct, holding_days, lots, selling, last_buy_price, peak_price, exit_armed, sold_lots; ``plan``: side.
    """
    rows = sig.join(pos.withColumn("_held", F.lit(True)), list(on), "left").join(plan.select(*on, F.col("side").alias("_side")), list(on), "left")
    score, close, profit = F.col("score"), F.col("close"), F.col("profit_pct")
    hit = F.coalesce(score >= rule.sell_score, F.lit(False)) | (profit >= rule.profit_target * 100)
    armed = F.coalesce("exit_armed", F.lit(False)) | hit
    sold = F.coalesce("sold_lots", F.lit(0))
    protect = F.coalesce("peak_price", close) * (1 - rule.trailing_drop)
    if rule.exit_mode == "step_trail":
        selling = ((sold == 0) & armed) | (profit >= (rule.profit_target + STEP_PROFIT * sold) * 100)
    elif rule.exit_mode == "trail":
        selling = armed & (close <= protect)
    else:
        selling = hit
    adding = ~F.col("selling") & (F.col("lots") < MAX_LOTS) & (score <= rule.buy_score) & (close <= F.col("last_buy_price") * (1 - rule.add_drop))
    keep = F.when(armed, "hold_protected").otherwise("hold") if rule.exit_mode == "trail" else F.lit("hold")
    action = (
        F.when(~F.col("covered"), "observe")
        .when(~F.col("current"), "recompute")
        .when(F.col("_held") & (F.col("holding_days") >= rule.max_hold_days), "exit_candidate")
        .when(F.col("_held") & selling, "sell_candidate")
        .when(F.col("_held") & adding, "add_candidate")
        .when(F.col("_held"), keep)
        .when(score <= rule.buy_score, "first_buy_candidate")
        .otherwise("wait")
    )
    planned = F.when(F.col("_side") == "buy", "planned_buy").when(F.col("_side") == "sell", "planned_sell")
    final = F.when(F.col("has_plan") & F.col("covered"), F.coalesce(planned, F.when(action.endswith("_candidate"), "no_order").otherwise(action)))
    label = F.coalesce(final, action)
    reason = F.create_map(*[F.lit(x) for item in DESK_REASONS.items() for x in item])[label]
    return rows.select(*on, label.alias("action"), reason.alias("reason"), F.when(F.col("_held"), protect).alias("protect_price"))


#: what a desk label means
DESK_REASONS = {
    "observe": "not covered by the plan", "recompute": "plan and data are of different days", "exit_candidate": "held for the longest time",
    "sell_candidate": "score or profit at the target", "add_candidate": "low score well below the last buy", "hold_protected": "above the protect price",
    "hold": "nothing to do", "first_buy_candidate": "low score", "wait": "score is not low", "planned_buy": "the plan buys", "planned_sell": "the plan sells",
    "no_order": "the plan has no order for it",
}


def kickoff_candidates(sig: DataFrame, limit: float = 20) -> DataFrame:
    """Start candidates in (percentile, symbol) order; a missing percentile is reported as an error row."""
    missing = finite("percentile").isNull()
    rows = sig.where(missing | (F.col("percentile") <= limit))
    status = F.when(missing, "missing_signal").otherwise("candidate")
    return rows.withColumn("status", status).orderBy("percentile", "symbol")
