"""Threshold crossings, the three-step ladder, its stored signals and their fills."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.joins import DEFAULT_BUYS, DEFAULT_SELLS
from quoteflow.operators.recursive import chunk_scan
from quoteflow.operators.timeline import CHUNK_ROWS, Series, as_list

STEPS = 3
# Fixed value: fee rate of a paper fill.
PAPER_FEE = "0.0015"


def previous_score(df: DataFrame, key="symbol", ts: str = "date", score: str = "score", size: int = CHUNK_ROWS) -> DataFrame:
    """Add ``prev``: the score before, or the score itself on a key's first row (which then crosses nothing)."""
    s = Series.cut(df, 1, key, ts, size)
    before = s.let(F.lag(score).over(s.window()))
    return s.add(prev=F.coalesce(before, F.col(score))).done()


def levels_of(column: Column | str) -> list[Column]:
    c = F.col(column) if isinstance(column, str) else column
    return [F.element_at(c, i + 1) for i in range(STEPS)]


def crossed_down(level: Column) -> Column:
    return (F.col("prev") > level) & (level >= F.col("score"))


def crossed_up(level: Column) -> Column:
    return (F.col("prev") < level) & (level <= F.col("score"))


def crossings(sig: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS,
              key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """One row per crossed level."""
    rows = previous_score(sig.select(*as_list(key), ts, "score"), key, ts, "score", size)
    hit = lambda level, test, name: F.when(
        test(F.lit(float(level))), F.struct(F.lit(float(level)).alias("level"), F.lit(name).alias("direction"))
    )
    hits = F.array_compact(F.array(
        *[hit(level, crossed_down, "down") for level in buys], *[hit(level, crossed_up, "up") for level in sells]
    ))
    return rows.select(*as_list(key), ts, "prev", "score", F.inline(hits))


def crossing_bits(levels: Sequence[Column], test) -> Column:
    return sum((F.when(test(level), 1 << i).otherwise(0) for i, level in enumerate(levels)), F.lit(0))


def _lowest(bits: int, count: int) -> int:
    """The ``count`` lowest set bits."""
    taken = 0
    for bit in (1, 2, 4):
        if count and bits & bit:
            taken |= bit
            count -= 1
    return taken


@lru_cache(maxsize=1)
def ladder_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and step change for every (state, down bits, up bits).

    A state packs steps, fired buy levels and fired sell levels as steps * 64 + buys * 8 + sells.
    """
    nexts = np.empty((256, 8, 8), dtype=np.int64)
    deltas = np.zeros((256, 8, 8), dtype=np.int64)
    for state in range(256):
        steps, bought, sold = state >> 6, (state >> 3) & 7, state & 7
        for down in range(8):
            for up in range(8):
                buy = min((down & ~bought).bit_count(), STEPS - steps)
                sell = min((up & ~sold).bit_count(), steps)
                after = (steps, bought, sold)
                if buy > 0:
                    after, deltas[state, down, up] = (steps + buy, bought | _lowest(down & ~bought, buy), sold), buy
                elif sell > 0:
                    deltas[state, down, up] = -sell
                    after = (steps - sell, bought, sold | _lowest(up & ~sold, sell)) if sell < steps else (0, 0, 0)
                nexts[state, down, up] = after[0] * 64 + after[1] * 8 + after[2]
    return nexts, deltas


@lru_cache(maxsize=1)
def ladder_states() -> np.ndarray:
    """The states that a ladder can reach from none."""
    nexts, known = ladder_table()[0], np.zeros(1, dtype=np.int64)
    while True:
        more = np.unique(np.concatenate([known, nexts[known].ravel()]))
        if len(more) == len(known):
            return known
        known = more


def ladder_paths(down: np.ndarray, up: np.ndarray) -> np.ndarray:
    """State after each event (rows) for each state to begin with (columns), both as places in :func:`ladder_states`.

    An event is a map of states to states, and the maps of all events up to each one are composed in doubling steps."""
    states = ladder_states()
    place = np.zeros(256, dtype=np.intp)
    place[states] = np.arange(len(states))
    paths = place[ladder_table()[0][states[None, :], down[:, None], up[:, None]]]
    reach = 1
    while reach < len(paths):
        paths[reach:] = np.take_along_axis(paths[reach:], paths[:-reach], axis=1)
        reach *= 2
    return paths


def ladder_on(events: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Walk the ladder over rows with ``down``/``up`` bits; adds delta, steps, both masks and the cycle number.

    The state is one of a few values, so a chunk is summarised exactly by where it leads from each of them.
    """

    def bits(pdf):
        return pdf["down"].to_numpy(dtype=np.int64), pdf["up"].to_numpy(dtype=np.int64)

    def begun(before: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """Whether a cycle begins: a buy out of no steps."""
        return (before < 64) & (delta > 0)

    def step(pdf):
        down, up = bits(pdf)
        paths, states = ladder_paths(down, up), ladder_states()
        before = states[np.concatenate([[np.arange(len(states))], paths[:-1]])]
        entries = begun(before, ladder_table()[1][before, down[:, None], up[:, None]]).sum(axis=0)
        return np.concatenate([paths[-1], entries])

    def combine(seed, vector):
        state, cycle = (0, 0) if seed is None else (int(seed[0]), int(seed[1]))
        return np.array([vector[state], cycle + vector[len(vector) // 2 + state]])

    def replay(pdf, seed):
        down, up = bits(pdf)
        start, cycle = (0, 0) if seed is None else (int(seed[0]), int(seed[1]))
        after = ladder_states()[ladder_paths(down, up)[:, start]]
        before = np.concatenate([[ladder_states()[start]], after[:-1]])
        delta = ladder_table()[1][before, down, up]
        return {
            "delta": delta, "steps": after >> 6, "buy_mask": after >> 3 & 7, "sell_mask": after & 7, "cycle": cycle + np.cumsum(begun(before, delta)),
        }

    outputs = [T.StructField(n, T.IntegerType()) for n in ("delta", "steps", "buy_mask", "sell_mask")]
    outputs.append(T.StructField("cycle", T.LongType()))
    return chunk_scan(Series.cut(events, 0, key, ts, size), step, combine, replay, outputs, ["down", "up"])


def action_of(delta: Column, steps: Column) -> Column:
    return (
        F.when(delta > 0, F.when(steps == delta, "buy").otherwise("add"))
        .when(delta < 0, F.when(steps == 0, "exit").otherwise("reduce")).otherwise("hold")
    )


def crossing_events(df: DataFrame, buys: Sequence[Column], sells: Sequence[Column]) -> DataFrame:
    """Rows of ``df`` (with prev and score) that cross a level, with their bits; others change no state."""
    rows = df.withColumns({"down": crossing_bits(buys, crossed_down), "up": crossing_bits(sells, crossed_up)})
    return rows.where((F.col("down") > 0) | (F.col("up") > 0))


def ladder(sig: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS,
           key="symbol", ts: str = "date", size: int = CHUNK_ROWS) -> DataFrame:
    """Decisions of the ladder: one row per change of steps."""
    rows = previous_score(sig.select(*as_list(key), ts, "score"), key, ts, "score", size)
    events = crossing_events(rows, [F.lit(float(x)) for x in buys], [F.lit(float(x)) for x in sells])
    walked = ladder_on(events, key, ts, size).where("delta <> 0")
    return walked.withColumn("action", action_of(F.col("delta"), F.col("steps"))).drop("down", "up", "prev")


#: columns of a stored signal that come with the decision and are kept as they are
SIGNAL_FACTS = ("price", "drawdown", "volatility", "momentum", "underlying", "score", "confidence", "quality_status", "threshold_profile_id")


def store_signals(existing: DataFrame, new: DataFrame, key: str = "symbol", ts: str = "date", facts: Sequence[str] = SIGNAL_FACTS) -> DataFrame:
    """New signals for (key, date) pairs not stored yet; a key with a pending fill only holds, and its reason says so.

    ``new`` has delta, reason, steps, buy_mask, sell_mask (after the decision), pending_delta (before it) and the old masks, and any of ``facts``, which
    are stored with the signal. Of several new rows for one pair the smallest by its columns counts.
    """
    waiting = F.col("pending_delta") != 0
    rest = [c for c in new.columns if c not in (key, ts)]
    single = new.groupBy(key, ts).agg(F.min(F.struct(*rest)).alias("_r")).select(key, ts, "_r.*")
    fresh = single.join(existing.select(key, ts), [key, ts], "left_anti")
    return fresh.select(
        key, ts, *[c for c in facts if c in new.columns], F.when(waiting, "hold").otherwise(action_of(F.col("delta"), F.col("steps"))).alias("action"),
        F.when(waiting, 0).otherwise(F.col("delta")).alias("target_step_delta"),
        F.when(waiting, F.col("old_buy_mask")).otherwise(F.col("buy_mask")).alias("buy_mask"),
        F.when(waiting, F.col("old_sell_mask")).otherwise(F.col("sell_mask")).alias("sell_mask"),
        F.when(waiting, F.col("pending_delta")).otherwise(F.col("delta")).alias("pending_delta"),
        F.when(waiting, F.concat(F.lit("waits for a pending fill; "), F.coalesce("reason", F.lit("")))).otherwise(F.col("reason")).alias("reason"),
    )


def size_fills(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """Quantity, value and fee of pending fills at the next open, and the state after them.

    ``fills`` has delta, position_steps, held, capital, fill_price, cycle_id. Buys spend capital x delta / 3; sells take
    held x |delta| / steps; a sell without steps or holdings is void (quantity NULL, state unchanged).
    """
    money = "decimal(38,18)"
    price = F.col("fill_price").cast("decimal(18,6)")
    delta, steps, held = F.col("delta"), F.col("position_steps"), F.col("held").cast("decimal(18,6)")
    spent = (F.col("capital").cast("decimal(18,2)") * delta.cast("decimal(2,0)")).cast("decimal(24,12)") / F.lit(STEPS)
    bought = spent.cast("decimal(24,12)") / price
    sold = (held * F.abs(delta).cast("decimal(2,0)")).cast("decimal(24,12)") / steps.cast("decimal(2,0)")
    void = (delta < 0) & ((steps <= 0) | (held <= 0))
    exact = "decimal(24,12)"  # one type for both branches: widening two wide decimals would cut digits
    quantity = F.when(void, None).when(delta > 0, bought.cast(exact)).otherwise(sold.cast(exact))
    after = F.when(void, steps).otherwise(F.greatest(F.lit(0), F.least(F.lit(STEPS), steps + delta)))
    out = fills.withColumns({
        "side": F.when(delta > 0, "buy").otherwise("sell"), "quantity": quantity, "steps_after": after,
        "flat": (after == 0) & ~void, "void": void,
    })
    value = (F.col("quantity") * price).cast(money)
    return out.withColumns({
        "value": value, "fee": (value * F.lit(PAPER_FEE).cast("decimal(5,4)")).cast(money),
        "cycle_after": F.col("cycle_id") + F.col("flat").cast("int"),
    })
