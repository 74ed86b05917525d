"""Average-cost books, positions and currency totals.

The walk through a trade list is split into scans. Held quantity is a reflected running sum (it never goes below zero):
running total minus the lowest total so far, both exact decimals and plain running aggregates. Cost is then linear in the cost
before: what a buy adds is later multiplied by the share that each sell leaves. A book's cost at the end is therefore a sum over buys of their
cost times a running product from the end, and its realized profit follows from the totals; no row is replayed. The ledger, which
shows the cost after every trade, is an associative scan over chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.joins import latest_fx, split_events
from quoteflow.operators.recursive import chunk_scan
from quoteflow.operators.timeline import CHUNK, CHUNK_ROWS, OWN, PLACEMENT, Series, as_list
from quoteflow.session import settle

BOOK_KEY = ("kind", "instrument")
QUANTITY = "decimal(38,12)"
#: quantities on the common scale; whole multipliers; money
SCALED, MULTIPLIER, MONEY = "decimal(38,6)", "decimal(22,0)", "decimal(38,12)"
#: decimal digits of a multiplier at most; one decimal less than it can hold
DIGITS = 21
#: denominators tried for a split factor: small ones, then decimals of up to nine digits
DENOMINATORS = (*range(1, 1001), *(10**k for k in range(4, 10)))


def _later_splits(splits: DataFrame, instrument: str, ts: str) -> DataFrame:
    """Per instrument: the days of its splits, latest first, the multipliers of a day by how many of them come after it, and ``_whole``, the one after all.

    A factor f is taken as the fraction n/d of the smallest fitting denominator. ``_shift`` is null where all multipliers made of these numerators and
    denominators fit. Where they do not, it is the decimal places by which plain products of factors are scaled instead, so that the largest has DIGITS
    digits."""
    factor = F.col("split_factor")
    near = lambda d: (F.abs(factor * d - F.round(factor * d)) < 1e-9 * d) & (F.round(factor * d) > 0)
    fitting = F.filter(F.array(*[F.lit(d).cast("double") for d in DENOMINATORS]), near)
    # a factor below a billionth has no such fraction and no place in exact multipliers
    d = F.coalesce(F.get(fitting, F.lit(0)), F.lit(1e9))
    event = F.struct(F.col(ts).alias("day"), F.greatest(F.round(factor * F.col("_d")), F.lit(1.0)).alias("n"), F.col("_d").alias("d"), factor.alias("f"))
    events = split_events(splits, instrument, ts).where("split_factor > 0").withColumn("_d", d)
    table = events.groupBy(instrument).agg(F.collect_list(event).alias("_splits"))  # days are unique per instrument and splits rare
    exact = F.aggregate("_splits", F.lit(0.0), lambda acc, e: acc + F.log10(F.greatest(e["n"], e["d"])))
    most = F.aggregate("_splits", F.lit(0.0), lambda acc, e: acc + F.greatest(F.log10(e["f"]), F.lit(0.0)))
    tiny = F.exists("_splits", lambda e: F.abs(e["n"] / e["d"] / e["f"] - 1) > 1e-6)
    table = table.withColumn("_shift", F.when((exact >= DIGITS) | tiny, F.floor(DIGITS - most)).cast("int"))
    one, places, plain = F.lit(1).cast(MULTIPLIER), F.pow(F.lit(10.0), F.col("_shift")), F.col("_shift").isNull()
    whole = lambda side: F.aggregate("_splits", one, lambda acc, e: (acc * F.coalesce(side(e).cast(MULTIPLIER), one)).cast(MULTIPLIER))
    scaled = lambda f: F.greatest(F.round(f), F.lit(1.0)).cast(MULTIPLIER)
    days = F.sort_array(F.transform("_splits", lambda e: e["day"]), asc=False)

    def multiplier(k: Column) -> Column:
        """The multiplier of a day that has k splits after it."""
        later = lambda e: (k == F.size("_days")) | (e["day"] > F.get("_days", k))
        product = F.aggregate("_splits", places, lambda acc, e: F.when(later(e), acc * e["f"]).otherwise(acc))
        return F.when(plain, whole(lambda e: F.when(later(e), e["n"]).otherwise(e["d"]))).otherwise(scaled(product))

    table = table.withColumn("_days", days).withColumn("_units", F.transform(F.sequence(F.lit(0), F.size("_days")), multiplier))
    return table.select(instrument, "_days", "_units", F.when(plain, whole(lambda e: e["d"])).otherwise(scaled(places)).alias("_whole"))


def held_quantities(trades: DataFrame, splits: DataFrame | None, key: Sequence[str] = BOOK_KEY, instrument: str = "instrument",
                    ts: str = "date", order: Sequence[str] = (), size: int = CHUNK_ROWS, width: int | None = 1, **totals: Column) -> Series:
    """Trades with the quantity held before and after, in units of their day, on a cut series.

    A split scales what is held on the day before trades of that day. Every quantity is multiplied by the numerators of splits still to come and
    the denominators of those that were: whole numbers, so one exact running sum serves the whole list. ``_unit`` is that multiplier. Where an
    instrument's multipliers would have over 21 digits, they are the products of its later factors instead, scaled to 21 digits and rounded to whole
    numbers: such quantities are right to 15 digits, less the orders of magnitude over six that the factors span. ``totals`` are aggregates of a chunk's trades that every row of the chunk is to carry.
    """
    keys = as_list(key)
    one = F.lit(1).cast(MULTIPLIER)
    # cut before the splits are joined: counting the rows of the chunks needs neither them nor the prices
    s = Series.cut(trades, 0, keys, ts, size, width, order)
    if splits is not None:
        rows = s.frame.join(_later_splits(splits, instrument, ts).drop("_whole"), instrument, "left")
        after = F.size(F.filter("_days", lambda day: day > F.col(ts)))
        rows = rows.withColumn("_unit", F.coalesce(F.when(F.col("_days").isNotNull(), F.get("_units", after)), one)).drop("_days", "_units")
    else:
        rows = s.frame.withColumn("_unit", one)
    scaled_quantity = (F.col("quantity").cast("decimal(18,6)") * F.col("_unit")).cast(SCALED)
    s = s.using(rows.withColumn("_signed", F.when(F.col("side") == "buy", scaled_quantity).otherwise(-scaled_quantity)))
    s = _reflected(s, totals)
    return s.add(
        held_after=_divided("_after", "_unit"), held_before=_divided("_before", "_unit"),
        oversold=(F.col("side") != "buy") & (-F.col("_signed") > F.col("_before")),
    )


def _reflected(s: Series, totals: Mapping[str, Column]) -> Series:
    """Holdings before and after each row: the running total of ``_signed`` less the lowest total so far, where that is below zero; ``_end``: those at the end of its chunk.

    Totals and lowest totals run inside the chunks; one table with a row per chunk carries both on. It is made of the same shuffled rows that it is
    joined to."""
    zero, signed = F.lit(0).cast(SCALED), F.col("_signed")
    over = lambda total, low: (total - F.least(low, total)).cast(SCALED)
    # a null quantity adds nothing; before the first known one there is no total
    onward = lambda c: F.when(F.col("_base").isNull(), F.col(c)).when(F.col(c).isNull(), F.col("_base")).otherwise((F.col("_base") + F.col(c)).cast(SCALED))
    under = F.least(F.col("_lowest"), (F.coalesce("_base", zero) + F.col("_low")).cast(SCALED))
    s = s.add(_local=F.sum(signed).over(s.window().rowsBetween(Window.unboundedPreceding, 0)).cast(SCALED))
    chunks = s.frame.groupBy(*s.parts).agg(F.sum(signed).cast(SCALED).alias("_total"), F.min("_local").alias("_low"), *[c.alias(name) for name, c in totals.items()])
    earlier = Window.partitionBy(*s.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.sum("_total").over(earlier).cast(SCALED))
    chunks = chunks.withColumn("_lowest", F.least(F.min((F.coalesce("_base", zero) + F.col("_low")).cast(SCALED)).over(earlier), zero))
    chunks = chunks.withColumn("_end", over(onward("_total"), under))
    s = s.add(_low=F.min("_local").over(s.window().rowsBetween(Window.unboundedPreceding, -1)))
    frame = s.frame.join(chunks.select(*s.parts, "_base", "_lowest", "_end", *totals), s.parts, "left").withColumns({"_sum": onward("_local"), "_under": under})
    return s.using(frame).add(_after=over(F.col("_sum"), F.col("_under")), _before=(F.col("_sum") - signed - F.col("_under")).cast(SCALED))


def _divided(scaled: str, unit: str) -> Column:
    # whole part and rest apart, so that the quotient keeps its digits
    whole = F.floor(F.col(scaled) / F.col(unit)).cast("decimal(26,0)")
    rest = (F.col(scaled) - whole * F.col(unit)).cast("decimal(30,6)")
    return (whole.cast("decimal(36,12)") + (rest.cast("double") / F.col(unit).cast("double")).cast("decimal(20,12)")).cast(QUANTITY)


def _value() -> Column:
    return (F.col("quantity") * F.col("price")).cast(MONEY)


def _money(s: Series) -> Series:
    """What a trade adds to the cost, what share of it a sell leaves, and the proceeds of sells of something held."""
    value = _value()
    buy, held = F.col("side") == "buy", F.col("_before") > 0
    left = F.col("_after").cast("double") / F.col("_before").cast("double")
    return s.add(
        _keep=F.when(~buy & held, left).otherwise(1.0), _add=F.when(buy, (value + F.col("fee")).cast(MONEY)),
        _gross=F.when(~buy & held, (value - F.col("fee")).cast(MONEY)),
    )


def average_cost_book(trades: DataFrame, splits: DataFrame | None = None, key: Sequence[str] = BOOK_KEY, instrument: str = "instrument",
                      ts: str = "date", order: Sequence[str] = (), size: int = CHUNK_ROWS, width: int | None = 1) -> DataFrame:
    """One row per book: quantity, cost, realized profit, fees, and the number of oversold sells.

    A sell takes at most what is held but its profit counts the full sell value, as recorded; ``oversold`` flags such rows.
    """
    keys = as_list(key)
    bought = F.when(F.col("side") == "buy", _value() + F.col("fee")).cast(MONEY)
    # with these, the table of chunks and the walk need the same columns, so that both are made of one shuffle
    s = held_quantities(trades, splits, key, instrument, ts, order, size, width, _added=F.sum(bought), _fees=F.sum("fee"), _n=F.count(F.lit(1)))
    s = _money(s)
    whose = [] if instrument in keys else [F.max_by(instrument, F.struct(ts, *order)).alias(instrument)]  # whose splits count
    later = s.window(reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    s = s.add(_rest=F.product("_keep").over(later))
    chunks = s.frame.groupBy(*s.parts).agg(
        *whose, F.first("_end").alias("_end"), F.product("_keep").alias("_left"),
        F.sum(F.col("_add").cast("double") * F.coalesce("_rest", F.lit(1.0))).alias("_cost"), F.first("_added").alias("_added"),
        F.sum("_gross").alias("_proceeds"), F.first("_fees").alias("_fees"), F.count_if(F.col("oversold")).alias("oversold"), F.first("_n").alias("trades"),
    )
    # what is left of a chunk's cost after all later chunks
    behind = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_rest", F.coalesce(F.product("_left").over(behind), F.lit(1.0)))
    rows = chunks.groupBy(*keys).agg(
        *[F.max_by(instrument, CHUNK).alias(instrument) for _ in whose], F.max_by(F.struct("_end"), CHUNK).alias("_end"), F.sum(F.col("_cost") * F.col("_rest")).alias("_cost"), F.sum("_added").alias("_added"),
        F.sum("_proceeds").alias("_proceeds"), F.sum("_fees").cast(chunks.schema["_fees"].dataType).alias("fees"), F.sum("oversold").alias("oversold"), F.sum("trades").alias("trades"),
    )
    # cost runs from nothing to _cost: all that was added and is not in it went into sells
    gain = F.coalesce("_proceeds", F.lit(0)) - F.coalesce("_added", F.lit(0))
    one = F.lit(1).cast(MULTIPLIER)
    whole = F.lit(None).cast(MULTIPLIER).alias("_whole")
    rows = rows.join(_later_splits(splits, instrument, ts).select(instrument, "_whole"), instrument, "left") if splits is not None else rows.select("*", whole)
    rows = rows.withColumns({"_after": F.col("_end._end"), "_whole": F.coalesce("_whole", one), "cost": F.coalesce("_cost", F.lit(0.0))})
    return rows.select(
        *keys, _divided("_after", "_whole").alias("quantity"), F.col("cost"), (gain.cast("double") + F.col("cost")).alias("realized_pnl"), "fees", "oversold", "trades",
    )


def book_ledger(trades: DataFrame, splits: DataFrame | None = None, key: Sequence[str] = BOOK_KEY, instrument: str = "instrument",
                ts: str = "date", order: Sequence[str] = (), size: int = CHUNK_ROWS, width: int | None = 1) -> DataFrame:
    """Every trade with holdings before and after (in units of its day), cost after it, and its realized profit."""
    s = _money(held_quantities(trades, splits, key, instrument, ts, order, size, width))
    kept = list(dict.fromkeys([*s.keys, *s.order, *trades.columns, "held_before", "held_after", "oversold", "_keep", "_add", "_gross"]))
    # decimals cross to Python as text: exact, and far cheaper than decimal objects
    exact = {f.name: f.dataType for f in s.frame.schema.fields if f.name in kept and isinstance(f.dataType, T.DecimalType) and f.name not in ("_add", "_gross")}
    amounts = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c == "_add" else F.col(c).cast("double") for c in ("_add", "_gross")}
    hidden = [c for c in s.frame.columns if c in (*PLACEMENT, OWN)]
    columns = [amounts[c].alias(c) if c in amounts else F.col(c).cast("string").alias(c) if c in exact else F.col(c) for c in kept]
    slim = s.using(settle(s.frame.select(*columns, *hidden)))  # read by both passes of the scan

    def step(pdf):
        keep, add = _composed(pdf["_keep"].to_numpy(dtype=float), pdf["_add"].to_numpy(dtype=float))
        return np.array([keep[-1], add[-1]])

    def combine(seed, vector):
        return np.array([vector[0] * (0.0 if seed is None else seed[0]) + vector[1]])

    def replay(pdf: pd.DataFrame, seed):
        start = 0.0 if seed is None else float(seed[0])
        keep, add = _composed(pdf["_keep"].to_numpy(dtype=float), pdf["_add"].to_numpy(dtype=float))
        after = keep * start + add
        return {"cost": after, "_cost_before": np.concatenate([[start], after[:-1]])}

    outputs = [T.StructField("cost", T.DoubleType()), T.StructField("_cost_before", T.DoubleType())]
    walked = chunk_scan(slim, step, combine, replay, outputs, ["_keep", "_add"])
    gain = F.coalesce(F.col("_gross") - F.col("_cost_before") * (1 - F.col("_keep")), F.lit(0.0))
    typed = {name: F.col(name).cast(kind) for name, kind in exact.items()}
    return walked.withColumns({"realized_pnl": gain, **typed}).drop("_keep", "_add", "_gross", "_cost_before")


def _composed(keep: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map cost -> keep * cost + add of all rows up to it, by doubling."""
    keep, add, reach = keep.copy(), add.copy(), 1
    while reach < len(keep):
        add[reach:] = add[:-reach] * keep[reach:] + add[reach:]
        keep[reach:] = keep[:-reach] * keep[reach:]
        reach *= 2
    return keep, add


def positions_view(book: DataFrame, bars: DataFrame, instrument: str = "instrument", ts: str = "date") -> DataFrame:
    """Book rows with average cost, last price, market value and unrealized profit (price 0 when there is no bar)."""
    last = bars.groupBy(instrument).agg(F.max_by("close", ts).alias("last_price"), F.max(ts).alias("latest_price_date"))
    rows = book.join(last, instrument, "left").withColumn("last_price", F.coalesce("last_price", F.lit(0.0)))
    quantity = F.col("quantity").cast("double")
    market = quantity * F.col("last_price")
    return rows.withColumns({
        "average_cost": F.when(quantity != 0, F.col("cost") / quantity).otherwise(0.0), "market_value": market,
        "unrealized_pnl": market - F.col("cost"),
    })


def portfolio_totals(positions: DataFrame, fx: DataFrame, base: str) -> DataFrame:
    """One row of totals in ``base``; currencies without a rate are left out and listed. ``positions`` has a currency column."""
    positions = settle(positions)  # one row a book, read for its currencies and for its sums
    pairs = positions.select(F.col("currency").alias("base")).distinct().withColumn("quote", F.lit(base))
    rates = latest_fx(fx, pairs).select(F.col("base").alias("currency"), "rate")
    rows = positions.join(rates, "currency", "left")
    money = ["market_value", "cost", "realized_pnl", "unrealized_pnl", "fees"]
    return rows.agg(
        *[F.sum(F.when(F.col("rate").isNotNull(), F.col(c).cast("double") * F.col("rate"))).alias(c) for c in money],
        F.sort_array(F.collect_set(F.when(F.col("rate").isNull(), F.col("currency")))).alias("missing_fx"),
    ).withColumn("base_currency", F.lit(base)).na.fill(0.0, money)


def open_quantity(book: DataFrame, **key) -> DataFrame:
    """Held quantity of one book, 0 if there is none."""
    rows = book
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.agg(F.coalesce(F.sum("quantity"), F.lit(0).cast(QUANTITY)).alias("quantity"))
