"""Alignment, lookup, range and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.timeline import CHUNK_ROWS, Series, as_list, running

# Default ladder thresholds used while a key has no profile.
DEFAULT_BUYS = (-60.0, -75.0, -90.0)
DEFAULT_SELLS = (60.0, 75.0, 90.0)


def align_ffill(bars: DataFrame, other: DataFrame, limit: int = 3, column: str = "adjusted_close",
                out: str = "other_close", key="symbol", ts: str = "date", size: int = CHUNK_ROWS, halo: int = 0) -> Series:
    """Put ``other.column`` on the dates of ``bars`` and fill gaps of at most ``limit`` of *those* rows.

    Returns the cut series (``halo`` rows beyond the fill) so that a caller can go on with windows.
    """
    keys = as_list(key)
    side = other.select(*keys, ts, F.col(column).alias("_other"))
    s = Series.cut(bars.join(side, [*keys, ts], "left"), halo + limit, keys, ts, size)
    filled = F.last("_other", ignorenulls=True).over(s.rows(-limit, 0))
    s = s.add(**{out: filled})
    return s.using(s.frame.drop("_other"))


def overlap(a: DataFrame, b: DataFrame, columns: Sequence[str], suffixes=("_a", "_b"), on=("symbol", "date")) -> DataFrame:
    """Rows both sources have, the named columns side by side."""
    left = a.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = b.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return left.join(right, list(on))


def common_dates(bars: DataFrame, symbols: Sequence[str], start=None, end=None, warmup: bool = True,
                 key: str = "symbol", ts: str = "date") -> DataFrame:
    """Dates every chosen symbol has, plus the last common date before ``start`` (``is_warmup``)."""
    wanted = list(dict.fromkeys(symbols))
    days = (
        bars.where(F.col(key).isin(wanted)).groupBy(ts).agg(F.count_distinct(key).alias("_n"))
        .where(F.col("_n") == len(wanted)).select(ts)
    )
    if end is not None:
        days = days.where(F.col(ts) <= F.lit(end).cast("date"))
    if start is None:
        return days.withColumn("is_warmup", F.lit(False))
    first = F.lit(start).cast("date")
    inside = days.where(F.col(ts) >= first).withColumn("is_warmup", F.lit(False))
    if not warmup:
        return inside
    earlier = days.where(F.col(ts) < first).agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    return inside.unionByName(earlier.withColumn("is_warmup", F.lit(True)))


def latest(df: DataFrame, by: Sequence[str], key="symbol") -> DataFrame:
    """Newest row per key by the given order columns (partial aggregation, no window)."""
    keys = as_list(key)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def latest_board(instruments: DataFrame, signals: DataFrame, profiles: DataFrame, states: DataFrame,
                 key: str = "symbol") -> DataFrame:
    """Every enabled instrument with its newest signal, newest active profile (or defaults) and paper state."""
    newest = latest(signals, ["date"], key)
    active = latest(profiles.where("active"), ["created_at"], key).select(
        key, F.array("buy_1", "buy_2", "buy_3").alias("_b"), F.array("sell_1", "sell_2", "sell_3").alias("_s"),
        "confidence", "method",
    )
    board = instruments.where("enabled").join(newest, key, "left").join(active, key, "left").join(
        states.select(key, "position_steps", "pending_delta"), key, "left"
    )
    return board.withColumns({
        "buys": F.coalesce("_b", F.array(*map(F.lit, DEFAULT_BUYS))),
        "sells": F.coalesce("_s", F.array(*map(F.lit, DEFAULT_SELLS))),
        "confidence": F.coalesce("confidence", F.lit("low")),
        "method": F.coalesce("method", F.lit("fallback")),
        "position_steps": F.coalesce("position_steps", F.lit(0)),
        "pending_delta": F.coalesce("pending_delta", F.lit(0)),
    }).drop("_b", "_s")


def latest_fx(fx: DataFrame, pairs: DataFrame) -> DataFrame:
    """Newest rate per wanted (base, quote): direct, else 1 / inverse, 1 for the same currency, else NULL."""
    newest = fx.groupBy("base", "quote").agg(F.max_by("rate", "date").alias("_rate"))
    direct = newest.withColumnRenamed("_rate", "_direct")
    inverse = newest.select(F.col("quote").alias("base"), F.col("base").alias("quote"), F.col("_rate").alias("_inverse"))
    joined = pairs.join(direct, ["base", "quote"], "left").join(inverse, ["base", "quote"], "left")
    rate = (
        F.when(F.col("base") == F.col("quote"), F.lit(1.0))
        .when(F.col("_direct").isNotNull(), F.col("_direct"))
        .otherwise(1 / F.nullif(F.col("_inverse"), F.lit(0.0)))
    )
    return joined.withColumn("rate", rate).drop("_direct", "_inverse")


def split_events(bars: DataFrame, key: str = "instrument", ts: str = "date") -> DataFrame:
    """One split factor per (instrument, date), whichever sources reported it."""
    return bars.where("split_factor <> 1").groupBy(key, ts).agg(F.max("split_factor").alias("split_factor"))


def split_product(df: DataFrame, bars: DataFrame, start: str, end: str, out: str = "split_product",
                  key: str = "instrument", ts: str = "date") -> DataFrame:
    """Product of the factors with start < date <= end (NULL start = unbounded).

    The dates per instrument are unique and rare, so they travel as one array per instrument.
    """
    events = split_events(bars, key, ts).groupBy(key).agg(
        F.collect_list(F.struct(F.col(ts).alias("d"), F.col("split_factor").alias("f"))).alias("_splits")
    )
    inside = F.filter("_splits", lambda e: (F.col(start).isNull() | (e["d"] > F.col(start))) & (e["d"] <= F.col(end)))
    factor = F.aggregate(inside, F.lit(1.0), lambda acc, e: acc * e["f"])
    return df.join(events, key, "left").withColumn(out, F.coalesce(factor, F.lit(1.0))).drop("_splits")


def _session_walk(df: DataFrame, calendar: DataFrame, ts: str, session: str) -> DataFrame:
    """Distinct days of ``df`` and of the calendar: at most one row per calendar day, whatever ``df`` holds."""
    days = df.select(F.col(ts).alias("_day")).where(F.col(ts).isNotNull()).distinct().withColumn("_wanted", F.lit(True))
    sessions = calendar.select(F.col(session).alias("_day"), F.col(session).alias("_session")).distinct()
    return days.join(sessions, "_day", "full_outer").withColumn("_n", F.unix_date("_day"))


def next_session(df: DataFrame, calendar: DataFrame, ts: str = "date", out: str = "next_session",
                 session: str = "session") -> DataFrame:
    """First session strictly after each row's day."""
    after = Window.orderBy(F.col("_n").desc()).rangeBetween(Window.unboundedPreceding, -1)
    found = _session_walk(df, calendar, ts, session).withColumn(out, F.min("_session").over(after)).where("_wanted")
    return df.join(found.select("_day", out), F.col(ts) == F.col("_day"), "left").drop("_day")


def previous_session(df: DataFrame, calendar: DataFrame, ts: str = "date", out: str = "last_session",
                     session: str = "session") -> DataFrame:
    """Last session on or before each row's day."""
    upto = Window.orderBy("_n").rangeBetween(Window.unboundedPreceding, 0)
    found = _session_walk(df, calendar, ts, session).withColumn(out, F.max("_session").over(upto)).where("_wanted")
    return df.join(found.select("_day", out), F.col(ts) == F.col("_day"), "left").drop("_day")


def last_session(df: DataFrame, calendar: DataFrame, moment: str, zone: str = "America/New_York", cutoff: str = "16:30",
                 out: str = "last_session", session: str = "session") -> DataFrame:
    """Last completed session at a UTC instant: today counts from the local ``cutoff`` on."""
    local = F.from_utc_timestamp(F.col(moment), zone)
    candidate = F.when(F.date_format(local, "HH:mm") >= cutoff, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return previous_session(df.withColumn("_candidate", candidate), calendar, "_candidate", out, session).drop("_candidate")


def next_open_fill(signals: DataFrame, bars: DataFrame, key="symbol", ts: str = "date", price: str = "open",
                   size: int = CHUNK_ROWS) -> DataFrame:
    """Pair each decision with the key's next bar: its date and price (NULL when there is none yet)."""
    keys = as_list(key)
    s = Series.cut(bars, 0, keys, ts, size, ahead=1)
    s = s.add(fill_date=F.lead(ts).over(s.window()), fill_price=F.lead(price).over(s.window()))
    ahead = s.done().select(*keys, ts, "fill_date", "fill_price")
    return signals.join(ahead, [*keys, ts], "left")


def unmatched_fills(fills: DataFrame, intents: DataFrame, calendar: DataFrame, ts: str = "date",
                    session: str = "session") -> DataFrame:
    """Fills whose (symbol, side) was not among the intents of the previous session."""
    due = next_session(intents, calendar, ts, "_due", session)
    wanted = due.select(
        F.col("_due").alias(ts), "symbol", F.when(F.col("side") == "buy_candidate", "buy").otherwise("sell").alias("side")
    )
    return fills.join(wanted, [ts, "symbol", "side"], "left_anti")


def with_instrument(df: DataFrame, instruments: DataFrame, key: str = "symbol") -> DataFrame:
    """Look up the dimension; ``known`` is false for an unknown symbol. Spark broadcasts it when it is small."""
    dim = instruments.withColumn("known", F.lit(True))
    return df.join(dim, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def restrict(bars: DataFrame, symbols: DataFrame | None = None, dates: DataFrame | None = None,
             key: str = "symbol", ts: str = "date") -> DataFrame:
    """Only chosen symbols and dates."""
    if symbols is not None:
        bars = bars.join(symbols.select(key), key, "left_semi")
    if dates is not None:
        bars = bars.join(dates.select(ts), ts, "left_semi")
    return bars


def as_of(left: DataFrame, right: DataFrame, columns: Sequence[str], key="symbol", ts: str = "ts", strict: bool = False, tolerance: float | None = None,
          order: Sequence[str] = (), out: str = "matched", size: int = CHUNK_ROWS, width: int | None = None) -> DataFrame:
    """Add ``out``, a struct of ``ts`` and ``columns`` of the last right row of the key at or before (``strict``: before) each left row; null if there is none.

    ``ts`` may be dates, instants or numbers, alike on both sides; ``tolerance`` is the largest distance in days, seconds or units. Of right rows with
    one ``ts`` the last by ``order`` counts. Both sides become one series cut into chunks, and the last right row is carried from chunk to chunk, so a key
    that holds most rows is many tasks. Left rows without key or ``ts`` match nothing.
    """
    keys = as_list(key)
    found = F.struct(F.col(ts), *[F.col(c) for c in columns])
    kind = F.lit(0 if strict else 1)  # at one instant, right rows come after or before left ones
    ties = [f"_o{i}" for i in range(len(order))]
    known = left.where(F.col(ts).isNotNull() & reduce(and_, [F.col(k).isNotNull() for k in keys]))
    rest = left.where(F.col(ts).isNull() | reduce(or_, [F.col(k).isNull() for k in keys]))
    mine = known.select(*keys, ts, kind.alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(t) for c, t in zip(order, ties)], F.lit(None).cast(
        right.select(found.alias("f")).schema["f"].dataType).alias("_found"), F.struct(*left.columns).alias("_left"))
    theirs = right.where(F.col(ts).isNotNull()).select(*keys, ts, (1 - kind).alias("_side"), *[F.col(c).alias(t) for c, t in zip(order, ties)], found.alias("_found"), F.lit(None).cast(
        left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"))
    both = running(mine.unionByName(theirs), keys, ts, size, width, ["_side", *ties], _last=("last", F.col("_found")))
    rows = both.where(F.col("_left").isNotNull()).select("_left.*", F.col("_last").alias(out))
    if tolerance is not None:
        rows = rows.withColumn(out, F.when(_distance(left, ts, F.col(ts), F.col(out)[ts]) <= tolerance, F.col(out)))
    return rows.unionByName(rest.withColumn(out, F.lit(None).cast(rows.schema[out].dataType)))


def _distance(df: DataFrame, ts: str, later: Column, earlier: Column) -> Column:
    """Days, seconds or units between two values of the kind of ``ts``."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.DateType):
        return F.datediff(later, earlier)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000
    return later - earlier
