"""Cleaning, verdicts, reconciliation and publication guards for bar series.

Per-series verdicts are grouped aggregates (partial aggregation handles a hot key); duplicates are resolved with
``max_by``/``min_by`` so that a heavily repeated (key, date) never has to be sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import series as fs
from quoteflow.functions.scalars import finite
from quoteflow.operators.timeline import Series, as_list, last_rows

PRICES = ("open", "high", "low", "close", "adjusted_close")
# Verdict limits.
JUMP_LIMIT = 0.8
STALE_WARN, STALE_BLOCK = 5, 10
OK, WARNING, BLOCKED = "ok", "warning", "blocked"


def _pick(df: DataFrame, keys: Sequence[str], chooser, order: Column) -> DataFrame:
    """One row per ``keys``: the one ``chooser`` (max_by/min_by) selects by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), order).alias("_row"))
    return chosen.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def clean_bars(b: DataFrame, order_col: str, key="symbol", ts: str = "date") -> DataFrame:
    """Numeric coercion, defaults for volume and split, last row per date in input order, infinities to NULL."""
    keys = as_list(key)
    numbers = [*PRICES, "volume", "split_factor"]
    cast = {c: F.expr(f"try_cast({c} AS double)") for c in numbers}
    rows = b.withColumns(cast).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    rows = rows.na.drop(subset=list(PRICES))
    rows = rows.withColumns({
        "volume": F.coalesce("volume", F.lit(0.0)), "split_factor": F.coalesce("split_factor", F.lit(1.0)),
    })
    rows = _pick(rows, [*keys, ts], F.max_by, F.col(order_col))
    return rows.withColumns({c: finite(c) for c in numbers}).where(F.col("close").isNotNull())


def invalid_ohlc() -> Column:
    positive = [F.col(c) <= 0 for c in PRICES]
    bad = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    for p in positive:
        bad = bad | p
    return F.coalesce(bad, F.lit(False))


def series_verdict(b: DataFrame, expected_end: Column | None = None, key="symbol", ts: str = "date",
                   symbols: DataFrame | None = None) -> DataFrame:
    """Per key: invalid bars, jumps beyond 80 %, staleness, status and messages. Keys without bars are blocked."""
    keys = as_list(key)
    s = Series.cut(b, 1, keys, ts)
    s = s.add(_jump=F.abs(fs.change(s, "adjusted_close")) > JUMP_LIMIT, _bad=invalid_ohlc())
    table = s.done().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("_bad").alias("invalid_bars"), F.count_if("_jump").alias("jumps"),
        F.max(ts).alias("last_date"),
    )
    if symbols is not None:
        table = symbols.select(*keys).distinct().join(table, keys, "left").na.fill(0, ["bars", "invalid_bars", "jumps"])
    age = F.datediff(expected_end, "last_date") if expected_end is not None else F.lit(0)
    empty = F.col("bars") == 0
    messages = F.array_compact(F.array(
        F.when(empty, "no bars"),
        F.when(F.col("invalid_bars") > 0, F.concat(F.col("invalid_bars"), F.lit(" invalid bars"))),
        F.when(F.col("jumps") > 0, "adjusted move above 80 percent"),
        F.when(age > STALE_WARN, F.concat(F.lit("last bar "), F.col("last_date"))),
    ))
    status = (
        F.when(empty | (F.col("invalid_bars") > 0) | (age > STALE_BLOCK), BLOCKED)
        .when(F.size(messages) > 0, WARNING).otherwise(OK)
    )
    return table.withColumns({"status": status, "messages": messages})


def two_source_verdict(a: DataFrame, b: DataFrame, last: int = 60, min_overlap: int = 15, min_corr: float = 0.95,
                       key="symbol", ts: str = "date") -> DataFrame:
    """Correlation of daily returns over the last common rows; too few is a warning, too low blocks."""
    keys = as_list(key)
    both = a.select(*keys, ts, F.col("adjusted_close").alias("_a")).join(
        b.select(*keys, ts, F.col("adjusted_close").alias("_b")), [*keys, ts]
    )
    recent = last_rows(both, last, keys, ts)
    w = Window.partitionBy(*keys).orderBy(ts)  # at most ``last`` rows per key
    moves = recent.withColumns({"_ra": F.col("_a") / F.lag("_a").over(w) - 1, "_rb": F.col("_b") / F.lag("_b").over(w) - 1})
    stats = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("overlap"), finite(F.corr("_ra", "_rb")).alias("correlation"))
    table = a.select(*keys).distinct().join(stats, keys, "left").na.fill(0, ["overlap"])
    status = (
        F.when(F.col("overlap") < min_overlap, WARNING)
        .when(F.col("correlation").isNull() | (F.col("correlation") < min_corr), BLOCKED).otherwise(OK)
    )
    message = F.when(F.col("overlap") < min_overlap, "too few common days").when(status == BLOCKED, "sources disagree")
    return table.withColumns({"status": status, "message": message})


def choose_source(verdicts: DataFrame) -> DataFrame:
    """Decide source and status from per-key verdicts.

    Input columns: primary_status and fallback_status (NULL = not available), comparison_status, comparison_message, and optionally
    primary_messages and fallback_messages (arrays). ``messages`` are those of the chosen source followed by what the choice adds.
    """
    primary, fallback, compare = F.col("primary_status"), F.col("fallback_status"), F.col("comparison_status")
    softened = lambda status: F.when(status == OK, WARNING).otherwise(status)
    source = F.when(primary.isNotNull(), "primary").when(fallback.isNotNull(), "fallback")
    status = (
        F.when(primary.isNull() & fallback.isNull(), "error")
        .when(primary.isNull(), softened(fallback))
        .when(fallback.isNull(), softened(primary))
        .when(compare == BLOCKED, BLOCKED)
        .otherwise(primary)
    )
    note = (
        F.when(primary.isNull() & fallback.isNotNull(), "fallback used without a second source")
        .when(primary.isNotNull() & fallback.isNull(), "single source only")
        .otherwise(F.col("comparison_message"))
    )
    given = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in verdicts.columns else F.array().cast("array<string>")
    own = F.when(primary.isNotNull(), given("primary_messages")).otherwise(given("fallback_messages"))
    messages = F.array_compact(F.concat(own, F.array(note)))
    return verdicts.withColumns({"source": source, "status": status, "messages": messages})


def _priority(column: Column, priority: Mapping[str, int], other: int) -> Column:
    pairs = [F.lit(x) for item in priority.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(other))


def freshest_source(b: DataFrame, expected: Column, priority: Sequence[str], key="symbol", ts: str = "date") -> DataFrame:
    """Best source per key that has the expected session (``source`` NULL and status error when none has)."""
    keys = as_list(key)
    rank = _priority(F.col("source"), {name: i for i, name in enumerate(priority)}, len(priority))
    has = b.groupBy(*keys, "source").agg(F.bool_or(F.col(ts) == expected).alias("_has"))
    best = has.groupBy(*keys).agg(F.min(F.when(F.col("_has"), F.struct(rank.alias("p"), F.col("source")))).alias("_best"))
    return best.select(*keys, F.col("_best")["source"].alias("source"),
                       F.when(F.col("_best").isNull(), "error").otherwise(OK).alias("status"))


SOURCE_PRIORITY = {"yahoo": 0, "stooq": 1}


def prefer_source(b: DataFrame, priority: Mapping[str, int] = SOURCE_PRIORITY, key="symbol", ts: str = "date", id_col: str = "id") -> DataFrame:
    """One bar per (key, date): preferred source first, then the lowest id."""
    keys = as_list(key)
    rank = _priority(F.col("source"), priority, max(priority.values()) + 1)
    return _pick(b, [*keys, ts], F.min_by, F.struct(rank, F.col(id_col)))


def strict_gate(b: DataFrame, key="symbol", ts: str = "date") -> DataFrame:
    """Per key the number of rows that break the gate; a single one blocks the key."""
    keys = as_list(key)
    numbers = [*PRICES, "volume"]
    usable = F.lit(True)
    for c in numbers:
        usable = usable & F.coalesce((finite(c) > 0), F.lit(False))
    ordered = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    dated = F.col(ts).isNotNull()
    days = b.groupBy(*keys, ts).agg(
        F.count_if(~(usable & F.coalesce(ordered, F.lit(False)) & dated)).alias("_bad"), F.count(F.lit(1)).alias("_n")
    )
    return days.groupBy(*keys).agg(
        F.sum("_bad").alias("bad_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows")
    ).withColumn("blocked", (F.col("bad_rows") > 0) | (F.col("duplicate_rows") > 0))


def passing(b: DataFrame, gate: DataFrame, key="symbol") -> DataFrame:
    return b.join(gate.where(~F.col("blocked")), as_list(key), "left_semi")


def missing_sessions(b: DataFrame, calendar: DataFrame, start: Column | None = None, end: Column | None = None,
                     key="symbol", ts: str = "date", session: str = "session") -> DataFrame:
    """Calendar sessions inside a key's own range (or the given one) without a bar."""
    keys = as_list(key)
    span = b.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    low = start if start is not None else F.col("_lo")
    high = end if end is not None else F.col("_hi")
    span = span.where(low <= high)
    days = span.select(*keys, F.explode(F.sequence(low, high)).alias(ts))
    expected = days.join(calendar.select(F.col(session).alias(ts)).distinct(), ts, "left_semi")
    return expected.join(b.select(*keys, ts), [*keys, ts], "left_anti")


def overlap_factor(base: DataFrame, fresh: DataFrame, start, end, key="symbol", ts: str = "date", min_days: int = 5,
                   raw_limit: float = 0.002, factor_range=(0.95, 1.05), ratio_limit: float = 1e-4) -> DataFrame:
    """Per key: common days in [start, end], worst raw-close error, median adjusted ratio and its worst deviation.

    The median is exact; its group is bounded by the days of the overlap.
    """
    keys = as_list(key)
    old = base.select(*keys, ts, F.col("close").alias("_c0"), F.col("adjusted_close").alias("_a0"))
    new = fresh.select(*keys, ts, F.col("close").alias("_c1"), F.col("adjusted_close").alias("_a1"))
    inside = F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    both = old.where(inside).join(new.where(inside), [*keys, ts]).withColumn("_ratio", F.col("_a1") / F.col("_a0"))
    first = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.max(F.abs(F.col("_c1") / F.col("_c0") - 1)).alias("raw_error"),
        F.median("_ratio").alias("factor"),
    )
    spread = both.join(first, keys).groupBy(*keys).agg(F.max(F.abs(F.col("_ratio") / F.col("factor") - 1)).alias("ratio_error"))
    low, high = factor_range
    stable = (
        (F.col("days") >= min_days) & (F.col("raw_error") <= raw_limit) & F.col("factor").between(low, high)
        & (F.col("ratio_error") <= ratio_limit)
    )
    return base.select(*keys).distinct().join(first.join(spread, keys), keys, "left").na.fill(0, ["days"]).withColumn(
        "stable", F.coalesce(stable, F.lit(False))
    )


def newer_rows(base: DataFrame, fresh: DataFrame, through, key="symbol", ts: str = "date") -> DataFrame:
    """Rows of ``fresh`` strictly after each key's last base row and not after ``through``."""
    keys = as_list(key)
    last = base.groupBy(*keys).agg(F.max(ts).alias("_end"))
    inside = (F.col(ts) > F.col("_end")) & (F.col(ts) <= F.lit(through).cast("date"))
    return fresh.join(last, keys).where(inside).drop("_end")


def rebase(base: DataFrame, fresh: DataFrame, factor: DataFrame, through, key="symbol", ts: str = "date") -> DataFrame:
    """Newer rows with adjusted prices divided by the key's overlap factor."""
    keys = as_list(key)
    joined = newer_rows(base, fresh, through, keys, ts).join(factor.select(*keys, F.col("factor").alias("_f")), keys)
    return joined.withColumn("adjusted_close", F.col("adjusted_close") / F.col("_f")).select(*base.columns)


def append_rebased(base: DataFrame, fresh: DataFrame, factor: DataFrame, calendar: DataFrame, through,
                   key="symbol", ts: str = "date") -> tuple[DataFrame, DataFrame]:
    """Strictly newer rows divided by the factor and appended for the keys that pass every check.

    Returns (combined bars, audit): the audit has new_rows, missing sessions, both verdicts and ``accepted``.
    """
    keys = as_list(key)
    last = base.groupBy(*keys).agg(F.max(ts).alias("_end"))
    limit = F.lit(through).cast("date")
    extra = newer_rows(base, fresh, through, keys, ts)
    rebased = rebase(base, fresh, factor, through, keys, ts)
    anchor = base.join(last, keys).where(F.col(ts) == F.col("_end")).drop("_end")
    own = series_verdict(extra, key=keys, ts=ts).select(*keys, F.col("status").alias("new_status"))
    bridge = series_verdict(anchor.unionByName(rebased), key=keys, ts=ts).select(*keys, F.col("status").alias("bridge_status"))
    span = last.where(F.col("_end") < limit).select(*keys, F.explode(F.sequence(F.date_add("_end", 1), limit)).alias(ts))
    due = span.join(calendar.select(F.col("session").alias(ts)).distinct(), ts, "left_semi")
    missing = due.join(extra, [*keys, ts], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    counts = extra.groupBy(*keys).agg(F.count(F.lit(1)).alias("new_rows"), F.count_if(F.col("volume") <= 0).alias("empty_volume"))
    audit = factor.join(counts, keys, "left").join(own, keys, "left").join(bridge, keys, "left").join(missing, keys, "left")
    audit = audit.na.fill(0, ["new_rows", "empty_volume", "missing"])
    accepted = (
        F.col("stable") & (F.col("new_rows") > 0) & (F.col("empty_volume") == 0) & (F.col("missing") == 0)
        & (F.col("new_status") == OK) & (F.col("bridge_status") == OK)
    )
    audit = audit.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    combined = base.unionByName(rebased.join(audit.where("accepted"), keys, "left_semi"))
    return combined, audit


def prefix_equal(old: DataFrame, new: DataFrame, columns: Sequence[str], tol: float = 1e-8, key="symbol", ts: str = "date") -> DataFrame:
    """Per key: dates only one side has, null mismatches, worst deviation, and whether the prefix is unchanged."""
    keys = as_list(key)
    left = old.select(*keys, ts, F.lit(True).alias("_in_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    right = new.select(*keys, ts, F.lit(True).alias("_in_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = left.join(right, [*keys, ts], "full_outer")
    paired = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    nulls = sum((F.col(f"_o_{c}").isNull() != F.col(f"_n_{c}").isNull()).cast("int") for c in columns)
    deviation = F.array_max(F.array(*[F.abs(F.col(f"_o_{c}") - F.col(f"_n_{c}")) for c in columns]))
    table = both.groupBy(*keys).agg(
        F.count_if(F.col("_in_new").isNull()).alias("only_old"), F.count_if(F.col("_in_old").isNull()).alias("only_new"),
        F.sum(F.when(paired, nulls).otherwise(0)).alias("null_mismatches"), F.max(deviation).alias("max_deviation"),
    )
    same = (F.col("only_old") == 0) & (F.col("only_new") == 0) & (F.col("null_mismatches") == 0) & (F.col("max_deviation") <= tol)
    return table.withColumn("unchanged", F.coalesce(same, F.lit(False)))


def drift_guard(old: DataFrame, new: DataFrame, relative: Mapping[str, float], absolute: Mapping[str, float],
                key="symbol", ts: str = "date") -> DataFrame:
    """Per key the worst error on common dates against per-column limits (relative and absolute). A column that is null on all of them in ``old`` has
    nothing to drift from and is within its limit."""
    keys = as_list(key)
    columns = [*relative, *absolute]
    both = old.select(*keys, ts, *[F.col(c).alias(f"_o_{c}") for c in columns]).join(
        new.select(*keys, ts, *[F.col(c).alias(f"_n_{c}") for c in columns]), [*keys, ts]
    )
    errors = {c: F.abs(F.col(f"_n_{c}") / F.nullif(F.col(f"_o_{c}"), F.lit(0.0)) - 1) for c in relative}
    errors |= {c: F.abs(F.col(f"_n_{c}") - F.col(f"_o_{c}")) for c in absolute}
    table = both.groupBy(*keys).agg(*[F.max(e).alias(f"{c}_error") for c, e in errors.items()], *[F.count(f"_o_{c}").alias(f"_known_{c}") for c in errors])
    within = F.lit(True)
    for c, limit in {**relative, **absolute}.items():
        within = within & F.coalesce(F.col(f"{c}_error") <= limit, F.col(f"_known_{c}") == 0)
    return table.withColumn("within_limits", within).drop(*[f"_known_{c}" for c in errors])


def anchor_continuity(published: DataFrame, fresh: DataFrame, frozen, key="symbol", ts: str = "date") -> DataFrame:
    """Join new adjusted prices to the published series without a spurious return.

    Rows after a key's last published date are scaled by published close / new value on that date; rows published
    after ``frozen`` take the published close. ``continuity`` is NULL (key blocked) when the anchor day is missing.
    """
    keys = as_list(key)
    last = published.groupBy(*keys).agg(F.max(ts).alias("_end"), F.max_by("close", ts).alias("_close"))
    anchor = fresh.join(last, keys).where(F.col(ts) == F.col("_end")).select(*keys, F.col("adjusted_close").alias("_at"))
    scale = last.join(anchor, keys, "left").withColumn("continuity", F.col("_close") / F.nullif(F.col("_at"), F.lit(0.0)))
    rows = fresh.join(scale.select(*keys, "_end", "continuity"), keys)
    old = published.select(*keys, ts, F.col("close").alias("_published"), F.lit(True).alias("_was"))
    rows = rows.join(old, [*keys, ts], "left")
    value = (
        F.when(F.col(ts) > F.col("_end"), F.col("adjusted_close") * F.col("continuity"))
        .when(F.col("_was") & (F.col(ts) > F.lit(frozen).cast("date")), F.col("_published"))
        .otherwise(F.col("adjusted_close"))
    )
    return rows.withColumn("adjusted_close", value).drop("_end", "_published", "_was")


def preserve_published(old: DataFrame, new: DataFrame, columns: Sequence[str], key="symbol", ts: str = "date") -> DataFrame:
    """On dates already published the old values win, even where they are NULL."""
    keys = as_list(key)
    kept = old.select(*keys, ts, F.lit(True).alias("_was"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = new.join(kept, [*keys, ts], "left")
    return joined.withColumns({
        c: F.when(F.col("_was"), F.col(f"_o_{c}")).otherwise(F.col(c)) for c in columns
    }).drop("_was", *[f"_o_{c}" for c in columns])


def common_frontier(b: DataFrame, calendar: DataFrame, after, key: str = "symbol", ts: str = "date", session: str = "session") -> DataFrame:
    """One row: the last session after ``after`` up to which every key has every session (NULL when none)."""
    start = F.lit(after).cast("date")
    have = b.where(F.col(ts) > start).groupBy(ts).agg(F.count_distinct(key).alias("_n"))
    total = b.agg(F.count_distinct(key).alias("_all"))
    days = calendar.select(F.col(session).alias(ts)).distinct().where(F.col(ts) > start).join(have, ts, "left")
    days = days.join(F.broadcast(total))  # a single row
    complete = F.coalesce(F.col("_n"), F.lit(0)) == F.col("_all")
    first_gap = days.agg(F.min(F.when(~complete, F.col(ts))).alias("_gap"))
    good = days.join(F.broadcast(first_gap)).where(F.col("_gap").isNull() | (F.col(ts) < F.col("_gap")))
    return good.agg(F.max(ts).alias("frontier"))


def missing_symbols(b: DataFrame, day: Column, symbols: DataFrame, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Symbols without a bar on the session."""
    return symbols.select(key).distinct().join(b.where(F.col(ts) == day), key, "left_anti")


def observation_status(df: DataFrame) -> DataFrame:
    """Ordered status from per-key facts.

    Input: bars, missing_sessions, worst_quality, gate_blocked, latest_score, last_date, expected_date.
    """
    status = (
        F.when(F.coalesce("bars", F.lit(0)) == 0, "missing")
        .when(F.col("expected_date").isNull(), BLOCKED)
        .when((F.coalesce("missing_sessions", F.lit(0)) > 0) | (F.col("worst_quality") == BLOCKED), BLOCKED)
        .when(F.coalesce("gate_blocked", F.lit(False)), BLOCKED)
        .when(finite("latest_score").isNull(), "insufficient")
        .when(F.col("last_date") < F.col("expected_date"), "stale")
        .when(F.col("worst_quality") == WARNING, WARNING)
        .otherwise(OK)
    )
    return df.withColumn("status", status)


FACTORS = ("market_position", "etf_position", "volatility", "trend", "score")


def blocked_signal(signals: DataFrame, blocked: DataFrame, key="symbol", ts: str = "date") -> DataFrame:
    """Signal rows for blocked keys: the newest stored factors repeated, or 0 when there is none.

    ``blocked`` has key, ts, price and reason.
    """
    keys = as_list(key)
    newest = signals.groupBy(*keys).agg(F.max_by(F.struct(*FACTORS), ts).alias("_f"))
    joined = blocked.join(newest, keys, "left")
    return joined.select(
        *keys, ts, "price", *[F.coalesce(F.col("_f")[c], F.lit(0.0)).alias(c) for c in FACTORS],
        F.lit("data_blocked").alias("action"), F.lit(0).alias("target_step_delta"), F.lit("blocked").alias("confidence"),
        F.lit(BLOCKED).alias("quality_status"), "reason",
    )


def panel_price_check(b: DataFrame, dates: DataFrame, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Per key the chosen dates without a positive open and close (missing rows count)."""
    days = dates.select(ts).distinct()
    wanted = days.agg(F.count(F.lit(1)).alias("_days"))
    good = b.join(days, ts, "left_semi").where((F.col("open") > 0) & (F.col("close") > 0))
    table = b.select(key).distinct().join(good.groupBy(key).agg(F.count_distinct(ts).alias("_good")), key, "left")
    table = table.join(F.broadcast(wanted))  # a single row
    bad = F.col("_days") - F.coalesce("_good", F.lit(0))
    return table.select(key, bad.alias("bad_days"), (bad == 0).alias("valid"))
