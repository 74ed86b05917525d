"""Per-symbol observation of the five-component score, and history views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators import quality as qc
from quoteflow.operators.joins import DEFAULT_BUYS, DEFAULT_SELLS
from quoteflow.operators.metrics import threshold_distribution
from quoteflow.operators.signals import ladder
from quoteflow.operators.timeline import last_rows
from quoteflow.plans.scores import FIVE_COMPONENT_WEIGHTS, five_component_score
from quoteflow.session import settle

POINTS = 756


def scored_bars(bars: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Five-component scores of the symbols that pass the strict gate."""
    gate = qc.strict_gate(bars) if gate is None else gate
    return five_component_score(qc.passing(bars, gate))


def observation(bars: DataFrame, calendar: DataFrame, expected) -> tuple[DataFrame, DataFrame]:
    """(one row per symbol with status, latest score and components; the last points).

    ``bars`` may hold several sources (columns source, id, quality_status); ``expected`` is the last closed session: a column, or a
    one-row table with expected_date.
    """
    last = expected if isinstance(expected, DataFrame) else bars.sparkSession.range(1).select(expected.cast("date").alias("expected_date"))
    chosen = qc.prefer_source(bars) if "source" in bars.columns else bars
    chosen = chosen.join(F.broadcast(last), F.col("date") <= F.col("expected_date")).drop("expected_date")  # a single row
    worst = {"blocked": 2, "warning": 1, "ok": 0}
    level = F.create_map(*[F.lit(x) for item in worst.items() for x in item])
    quality = F.max(level[F.col("quality_status")]) if "quality_status" in bars.columns else F.max(F.lit(0))
    facts = chosen.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_date"), quality.alias("_q"))
    facts = facts.withColumn("worst_quality", F.when(F.col("_q") == 2, qc.BLOCKED).when(F.col("_q") == 1, qc.WARNING).otherwise(qc.OK))
    gaps = qc.missing_sessions(chosen, calendar).groupBy("symbol").agg(F.count(F.lit(1)).alias("missing_sessions"))
    gate = qc.strict_gate(chosen)
    usable = gate.join(gaps, "symbol", "left_anti")
    scored = scored_bars(chosen.select("symbol", "date", "open", "high", "low", "close", "adjusted_close", "volume"), usable)
    parts = [*FIVE_COMPONENT_WEIGHTS, "score"]
    latest = scored.groupBy("symbol").agg(F.max_by(F.struct(*parts), "date").alias("_l"))
    table = facts.join(gaps, "symbol", "left").join(gate.select("symbol", F.col("blocked").alias("gate_blocked")), "symbol", "left")
    table = table.join(latest, "symbol", "left").withColumn("latest_score", F.col("_l")["score"]).join(F.broadcast(last))
    status = qc.observation_status(table).select(
        "symbol", "status", "bars", "last_date", *[F.col("_l")[c].alias(c) for c in parts]
    )
    return status, last_rows(scored.select("symbol", "date", "score"), POINTS)


def indicator_history(inputs: DataFrame, n: int = POINTS) -> DataFrame:
    """Last ``n`` points (0 = all) of price, score and percentile. The score is computed once: counts and points read the written rows."""
    return last_rows(settle(inputs.select("symbol", "date", F.col("close").alias("price"), "score", F.col("score_rank").alias("percentile"))), n)


def signal_history(scored: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS, n: int = POINTS,
                   factors: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows of a scored series as the chart needs them: price, factors, score, the action of the ladder on the day ('hold' without one) and the
    thresholds. ``scored`` has symbol, date, close, score and the factors."""
    rows = settle(scored.select("symbol", "date", F.col("close").alias("price"), *factors, "score"))
    made = ladder(rows.where("score IS NOT NULL"), buys, sells).select("symbol", "date", "action", "steps")
    levels = {"buy_thresholds": F.array(*[F.lit(float(x)) for x in buys]), "sell_thresholds": F.array(*[F.lit(float(x)) for x in sells])}
    joined = last_rows(rows, n).join(made, ["symbol", "date"], "left").withColumns(levels)
    return joined.withColumn("action", F.coalesce("action", F.lit("hold")))


def history_view(inputs: DataFrame, n: int = 600) -> tuple[DataFrame, DataFrame]:
    """(points, threshold distribution) over the same rows; the score is computed once."""
    inputs = settle(inputs.select("symbol", "date", "close", "score"))
    points = last_rows(inputs.select("symbol", "date", F.col("close").alias("price"), "score"), n)
    return points, threshold_distribution(inputs, n)


def check_request(symbols, known, start, end, limit: int | None = None, most_symbols: int | None = None, most_days: int | None = None,
                  most_rows: int | None = None) -> None:
    """Validate a comparison request before any DataFrame is built; limits that are None do not apply."""
    names = list(symbols)
    if not names or len(set(names)) != len(names) or not set(names) <= set(known) or (most_symbols is not None and len(names) > most_symbols):
        raise ValueError("choose different known symbols" + (f", at most {most_symbols}" if most_symbols is not None else ""))
    if end < start or (most_days is not None and (end - start).days > most_days):
        raise ValueError("the date range is empty or too long")
    if limit is not None and (limit < 0 or (most_rows is not None and limit > most_rows)):
        raise ValueError("the window is negative or too long")


def request_problems(requests: DataFrame, known: DataFrame, most_symbols: int | None = None, most_days: int | None = None, most_rows: int | None = None) -> DataFrame:
    """The same checks for a table of requests: id, symbols (array), start, end, limit -> id, problems (array of texts).

    ``known`` has a column symbol. Repeated names count once here. Null dates make the range empty; a null list has no symbols; a null limit is allowed.
    """
    each = requests.select("id", F.explode(F.array_distinct(F.coalesce("symbols", F.array().cast("array<string>")))).alias("symbol"))
    found = each.join(known.select("symbol").distinct(), "symbol", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("_found"))
    n = F.when(F.col("symbols").isNull(), 0).otherwise(F.size(F.array_distinct("symbols")))
    crowd = F.lit(False) if most_symbols is None else n > most_symbols
    long = F.lit(False) if most_days is None else F.datediff("end", "start") > most_days
    wide = F.lit(False) if most_rows is None else F.coalesce(F.col("limit") > most_rows, F.lit(False))
    problems = F.array_compact(F.array(
        F.when((n == 0) | (n != F.coalesce("_found", F.lit(0))) | crowd, "symbols"),
        F.when(F.coalesce((F.col("end") < F.col("start")) | long, F.lit(True)), "range"),
        F.when(F.coalesce(F.col("limit") < 0, F.lit(False)) | wide, "limit"),
    ))
    return requests.join(found, "id", "left").select("id", problems.alias("problems"))
