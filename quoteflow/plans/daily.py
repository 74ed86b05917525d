"""The daily chain: guards, appended bars, scores and publishing of one day as one function with one commit at its end."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.operators import quality as qc
from quoteflow.plans.scores import two_input_score
from quoteflow.session import settle
from quoteflow.sources import tables
from quoteflow.sources.readers import manifest_json
from quoteflow.sources.writers import publish_snapshot

# How far a restated price (relative) and score (absolute) may be from what was published.
PRICE_LIMITS, SCORE_LIMITS = {"open": 0.002, "close": 0.002}, {"score": 0.1}
COLUMNS = ("open", "close", "score", "score_rank", "score_partial_rank")
INPUTS = "symbol STRING, date DATE, " + ", ".join(f"{c} DOUBLE" for c in COLUMNS)


class ChainStopped(RuntimeError):
    """A check failed; nothing was published."""


def published_day(spark: SparkSession, root: str) -> str | None:
    """The day that the pointer names, as text."""
    pointer = tables.text_at(spark, f"{root}/latest.json")
    return json.loads(pointer)["date"] if pointer else None


def published_inputs(spark: SparkSession, root: str, day: str) -> DataFrame:
    columns = ["symbol", "date", *COLUMNS]
    return spark.read.schema(INPUTS).option("header", True).csv(f"{root}/{day}/inputs").select(*columns)


def _stop_on(step: str, bad: DataFrame) -> None:
    names = [r[0] for r in bad.select("symbol").distinct().orderBy("symbol").limit(5).collect()]
    if names:
        raise ChainStopped(f"{step}: {', '.join(names)}")


def _chain(spark, root, base, fresh, calendar, day, overlap, parameters, frozen, frozen_through, digests, last) -> None:
    if digests is not None and not digests.where("NOT ok").isEmpty():
        raise ChainStopped("a frozen file has changed")
    factor = settle(qc.overlap_factor(base, fresh, *overlap))
    combined, audit = qc.append_rebased(base, fresh, factor, calendar, day.isoformat())
    combined, audit = settle(combined), settle(audit)
    _stop_on("appended bars", audit.where("NOT accepted"))
    scored = settle(two_input_score(combined, parameters))
    if frozen is not None:
        now = scored.where(F.col("date") <= F.lit(frozen_through).cast("date"))
        _stop_on("frozen values", qc.prefix_equal(frozen, now, COLUMNS).where("NOT unchanged"))
    if last is not None:
        old = published_inputs(spark, root, last)
        _stop_on("published values", qc.drift_guard(old, scored, PRICE_LIMITS, SCORE_LIMITS).where("NOT within_limits"))
        joined = qc.anchor_continuity(old, combined, frozen_through or last)
        _stop_on("anchor", joined.where("continuity IS NULL"))
        # prices go on from what was published, and what was published stays
        scored = qc.preserve_published(old, two_input_score(joined.drop("continuity"), parameters), COLUMNS)
    frames = {"inputs": scored.select("symbol", "date", *COLUMNS), "audit": audit}
    publish_snapshot(spark, frames, root, day, {"frozen_cutoff": frozen_through, "previous_snapshot": last})


def update(spark: SparkSession, root: str, base: DataFrame, fresh: DataFrame, calendar: DataFrame, day, overlap: Sequence, parameters: Sequence[float],
           frozen: DataFrame | None = None, frozen_through=None, digests: DataFrame | None = None) -> Mapping:
    """Publish ``day``: the frozen files' digests hold, fresh bars continue ``base`` for every symbol, scores up to ``frozen_through`` equal ``frozen``, values
    published before are met within limits and stay as they are. A day that is published already is left alone.

    The pointer moves last. On any failure it stays at the last good day, ``status.json`` says why, and the error goes on to the caller.
    """
    last = published_day(spark, root)
    if last == day.isoformat():
        return {"status": "ok", "data_date": last, "last_successful_date": last, "reason": None}
    status = {"status": "ok", "data_date": day.isoformat(), "last_successful_date": day.isoformat(), "reason": None}
    try:
        _chain(spark, root, base, fresh, calendar, day, overlap, parameters, frozen, frozen_through, digests, last)
    except Exception as error:
        failed = {**status, "status": "failed", "last_successful_date": last, "reason": str(error).splitlines()[0]}
        tables.replace_text(spark, f"{root}/status.json", manifest_json(failed))
        raise
    tables.replace_text(spark, f"{root}/status.json", manifest_json(status))
    return status
