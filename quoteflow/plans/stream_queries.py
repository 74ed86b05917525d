"""Registered queries: streaming jobs run to completion over the event table."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quoteflow.plans.registry import query, r, rounded
from quoteflow.plans.series_queries import recursive
from quoteflow.plans.signal_queries import BUYS, SELLS, ladder_cte
from quoteflow.sources.writers import read_bars, scratch_path
from quoteflow.streaming import jobs


def event_stream(spark, sf):
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("symbol"), "value")


def finish(stream) -> None:
    stream.awaitTermination()


SCORE = "200 * value / (value + 50) - 100"
LADDER = recursive(
    f"""q AS (SELECT symbol, ts, value, score, row_number() OVER w AS rn, coalesce(lag(score) OVER w, score) AS prev FROM
  (SELECT event_type AS symbol, ts, event_id, value, {SCORE} AS score FROM events) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))""",
    ladder_cte("w", "q", "symbol", BUYS, SELLS),
)


@query("st1_stream_ladder", f"""{LADDER}, j AS (SELECT q.symbol, q.ts, q.value, w.delta, w.steps, lag(w.delta) OVER (PARTITION BY q.symbol ORDER BY q.rn) AS fill_delta FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn)
SELECT symbol, epoch_us(ts) AS at, delta, steps, CASE WHEN fill_delta <> 0 THEN value END AS fill_price, coalesce(fill_delta, 0) AS fill_delta FROM j WHERE delta <> 0 OR fill_delta <> 0""")
def _(spark, sf):
    jobs.use_rocksdb(spark)
    folder = scratch_path(spark, "ladder")
    score = F.expr("200 * value / (value + 50) - 100")
    rows = event_stream(spark, sf).select("symbol", "ts", "event_id", F.col("value").alias("open"), score.alias("score"))
    out = jobs.stream_ladder(rows, order=("ts", "event_id"))
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").select("symbol", F.unix_micros("ts").alias("at"), "delta", "steps", "fill_price", "fill_delta")


def out_of_order(spark, sf, folder: str, per_trigger: int = 3):
    """The events as a stream of files in which a row comes up to some six days before or after its turn."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    turn = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.dayofmonth("ts") / 3) + F.crc32(F.col("event_id").cast("string")) % 3 - 1))
    for k in range(10):
        rows.where(turn == k).coalesce(2).write.parquet(f"{folder}/in/{k}")
    schema = "event_id BIGINT, ts TIMESTAMP, symbol STRING, value DOUBLE"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/in/*")


# more than the files are out of order
DELAY = "10 days"


@query("st1_event_time_ladder", f"""{LADDER}, j AS (SELECT q.symbol, q.ts, q.value, w.delta, w.steps, lag(w.delta) OVER (PARTITION BY q.symbol ORDER BY q.rn) AS fill_delta FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn)
SELECT symbol, epoch_us(ts) AS at, delta, steps, CASE WHEN fill_delta <> 0 THEN value END AS fill_price, coalesce(fill_delta, 0) AS fill_delta FROM j
WHERE (delta <> 0 OR fill_delta <> 0) AND ts < (SELECT date_trunc('hour', max(ts) - INTERVAL {DELAY}) FROM events)""")
def _(spark, sf):
    jobs.use_rocksdb(spark)
    folder = scratch_path(spark, "event-ladder")
    rows = out_of_order(spark, sf, folder).withWatermark("ts", DELAY)
    out = jobs.event_ladder(rows.select("symbol", "ts", "event_id", F.col("value").alias("open"), F.expr("200 * value / (value + 50) - 100").alias("score")), tie="event_id")
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").withColumn("fill_price", F.nanvl("fill_price", F.lit(None)))


BAR_LADDER = recursive(
    f"""b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, {SCORE.replace("value", "arg_max(value, (ts, event_id))")} AS score
  FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
q AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(score) OVER w, score) AS prev FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day))""",
    ladder_cte("w", "q", "symbol", BUYS, SELLS),
)


@query("st5_st1_bars_to_decisions", f"""{BAR_LADDER}, j AS (SELECT q.symbol, q.day, q.open, w.delta, w.steps, lag(w.delta) OVER (PARTITION BY q.symbol ORDER BY q.rn) AS fill_delta FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn)
SELECT symbol, day, delta, steps, CASE WHEN fill_delta <> 0 THEN open END AS fill_price, coalesce(fill_delta, 0) AS fill_delta FROM j WHERE delta <> 0 OR fill_delta <> 0""")
def _(spark, sf):
    jobs.use_rocksdb(spark)
    folder = scratch_path(spark, "bar-decisions")
    out = jobs.bar_decisions(event_stream(spark, sf), F.expr("200 * close / (close + 50) - 100"))
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    told = spark.read.parquet(f"{folder}/out")
    return told.select("symbol", F.to_date(F.timestamp_micros("at")).alias("day"), "delta", "steps", F.nanvl("fill_price", F.lit(None)).alias("fill_price"), "fill_delta")


@query("st2_deliver_once", "SELECT user_id || ':' || event_type AS dedup_key, arg_min(value, (ts, value)) AS value FROM events GROUP BY 1")
def _(spark, sf):
    folder = scratch_path(spark, "alerts")
    alerts = event_stream(spark, sf).select(F.concat_ws(":", F.col("user_id").cast("string"), "symbol").alias("dedup_key"), "ts", "value")
    finish(jobs.deliver_once(alerts, f"{folder}/out", f"{folder}/cp", order=("value",)))
    return spark.read.parquet(f"{folder}/out").select("dedup_key", "value")


@query("st2_dedupe_within_watermark", "SELECT DISTINCT user_id || ':' || event_type || ':' || CAST(ts AS DATE) AS dedup_key FROM events")
def _(spark, sf):
    folder = scratch_path(spark, "dedupe")
    day = F.to_date("ts").cast("string")
    alerts = event_stream(spark, sf).select(F.concat_ws(":", F.col("user_id").cast("string"), "symbol", day).alias("dedup_key"), "ts")
    out = jobs.stream_dedupe(alerts).select("dedup_key")
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out")


@query("st3_stream_upsert", "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, 'stream' AS source, arg_max(value, ts) AS close FROM events GROUP BY ALL")
def _(spark, sf):
    folder = scratch_path(spark, "upsert")
    bars = event_stream(spark, sf).select("symbol", F.to_date("ts").alias("date"), F.lit("stream").alias("source"), F.col("value").alias("close"), F.col("ts").alias("fetched_at"))
    finish(jobs.stream_upsert(bars, f"{folder}/out", f"{folder}/cp"))
    return read_bars(spark, f"{folder}/out").select("symbol", "date", "source", "close")


# Published: each day's lowest value, a null one where it is a whole number of tens, before the middle of the month; the stream restates all days.
@query("st4_stream_guard", f"""WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, min(value) AS low, max(value) AS high FROM events GROUP BY ALL)
SELECT symbol, date, {r("CASE WHEN date >= DATE '2024-01-16' THEN high WHEN floor(low * 100) % 10 > 0 THEN low END", 'close', 4)} FROM d""")
def _(spark, sf):
    folder = scratch_path(spark, "guard")
    days = spark.read.parquet(f"{sf}/events.parquet").where("ts < TIMESTAMP_NTZ'2024-01-16'").groupBy(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.min("value").alias("low"))
    days.select("symbol", "date", F.when(F.floor(F.col("low") * 100) % 10 > 0, F.col("low")).alias("close")).write.parquet(f"{folder}/out")
    rows = event_stream(spark, sf).select("symbol", F.to_date("ts").alias("date"), F.col("value").alias("close"))
    finish(jobs.stream_guard(rows, f"{folder}/out", f"{folder}/cp", {}, {"close": 1e9}, order=("close",)))
    return rounded(spark.read.parquet(f"{folder}/out"), 4, "close")


@query("st4_drift_report", """WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, value FROM events), o AS (SELECT symbol, date, min(value) AS low FROM d GROUP BY ALL),
e AS (SELECT symbol, max(value - low) AS error FROM d JOIN o USING (symbol, date) GROUP BY 1)
SELECT symbol, round(error::DOUBLE, 4) + 0.0 AS close_error FROM e WHERE error > 20""")
def _(spark, sf):
    folder = scratch_path(spark, "drift")
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.col("value").alias("close"))
    events.groupBy("symbol", "date").agg(F.min("close").alias("close")).write.parquet(f"{folder}/out")
    rows = event_stream(spark, sf).select("symbol", F.to_date("ts").alias("date"), F.col("value").alias("close"))
    try:
        finish(jobs.stream_guard(rows, f"{folder}/out", f"{folder}/cp", {}, {"close": 20.0}))
    except StreamingQueryException as failed:
        if "drifted" not in str(failed):
            raise
    return rounded(spark.read.parquet(f"{folder}/out_drift").select("symbol", "close_error"), 4, "close_error")


@query("st5_stream_bars", """SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  count(*) AS volume FROM events GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, sf):
    folder = scratch_path(spark, "bars")
    out = jobs.stream_bars(event_stream(spark, sf))
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").select("symbol", F.to_date("start").alias("day"), "open", "high", "low", "close", "volume")
