"""Structured Streaming versions of the stateful daily jobs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quoteflow.operators.joins import DEFAULT_BUYS, DEFAULT_SELLS
from quoteflow.operators.quality import drift_guard
from quoteflow.operators.signals import ladder_table
from quoteflow.sources.writers import existing, upsert_bars

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LADDER_OUTPUT = "symbol STRING, ts TIMESTAMP, delta INT, steps INT, fill_ts TIMESTAMP, fill_price DOUBLE, fill_delta INT"


class LadderProcessor(StatefulProcessor):
    """Ladder state per key: previous score, packed ladder state, and the decision that waits for the next bar."""

    def __init__(self, buys: Sequence[float], sells: Sequence[float], order: Sequence[str]):
        self.buys, self.sells, self.order = tuple(buys), tuple(sells), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ladder", "prev DOUBLE, packed INT, pending INT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nexts, deltas = ladder_table()
        prev, packed, pending = self.state.get() if self.state.exists() else (None, 0, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # one key of one micro-batch
        for ts, price, score in zip(batch["ts"], batch["open"], batch["score"], strict=True):
            before = score if prev is None else prev
            down = sum(1 << i for i, level in enumerate(self.buys) if before > level >= score)
            up = sum(1 << i for i, level in enumerate(self.sells) if before < level <= score)
            delta, filled = int(deltas[packed, down, up]), pending
            packed, pending, prev = int(nexts[packed, down, up]), delta, float(score)
            if delta or filled:
                out.append((key[0], ts, delta, packed >> 6, ts if filled else None, float(price) if filled else None, filled))
        self.state.update((prev, packed, pending))
        names = [c.split()[0] for c in LADDER_OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def stream_ladder(scores: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS,
                  order: Sequence[str] = ("ts",)) -> DataFrame:
    """Decisions and next-bar fills per key over a stream of (symbol, ts, open, score).

    The session needs the RocksDB state store (:func:`use_rocksdb`). Late rows are not reordered across micro-batches.
    """
    return scores.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LadderProcessor(buys, sells, order), outputStructType=LADDER_OUTPUT, outputMode="append", timeMode="none"
    )


MICROS = 1_000_000
EVENT_LADDER_OUTPUT = "symbol STRING, at BIGINT, delta INT, steps INT, fill_price DOUBLE, fill_delta INT"


class EventTimeLadder(StatefulProcessor):
    """Ladder over rows in event-time order, whatever order they arrive in.

    Rows wait in map state by time slot, each slot with a timer at its end. When the watermark has passed it, no row of the slot can come any more: the
    slot is sorted, walked from the key's ladder state and removed. So the state of a key is its ladder and the rows of the slots still open.
    """

    def __init__(self, buys: Sequence[float], sells: Sequence[float], slot_seconds: int):
        self.buys, self.sells, self.slot = np.array(buys, dtype=float), np.array(sells, dtype=float), slot_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ladder", "prev DOUBLE, packed INT, pending INT")
        self.waiting = handle.getMapState("waiting", "slot BIGINT", "at ARRAY<BIGINT>, tie ARRAY<BIGINT>, price ARRAY<DOUBLE>, score ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            columns = [batch[c].to_numpy() for c in ("at", "tie", "open", "score")]
            slots = columns[0] // self.slot
            for slot in np.unique(slots).tolist():
                here = slots == slot
                new = tuple(c[here].tolist() for c in columns)
                held = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else ([], [], [], [])
                self.waiting.updateValue((slot,), tuple([*a, *b] for a, b in zip(held, new)))
                self.handle.registerTimer((slot + 1) * self.slot // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slot
        for slot in sorted(s for (s,) in self.waiting.keys() if s < past):
            found = self._walk(key[0], *map(np.array, self.waiting.getValue((slot,))))
            self.waiting.removeKey((slot,))
            if len(found):
                yield found

    def _walk(self, symbol: str, at: np.ndarray, tie: np.ndarray, price: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        nexts, deltas = ladder_table()
        order = np.lexsort((tie, at))
        at, price, score = at[order], price[order], score[order]
        prev, packed, pending = self.state.get() if self.state.exists() else (float(score[0]), 0, 0)
        before = np.concatenate([[prev], score[:-1]])
        weight = 1 << np.arange(len(self.buys))
        down = ((before[:, None] > self.buys) & (self.buys >= score[:, None])) @ weight
        up = ((before[:, None] < self.sells) & (self.sells <= score[:, None])) @ weight
        delta, crossed = np.zeros(len(at), dtype=np.int64), np.flatnonzero(down | up)  # a row that crosses nothing changes nothing
        after = [packed]
        for k in crossed:
            delta[k], packed = deltas[packed, down[k], up[k]], nexts[packed, down[k], up[k]]
            after.append(int(packed))
        steps = np.array(after)[np.searchsorted(crossed, np.arange(len(at)), side="right")] >> 6
        filled = np.concatenate([[pending], delta[:-1]])
        self.state.update((float(score[-1]), int(packed), int(delta[-1])))
        told = (delta != 0) | (filled != 0)
        return pd.DataFrame({
            "symbol": symbol, "at": at[told], "delta": delta[told].astype(np.int32), "steps": steps[told].astype(np.int32),
            "fill_price": np.where(filled[told] != 0, price[told], np.nan), "fill_delta": filled[told].astype(np.int32),
        })

    def close(self) -> None:
        pass


def event_ladder(scores: DataFrame, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS, ts: str = "ts",
                 tie: str | None = None, slot_seconds: int = 3600) -> DataFrame:
    """Decisions and next-row fills per symbol in event time over a stream of (symbol, ts, open, score) that has a watermark on ``ts``.

    A row counts once the watermark has passed the end of its slot, so rows may arrive in any order within the watermark's delay and the result is the
    batch ladder's, however the stream is cut into batches; later ones are dropped. ``tie`` (whole numbers) orders rows of one instant. ``at`` is in
    microseconds, ``fill_price`` NaN where nothing fills. Needs :func:`use_rocksdb`; the source's trigger options bound what a batch holds.
    """
    rows = scores.select("symbol", ts, F.unix_micros(ts).alias("at"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("tie"), F.col("open").cast("double"), F.col("score").cast("double"))
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=EventTimeLadder(buys, sells, slot_seconds), outputStructType=EVENT_LADDER_OUTPUT, outputMode="append", timeMode="EventTime"
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_dedupe(alerts: DataFrame, ts: str = "ts", key: str = "dedup_key", horizon: str = "2 days") -> DataFrame:
    """First alert per key within the watermark; bounded state."""
    return alerts.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def deliver_once(alerts: DataFrame, path: str, checkpoint: str, ts: str = "ts", key: str = "dedup_key", order: Sequence[str] = ()) -> StreamingQuery:
    """Unbounded horizon: a batch appends only keys the delivered table does not have, the earliest row of each.

    ``order`` and then the other columns break ties of ``ts``. The delivered keys of all time are the state of this job: of the table only its key
    column is read.
    """

    def write(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(ts, *order, *[c for c in rest if c not in (ts, *order)])).alias("_r")).select(key, "_r.*")
        delivered = existing(spark, path)
        if delivered is not None:
            first = first.join(delivered.select(key), key, "left_anti")
        first.write.mode("append").parquet(path)

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(bars: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("symbol", "date", "source")) -> StreamingQuery:
    """Upsert every micro-batch of a bar stream into the committed table (:mod:`tables`), a version each; a batch that was committed before a failure
    is known by its number and not written again."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_bars(batch.sparkSession, path, batch, key, checkpoint, number)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DriftError(RuntimeError):
    """A restated row is further from its published value than allowed; the batch is not written."""


def stream_guard(rows: DataFrame, published: str, checkpoint: str, relative: Mapping[str, float], absolute: Mapping[str, float],
                 key: str = "symbol", ts: str = "date", audit: str | None = None, order: Sequence[str] = ()) -> StreamingQuery:
    """Append only new (key, date) rows; restated ones are dropped, and a drift beyond the limits fails the batch.

    Of several new rows for one (key, date) the last by ``order`` (then by their columns) counts. Only published rows in the batch's range of dates are read. All
    violating keys with their errors go to ``audit`` (default: beside the published table) before the batch fails.
    """
    report = audit or f"{published.rstrip('/')}_drift"

    def write(batch: DataFrame, _id: int) -> None:
        if batch.isEmpty():
            return
        table = batch.sparkSession.read.parquet(published)
        span = batch.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
        old = table.where(F.col(ts).between(F.lit(span["a"]), F.lit(span["b"])))
        worst = drift_guard(old, batch, relative, absolute, key, ts).where(~F.col("within_limits"))
        if not worst.isEmpty():
            worst.withColumn("batch", F.lit(_id)).write.mode("append").parquet(report)
            raise DriftError(f"published values drifted for {worst.count()} keys; they are listed in {report}")
        rest = [c for c in batch.columns if c not in (key, ts)]
        last = batch.groupBy(key, ts).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(key, ts, "_r.*")
        fresh = last.join(old.select(key, ts), [key, ts], "left_anti")
        fresh.select(*table.columns).write.mode("append").parquet(published)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_bars(events: DataFrame, window: str = "1 day", delay: str = "1 hour", ts: str = "ts", key: str = "symbol",
                value: str = "value", tie: str = "event_id") -> DataFrame:
    """Tumbling bars per key from raw events; a bar is emitted once the watermark passes its end. ``closed``, its last instant, carries the watermark
    on to a stateful operator behind (:func:`bar_decisions`)."""
    at = F.struct(ts, tie)
    bars = events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("_w"), key).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return bars.select(key, F.col("_w.start").alias("start"), F.window_time("_w").alias("closed"), "open", "high", "low", "close", "volume")


def bar_decisions(events: DataFrame, score, buys: Sequence[float] = DEFAULT_BUYS, sells: Sequence[float] = DEFAULT_SELLS, window: str = "1 day",
                  delay: str = "1 hour", slot_seconds: int = 86400, **names: str) -> DataFrame:
    """Ladder decisions over the bars of an event stream, in one query: two stateful operators behind one another, the first one's watermark carried
    through. ``score`` is a column over a bar's open, high, low, close and volume. A decision fills at the next bar's open; ``at`` is a bar's last instant."""
    bars = stream_bars(events, window, delay, **names)
    return event_ladder(bars.withColumn("score", score), buys, sells, "closed", None, slot_seconds)
