"""Hand tables: labels, verdicts, sources, imports, snapshots, ledgers and streams."""

import hashlib
import re
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quoteflow.functions import scalars as sc
from quoteflow.operators import joins, metrics, quality, rules
from quoteflow.operators.signals import ladder_table
from quoteflow.plans import catalogue
from quoteflow.sources import readers, tables, writers
from quoteflow.streaming import jobs


def test_band_edges(spark):
    cases = [(-50.0, 0), (-40.0, 1), (-20.0, 2), (0.0, 3), (20.0, 4), (40.0, 5), (50.0, 5), (-30.0, 1), (30.0, 4),
             (None, -1), (float("nan"), -1), (float("inf"), -1), (-50.01, -1), (50.01, -1)]
    df = spark.createDataFrame(cases, "score double, want int")
    assert df.where(sc.band("score") != F.col("want")).count() == 0


def test_means_differ_in_their_null_rule(spark):
    row = spark.createDataFrame([(1.0, None), (1.0, 3.0)], "a double, b double").select(sc.mean_skip(["a", "b"]).alias("s"), sc.mean_strict(["a", "b"]).alias("t")).collect()
    assert [tuple(r) for r in row] == [(1.0, None), (2.0, 2.0)]


def test_nearest_threshold_first_wins_ties(spark):
    df = spark.createDataFrame([(0.0,)], "s double").select(F.inline(F.array(sc.nearest_threshold("s", F.array(F.lit(-60.0), F.lit(60.0))))))
    assert tuple(df.first()) == (-60.0, 60.0)


def bars(spark, rows):
    return spark.createDataFrame([(s, date.fromisoformat(d), o, h, lo, c, a, v, 1.0) for s, d, o, h, lo, c, a, v in rows],
                                 "symbol string, date date, open double, high double, low double, close double, adjusted_close double, volume double, split_factor double")


def steady(spark, symbol="A", days=8, start=1, adjusted=1.0, month="2020-01"):
    return bars(spark, [(symbol, f"{month}-{d:02d}", 10.0, 15.0, 9.0, 10.0 + d / 10, (10.0 + d / 10) * adjusted, 5.0) for d in range(start, start + days)])


def test_verdicts(spark):
    end = F.lit("2020-01-10").cast("date")
    good = steady(spark)
    status = lambda df, at=end: quality.series_verdict(df, at).first().status
    assert status(good) == "ok"
    assert status(good, F.lit("2020-01-15").cast("date")) == "warning"
    assert status(good, F.lit("2020-01-25").cast("date")) == "blocked"
    assert status(good.withColumn("low", F.col("high"))) == "blocked"
    jump = good.withColumn("adjusted_close", F.when(F.dayofmonth("date") == 5, 100.0).otherwise(F.col("adjusted_close")))
    assert status(jump) == "warning"
    none = quality.series_verdict(good, end, symbols=spark.createDataFrame([("Z",)], "symbol string")).first()
    assert (none.symbol, none.status) == ("Z", "blocked")


def test_freshest_source(spark):
    rows = [("P", "public", "2020-01-02"), ("P", "yahoo", "2020-01-02"), ("F", "public", "2020-01-01"), ("F", "yahoo", "2020-01-02"), ("N", "public", "2020-01-01"), ("N", "yahoo", "2020-01-01")]
    df = spark.createDataFrame(rows, "symbol string, source string, day string").select("symbol", "source", F.to_date("day").alias("date"))
    got = {r.symbol: (r.source, r.status) for r in quality.freshest_source(df, F.lit("2020-01-02").cast("date"), ["public", "yahoo"]).collect()}
    assert got == {"P": ("public", "ok"), "F": ("yahoo", "ok"), "N": (None, "error")}


def test_append_rebased_accepts_a_clean_continuation(spark):
    base = steady(spark, days=10)
    fresh = steady(spark, days=15, adjusted=1.02)
    calendar = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-01-31')) AS session")
    factor = quality.overlap_factor(base, fresh, "2020-01-01", "2020-01-10")
    combined, audit = quality.append_rebased(base, fresh, factor, calendar, "2020-01-15")
    row = audit.first()
    assert row.accepted and row.new_rows == 5 and row.factor == pytest.approx(1.02)
    last = combined.orderBy(F.col("date").desc()).first()
    assert last.date == date(2020, 1, 15) and last.adjusted_close == pytest.approx(last.close)
    _, late = quality.append_rebased(base, fresh, factor, calendar, "2020-01-20")
    assert not late.first().accepted and late.first().missing == 5


def test_published_row_wins_even_where_null(spark):
    old = spark.createDataFrame([("A", date(2020, 1, 1), None)], "symbol string, date date, x double")
    new = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 2), 2.0)], "symbol string, date date, x double")
    got = {r.date: r.x for r in quality.preserve_published(old, new, ["x"]).collect()}
    assert got == {date(2020, 1, 1): None, date(2020, 1, 2): 2.0}


def test_missing_anchor_gives_no_continuity(spark):
    old = spark.createDataFrame([("A", date(2020, 1, 3), 5.0)], "symbol string, date date, close double")
    new = spark.createDataFrame([("A", date(2020, 1, 4), 1.0)], "symbol string, date date, adjusted_close double")
    row = quality.anchor_continuity(old, new, "2020-01-01").first()
    assert row.continuity is None and row.adjusted_close is None


def test_latest_fx_rules(spark):
    fx = spark.createDataFrame([("2020-01-01", "USD", "CNY", 7.0), ("2020-01-02", "USD", "CNY", 8.0), ("2020-01-01", "CNY", "HKD", 2.0), ("2020-01-01", "CNY", "BAD", 0.0)],
                               "date string, base string, quote string, rate double")
    pairs = spark.createDataFrame([("USD", "CNY"), ("HKD", "CNY"), ("CNY", "CNY"), ("BAD", "CNY"), ("XXX", "CNY")], "base string, quote string")
    got = {r.base: r.rate for r in joins.latest_fx(fx, pairs).collect()}
    assert got == {"USD": 8.0, "HKD": 0.5, "CNY": 1.0, "BAD": None, "XXX": None}


def test_daily_chain_is_repeatable_and_keeps_the_last_good_day(spark, tmp_path):
    from quoteflow.plans import daily
    from quoteflow.plans.series_queries import FROZEN_PARAMETERS

    root = str(tmp_path / "forward")
    calendar = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-01-31')) AS session")
    base, overlap = steady(spark, days=10), ("2020-01-01", "2020-01-10")
    run = lambda fresh, day: daily.update(spark, root, base, fresh, calendar, day, overlap, FROZEN_PARAMETERS)
    first = run(steady(spark, days=15, adjusted=1.02), date(2020, 1, 15))
    assert first["status"] == "ok" and run(steady(spark, days=2), date(2020, 1, 15))["data_date"] == "2020-01-15"
    with pytest.raises(daily.ChainStopped, match="appended bars: A"):
        run(steady(spark, days=15, adjusted=1.02), date(2020, 1, 18))
    status = spark.read.json(f"{root}/status.json").first()
    assert (status.status, status.last_successful_date) == ("failed", "2020-01-15") and daily.published_day(spark, root) == "2020-01-15"
    changed = spark.createDataFrame([("A", False)], "file string, ok boolean")
    with pytest.raises(daily.ChainStopped, match="frozen file"):
        daily.update(spark, root, base, base, calendar, date(2020, 1, 16), overlap, FROZEN_PARAMETERS, digests=changed)
    assert daily.published_inputs(spark, root, "2020-01-15").count() == 15


@pytest.mark.parametrize("size", [7, 100_000])
@pytest.mark.parametrize("strict,tolerance", [(False, None), (True, None), (False, 100.0), (True, 3.0)])
def test_as_of_join(spark, size, strict, tolerance):
    import random

    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    def row(k):
        return ("HOT" if k % 4 else f"k{k % 3}", start + timedelta(seconds=rnd.randrange(4000) * 5), k)
    left, right = [row(k) for k in range(300)], [row(k) for k in range(200)]
    left += [(None, start, 900), ("HOT", None, 901), ("none", start, 902)]
    schema = "who string, ts timestamp, id long"
    got = joins.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "other"), ["other"], "who", "ts", strict, tolerance, ["other"], size=size, width=600)
    found = {r.id: (r.matched.other if r.matched else None) for r in got.collect()}
    assert len(found) == len(left)
    for who, ts, i in left:
        near = [(t, o) for w, t, o in right if who is not None and ts is not None and w == who and (t < ts or t == ts and not strict)]
        best = max(near, default=None)
        inside = best and (tolerance is None or (ts - best[0]).total_seconds() <= tolerance)
        assert found[i] == (best[1] if inside else None), (who, ts, i)


def test_short_curve_has_zero_metrics(spark):
    row = metrics.performance(spark.createDataFrame([("A", date(2020, 1, 1), 1.0)], "symbol string, date date, equity double")).first()
    assert row.sharpe == 0 and row.cagr == 0 and row.trades == 0


def test_exit_ignores_the_gap_for_age_and_stop_only(spark):
    def position(name, first, sold, price):
        return (name, 10.0, 100.0, date.fromisoformat(first), date(2020, 3, 1), date.fromisoformat(sold) if sold else None, 12.0, False, 0, date(2020, 3, 10), 0.0, price)

    rows = [position("age", "2020-01-01", "2020-03-09", 10.0), position("profit", "2020-03-01", "2020-03-09", 14.0), position("free", "2020-03-01", None, 14.0), position("hold", "2020-03-01", None, 10.0)]
    df = spark.createDataFrame(rows, "symbol string, shares double, cost_basis double, first_date date, last_action_date date, last_sell_date date, peak_price double, armed boolean, sold_lots int, signal_date date, score double, close double")
    got = {r.symbol: (r.exit, r.reason) for r in rules.exit_triggers(df.drop("signal_date", "score", "close"), df.select("symbol", "signal_date", "score", "close")).collect()}
    assert got == {"age": (True, "age"), "profit": (False, None), "free": (True, "profit_target"), "hold": (False, None)}


# --- files ---------------------------------------------------------------------------------------------------

HEADER = "symbol,portfolio_kind,side,quantity,price,fee,executed_at,note"


def importing(spark, tmp_path, lines, mode="committed"):
    path = tmp_path / "t.csv"
    path.write_text("﻿" + "\n".join([HEADER, *lines]) + "\n")
    instruments = spark.createDataFrame([("AAA", 1, "USD")], "symbol string, instrument int, currency string")
    holdings = spark.createDataFrame([("live", 1, Decimal(10))], "kind string, instrument int, quantity decimal(18,6)")
    return readers.import_trades(spark, str(path), instruments, holdings, mode)


def test_import_is_all_or_nothing_with_line_numbers(spark, tmp_path):
    trades, errors = importing(spark, tmp_path, ["aaa,live,buy,5,10,,2020-01-01T10:00:00,ok", "ZZZ,live,buy,5,10,0,2020-01-01T10:00:00,x", "aaa,live,sell,11,10,0,2020-01-01T10:00:00,x",
                                                 "aaa,live,hold,-1,ten,0,never,x"])
    assert trades.count() == 0
    assert {(r.line, r.error) for r in errors.collect()} == {(3, "unknown symbol"), (4, "sell exceeds holdings"), (5, "invalid side"), (5, "quantity must be positive"),
                                                             (5, "invalid price"), (5, "invalid executed_at")}


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_of_one_file_read_by_many_tasks(spark, tmp_path, ending):
    """Blocks of 64 bytes and up cut quoted values, runs of quotes and line breaks anywhere; the csv module reads the file whole."""
    import csv
    import io

    names = [f"name{k}" for k in range(70)]
    records = [[f"v{i}.{k}" if k % 3 else ["", 'a "quoted" bit', "two\n\nbreaks, here", '"', 'x""y', "\n"][(i + k) % 6] for k in range(70)] for i in range(60)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ending)
    writer.writerow(names)
    for i, record in enumerate(records):
        writer.writerow(record)
        if i % 7 == 0:
            out.write(ending)
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("64", "1000", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = readers.read_trades(spark, str(tmp_path))
        if size == "1000":
            assert rows.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.file[-7:], r.line): r.fields for r in rows.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
        assert len(got) == 120
        for (_, line), fields in got.items():
            assert [fields[n] or "" for n in names] == records[line - 2]


def test_a_record_is_split_once(spark, tmp_path):
    """Not again for every field that is looked up in it."""
    (tmp_path / "t.csv").write_text("a,,a,b,c\n1,2,3,\n\n,x,y,z,,more\n")
    rows = readers.read_trades(spark, str(tmp_path / "t.csv"))
    assert {r.line: r.fields for r in rows.collect()} == {2: {"a": "1", "b": None, "c": None}, 3: {"a": None, "b": "z", "c": None}}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "map_from_entries" in line]
    assert made and not any(re.search(r"\bget\(", line) for line in made)


def test_import_modes_differ_for_rows_of_the_same_file(spark, tmp_path):
    lines = ["AAA,live,sell,8,10,0,2020-01-01T10:00:00,", "AAA,live,sell,8,10,0,2020-01-02T10:00:00,"]
    trades, errors = importing(spark, tmp_path, lines)
    assert trades.count() == 2 and errors.count() == 0  # both fit what is committed
    trades, errors = importing(spark, tmp_path, lines, "running")
    assert trades.count() == 0 and [(r.line, r.error) for r in errors.collect()] == [(3, "sell exceeds holdings")]


def test_snapshot_is_immutable_and_the_newest_committed_one_is_read(spark, tmp_path):
    root = str(tmp_path / "snap")
    for day in (date(2020, 1, 3), date(2020, 1, 4)):
        writers.publish_snapshot(spark, {"bars": steady(spark)}, root, day, {"strategy_version": "v"})
    assert readers.active_snapshot(spark, root).select("snapshot_date", "consistent").first() == (date(2020, 1, 4), True)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.publish_snapshot(spark, {"bars": steady(spark)}, root, date(2020, 1, 4), {})


def test_unknown_column_aborts_publishing(spark):
    with pytest.raises(ValueError, match="secret"):
        writers.publish_allowed(spark.createDataFrame([(1, 2)], "a int, secret int"), ["a"])


def test_history_page_problems(spark):
    record = lambda d, v: f'{{a:1,c:{v},h:1,l:1,o:1,t:"{d}",v:9,ch:0}}'
    pages = spark.createDataFrame([("ok", record("2020-01-02", 1)), ("dup", record("2020-01-02", 1) * 2), ("bad", record("2020-01-02", "x")), ("none", "nothing")], "symbol string, html string")
    rows, problems = readers.history_records(pages, "html", "2020-01-01", "2020-01-31")
    assert {r.symbol: r.problem for r in problems.collect()} == {"dup": "duplicate_date", "bad": "invalid_number", "none": "no_records"}
    assert [r.symbol for r in rows.collect()] == ["ok"]


# --- streams -------------------------------------------------------------------------------------------------


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_rows(n=400, days=12):
    import random

    rnd = random.Random(4)
    rows = [(f"K{k % 3}", datetime(2024, 1, 1 + k * days // n, (k * 24 * days // n) % 24, k % 60), k, round(rnd.uniform(1, 200), 2)) for k in range(n)]
    return rows + [(s, t, i + n, v / 2) for s, t, i, v in rows[::5]]  # ties of time


@pytest.mark.parametrize("per_trigger", [1, 3, 1000])
def test_event_time_ladder_whatever_the_order_and_the_batches(spark, tmp_path, per_trigger):
    jobs.use_rocksdb(spark)
    rows = event_rows()
    schema = "symbol string, ts timestamp, event_id long, open double"
    for part in range(8):  # a row comes up to two days before or after its turn
        mine = [r for r in rows if min(7, max(0, (r[1].day - 1) // 2 + (r[2] * 7 % 3) - 1)) == part]
        spark.createDataFrame(mine[::-1], schema).coalesce(2).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "6 days")
    out = jobs.event_ladder(stream.withColumn("score", F.expr("open - 100")), [-40.0, -60.0, -80.0], [40.0, 60.0, 80.0], tie="event_id")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.symbol, r.at, r.delta, r.steps, r.fill_delta) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    nexts, deltas = ladder_table()
    latest = max(r[1] for r in rows)
    end = (latest - timedelta(days=6)).replace(minute=0, second=0)
    want = []
    for symbol in ("K0", "K1", "K2"):
        prev, state, pending = None, 0, 0
        for _, ts, _, value in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1], r[2])):
            score = value - 100
            before = score if prev is None else prev
            down = sum(1 << i for i, level in enumerate((-40.0, -60.0, -80.0)) if before > level >= score)
            up = sum(1 << i for i, level in enumerate((40.0, 60.0, 80.0)) if before < level <= score)
            delta, filled = int(deltas[state, down, up]), pending
            state, pending, prev = int(nexts[state, down, up]), delta, score
            if (delta or filled) and ts < end:
                want.append((symbol, int(ts.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000, delta, state >> 6, filled))
    assert got == sorted(want) and len(want) > 20


def test_bars_to_decisions_restarts_from_its_checkpoint(spark, tmp_path):
    """Two stateful operators in one query, stopped and started again with more files, decide as if they had run through."""
    jobs.use_rocksdb(spark)
    schema = "symbol string, ts timestamp, event_id long, value double"
    rows = sorted(event_rows(), key=lambda r: r[1])

    def run(name, parts):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / "in" / str(k)))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in" / "*"))
            out = jobs.bar_decisions(stream, F.expr("close - 100"), [-40.0, -60.0, -80.0], [40.0, 60.0, 80.0])
            out.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(
                availableNow=True).start().awaitTermination()
        return sorted((r.symbol, r.at, r.delta, r.steps, r.fill_delta) for r in spark.read.parquet(str(tmp_path / name / "out")).collect())

    whole = run("whole", [rows])
    assert run("cut", [rows[:200], rows[200:330], rows[330:]]) == whole and len(whole) > 5


def test_stream_ladder_over_many_batches_equals_the_batch_ladder(spark, tmp_path):
    import numpy as np

    from quoteflow.operators.signals import ladder

    rng = np.random.default_rng(9)
    rows = [("A" if i % 3 else "B", datetime(2020, 1, 1 + i // 24, i % 24), 10.0 + i, float(100 * np.sin(i / 2) * rng.random() ** 0.2)) for i in range(400)]
    schema = "symbol string, ts timestamp, open double, score double"
    df = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "in")
    for part in range(4):  # files arrive in time order
        spark.createDataFrame(rows[part * 100: part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.use_rocksdb(spark)
    out = jobs.stream_ladder(stream_of(spark, folder, schema))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.symbol, r.ts, r.delta, r.steps) for r in streamed.where("delta <> 0").collect()}
    want = {(r.symbol, r.ts, r.delta, r.steps) for r in ladder(df, ts="ts").collect()}
    assert got == want and len(want) > 20
    assert streamed.where("fill_delta <> 0 AND fill_price IS NULL").count() == 0


def test_drift_fails_the_batch_and_keeps_the_table(spark, tmp_path):
    schema = "symbol string, date date, close double"
    table, folder = str(tmp_path / "pub"), str(tmp_path / "in")
    spark.createDataFrame([("A", date(2020, 1, 1), 1.0)], schema).write.parquet(table)
    spark.createDataFrame([("A", date(2020, 1, 1), 2.0), ("A", date(2020, 1, 2), 1.0)], schema).coalesce(1).write.parquet(folder)
    query = jobs.stream_guard(stream_of(spark, folder, schema), table, str(tmp_path / "cp"), {"close": 0.002}, {})
    with pytest.raises(Exception, match="drifted"):
        query.awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_published_nulls_do_not_drift(spark, tmp_path):
    """All published values of A are null: its restated row is dropped, its new one appended. B, of which one published value is known, still fails."""
    schema = "symbol string, date date, close double"
    table, folder = str(tmp_path / "pub"), str(tmp_path / "in")
    first, second, third = (date(2020, 1, d) for d in (1, 2, 3))
    spark.createDataFrame([("A", first, None), ("A", second, None), ("B", first, 1.0)], schema).write.parquet(table)
    spark.createDataFrame([("A", first, 2.0), ("A", third, 5.0)], schema).coalesce(1).write.parquet(folder)
    jobs.stream_guard(stream_of(spark, folder, schema), table, str(tmp_path / "cp"), {}, {"close": 1.0}).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(table).collect()} == {("A", first, None), ("A", second, None), ("B", first, 1.0), ("A", third, 5.0)}
    spark.createDataFrame([("B", first, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    query = jobs.stream_guard(stream_of(spark, folder, schema), table, str(tmp_path / "cp"), {"close": 0.002}, {})
    with pytest.raises(Exception, match="drifted"):
        query.awaitTermination()


PAGES = [(i, f"<p>{'é' * i}\r\n</p>") for i in range(1, 200)] + [(200, None), (202, ""), (-1, "x"), (7, "twice"), (None, "nameless")]


def checked_pages(spark, tmp_path, monkeypatch):
    spark.createDataFrame(PAGES, "page_id long, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(writers, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = catalogue.QUERIES["src8_verify_sha256"](spark, str(tmp_path)).collect()
    return sorted(((r.file, r.ok) for r in rows), key=str)


# ids of a page with two rows, or with a null text, have no right digest; a row without id and the file of those without stand alone
CHECKED = sorted([(str(i), i % 3 > 0 and i != 7) for i in range(1, 200)] + [("200", False), ("202", True), ("-1", False), ("7", False), (None, False), ("__HIVE_DEFAULT_PARTITION__", False)], key=str)


def test_a_page_costs_one_file(spark, tmp_path, monkeypatch):
    """Neither a folder nor a checksum file for each page: each was a process to start besides, for its permissions."""
    assert checked_pages(spark, tmp_path, monkeypatch) == CHECKED
    made = list((tmp_path / "files").rglob("*"))
    files = [p for p in made if p.is_file() and "file=" in str(p) and p.suffix == ".txt"]
    assert len(files) == len({i for i, _ in PAGES})
    assert len(made) - len(files) <= 8  # a folder for each task


def test_files_are_the_same_where_only_spark_reaches_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "local_folder", lambda spark, path: None)
    assert checked_pages(spark, tmp_path, monkeypatch) == CHECKED


def test_files_are_hashed_below_a_folder_as_by_sparks_reader(spark, tmp_path, monkeypatch):
    names = ["a.txt", "deep/er/b.txt", "deep/c.csv", "deep/d.TXT", "k=1/_e.txt", "_hidden/f.txt", ".g.txt", "deep/_x=1/h.txt", "deep/i{j}.txt", "deep/l.csv.txt", "_metadata/m.txt", "_metadata.txt",
             "n.txt._COPYING_", "sp ace/o%20é.txt", "big.txt", "empty.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes({"big.txt": bytes(range(256)) * 9000, "empty.txt": b""}.get(n, n.encode()))
    expected = spark.createDataFrame([("a.txt", hashlib.sha256(b"a.txt").hexdigest()), ("empty.txt", "stale"), ("gone.txt", "0")], "file string, sha256 string")

    def got(under):
        return sorted((tuple(r) for r in readers.verify_sha256(spark, str(tmp_path), expected, under=under).collect()), key=str)

    patterns = ["*.txt", "{a,b,l*}.{txt,csv}", "[!a-d]*.txt", "*"]
    by_tasks = [got(p) for p in patterns]
    assert ("a.txt", *[hashlib.sha256(b"a.txt").hexdigest()] * 2, True) in by_tasks[0] and ("gone.txt", "0", None, False) in by_tasks[0]
    monkeypatch.setattr(tables, "local_folder", lambda spark, path: None)
    assert by_tasks == [got(p) for p in patterns]


def test_a_second_attempt_at_a_task_leaves_nothing(spark, tmp_path):
    for name in ("_attempt-1", "_attempt-2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "file=1.txt").write_text("a")
    writers.commit_folder(str(tmp_path / "_attempt-1"), str(tmp_path / "part-00000"))
    writers.commit_folder(str(tmp_path / "_attempt-2"), str(tmp_path / "part-00000"))
    assert [str(p.relative_to(tmp_path)) for p in sorted(tmp_path.rglob("*"))] == ["part-00000", "part-00000/file=1.txt"]
    with pytest.raises(FileNotFoundError):
        writers.commit_folder(str(tmp_path / "gone"), str(tmp_path / "part-00001"))
