"""Registered queries: readers and writers, each comparing what is read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quoteflow.plans import fixtures as fx
from quoteflow.plans.registry import query, r, rounded
from quoteflow.sources import readers as rd
from quoteflow.sources import tables
from quoteflow.sources import writers as wr

KEY = ["symbol", "date"]
COLUMNS = ["open", "high", "low", "close", "adjusted_close", "volume", "split_factor"]
ALL = f"symbol, date, {', '.join(COLUMNS)}"


@query("src1_read_bars_csv", f"WITH {fx.BARS} SELECT {ALL} FROM bars")
def _(spark, sf):
    path = wr.scratch_path(spark, "csv")
    bars = fx.daily_bars(spark, sf)
    # one folder per symbol stands for one file per symbol
    bars.withColumn("file", F.concat("symbol", F.lit("_public_snapshot.csv"))).select("file", "date", *COLUMNS).write.partitionBy("file").option(
        "header", True).csv(path)
    return rd.read_bars_csv(spark, f"{path}/*/*.csv")


@query("src2_bars_from_chart_json", f"""WITH {fx.BARS} SELECT symbol || '/' || year(date) AS symbol, date, open, high, low, close, CASE WHEN year(date) % 2 = 0 THEN close ELSE adjusted_close END AS adjusted_close,
  volume, CASE WHEN dayofyear(date) = 100 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS split_factor FROM bars""")
def _(spark, sf):
    at = F.unix_seconds(F.col("date").cast("timestamp")) + 52200  # 14:30 UTC
    rows = fx.daily_bars(spark, sf).withColumns({"t": at, "symbol": F.concat_ws("/", "symbol", F.year("date").cast("string"))})
    day = F.struct("t", "open", "high", "low", "close", "adjusted_close", "volume", F.dayofyear("date").alias("d"))
    years = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(day)).alias("b"))  # at most 366 bars per payload
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    split_days = F.filter("b", lambda x: x["d"] == 100)
    splits = F.map_from_entries(F.transform(split_days, lambda x: F.struct(
        x["t"].cast("string").alias("k"), F.struct(x["t"].alias("date"), F.lit(3.0).alias("numerator"), F.lit(2.0).alias("denominator")).alias("v"))))
    odd = F.substring_index("symbol", "/", -1).cast("int") % 2 == 1
    adjusted = F.when(odd, F.col("b.adjusted_close"))
    result = F.struct(
        F.struct(F.lit("America/New_York").alias("exchangeTimezoneName")).alias("meta"), F.col("b.t").alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(adjusted.alias("adjclose"))).alias("adjclose")).alias("indicators"),
        F.struct(splits.alias("splits")).alias("events"))
    payload = years.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("json"))
    return rd.bars_from_chart_json(payload, "json")


@query("src3_bars_from_plain_csv", f"WITH {fx.BARS} SELECT symbol, date, open, high, low, close, close AS adjusted_close, volume, 1.0::DOUBLE AS split_factor FROM bars")
def _(spark, sf):
    path = wr.scratch_path(spark, "plain")
    text = fx.daily_bars(spark, sf).select("symbol", F.col("date").cast("string").alias("Date"), *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    # in each file the month comes twice: first with stale prices, then as it is
    stale = text.withColumns({"Close": F.lit("1"), "_turn": F.lit(0)})
    both = stale.unionByName(text.withColumn("_turn", F.lit(1))).withColumn("file", F.concat_ws("_", "symbol", F.substring("Date", 1, 4)))
    both.repartition("file").sortWithinPartitions("file", "_turn", "Date").drop("_turn").write.partitionBy("file").option("header", True).csv(path)
    return rd.bars_from_plain_csv(rd.read_plain_csv(spark, f"{path}/*/*.csv"))


LINK = r'<a href="([^"<>]*)">([^<]*)</a>'


@query("src4_extract_records", f"""SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS target, unnest(regexp_extract_all(html, '{LINK}', 2)) AS label,
  (unnest(range(len(regexp_extract_all(html, '{LINK}', 0)))))::INT AS match_no FROM pages""")
def _(spark, sf):
    return rd.extract_records(fx.table(spark, sf, "pages"), "html", LINK, ["target", "label"], ["page_id"])


def history_pages(spark, sf):
    """History pages in the public format, one per symbol and month, with an identity line."""
    number = lambda c: F.col(c).cast("string")
    record = F.concat(
        F.lit("{a:"), number("adjusted_close"), F.lit(",c:"), number("close"), F.lit(",h:"), number("high"), F.lit(",l:"), number("low"), F.lit(",o:"), number("open"),
        F.lit(',t:"'), F.col("date").cast("string"), F.lit('",v:'), number("volume"), F.lit(",ch:0.1}"))
    month = F.date_format("date", "yyyyMM")
    rows = fx.daily_bars(spark, sf).select(F.concat_ws("/", "symbol", month).alias("symbol"), "date", record.alias("rec"))
    pages = rows.groupBy("symbol").agg(F.concat_ws(",", F.array_sort(F.collect_list("rec"))).alias("body"))  # at most 31 records per page
    declared = F.when(F.col("symbol").endswith("07"), "OTHER").otherwise(F.lower("symbol"))
    return pages.select("symbol", F.concat(F.lit('<script>data:{id:7,symbol:"'), declared, F.lit('",source:"x"},rows:['), F.col("body"), F.lit("]</script>")).alias("html"))


@query("src4_history_records", f"""WITH {fx.BARS} SELECT symbol || '/' || strftime(date, '%Y%m') AS symbol, date, {', '.join(COLUMNS)} FROM bars WHERE date BETWEEN DATE '1996-03-15' AND DATE '2000-10-10'""")
def _(spark, sf):
    bars, _problems = rd.history_records(history_pages(spark, sf), "html", "1996-03-15", "2000-10-10")
    return bars


@query("src5_require_identity", f"""WITH {fx.BARS} SELECT DISTINCT symbol || '/' || strftime(date, '%Y%m') AS symbol, CASE WHEN month(date) = 7 THEN 'OTHER' ELSE lower(symbol) || '/' || strftime(date, '%Y%m') END AS page_symbol,
  month(date) <> 7 AS identity_ok FROM bars""")
def _(spark, sf):
    return rd.require_identity(history_pages(spark, sf), "html").drop("html")


# Trade files, one for each 8,192 order keys: notes with quotes and line breaks, blank lines nowhere counted; sells that exceed the committed holdings, unknown
# symbols, empty kinds and times that are no ISO times are errors.
@query("src6_import_errors", f"""WITH {fx.TRADES}, t AS (SELECT instrument, kind, side, quantity, o1, o2, row_number() OVER (PARTITION BY o1 // 8192 ORDER BY o1, o2, o3, o4) + 1 AS line FROM trades),
e AS (SELECT *, CASE WHEN o1 % 97 = 5 THEN '' ELSE kind END AS k FROM t)
SELECT (o1 // 8192)::BIGINT AS part, line, 'unknown symbol' AS error FROM e WHERE instrument = 19
UNION ALL SELECT o1 // 8192, line, 'sell exceeds holdings' FROM e WHERE side = 'sell' AND quantity > CASE WHEN instrument = 19 OR k = '' THEN 0 ELSE instrument * 10 END
UNION ALL SELECT o1 // 8192, line, 'invalid portfolio_kind' FROM e WHERE k = '' UNION ALL SELECT o1 // 8192, line, 'invalid executed_at' FROM e WHERE o1 % 89 = 7""")
def _(spark, sf):
    path = wr.scratch_path(spark, "trades")
    note = F.when(F.col("o1") % 5 == 0, F.lit('a "quoted", note\n\nover three lines')).otherwise("plain")
    rows = fx.trades(spark, sf).select(
        F.concat(F.lit("s"), F.col("instrument")).alias("symbol"), F.when(F.col("o1") % 97 == 5, "").otherwise(F.col("kind")).alias("portfolio_kind"), "side",
        *[F.col(c).cast("string").alias(c) for c in ("quantity", "price", "fee")],
        F.when(F.col("o1") % 89 == 7, "2024").otherwise(F.concat(F.col("date").cast("string"), F.lit("T10:00:00"))).alias("executed_at"), note.alias("note"), *fx.TRADE_ORDER)
    rows = rows.withColumn("part", F.floor(F.col("o1") / 8192))
    # every file is written by one task in its order
    sorted_rows = rows.repartition("part").sortWithinPartitions("part", *fx.TRADE_ORDER).drop(*fx.TRADE_ORDER)
    sorted_rows.write.partitionBy("part").options(header=True, escape='"', emptyValue="").csv(path)
    numbers = spark.range(19)
    instruments = numbers.select(F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.col("id").alias("instrument"), F.lit("USD").alias("currency"))
    kinds = F.explode(F.array(F.lit("paper"), F.lit("live"))).alias("kind")
    holdings = numbers.select(kinds, F.col("id").alias("instrument"), (F.col("id") * 10).cast("decimal(18,6)").alias("quantity"))
    _accepted, errors = rd.import_trades(spark, f"{path}/*/*.csv", instruments, holdings)
    return errors.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), "line", "error")


def _snapshots(spark, sf):
    root = wr.scratch_path(spark, "snapshots")
    bars = fx.daily_bars(spark, sf)
    for day in (date(1999, 12, 31), date(2000, 12, 31)):
        manifest = {"strategy_version": "v1", "frozen_cutoff": date(1999, 6, 30), "symbols": ["A-F", "N-O"], "source_by_symbol": {"A-F": "public"},
                    "audit": {"A-F": {"adjustment_factor": 1.5, "new_rows": 3, "preserved_through": date(1999, 6, 30)}}}
        wr.publish_snapshot(spark, {"bars": bars.where(F.col("date") <= F.lit(day))}, root, day, manifest)
    # a later run that failed between its manifest and the pointer
    unfinished = rd.manifest_json({**manifest, "latest_completed_session": date(2001, 1, 31)})
    tables.create_text(spark, f"{root}/2001-01-31/manifest.json", unfinished)
    return root


@query("src7_snk1_active_snapshot", f"""WITH {fx.BARS} SELECT symbol, count(*) AS bars, max(date) AS last_date, DATE '2000-12-31' AS snapshot_date, true AS consistent FROM bars WHERE date <= DATE '2000-12-31' GROUP BY 1""")
def _(spark, sf):
    root = _snapshots(spark, sf)
    active = rd.active_snapshot(spark, root)
    rows = spark.read.schema("symbol STRING, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rd.BAR_SCHEMA)).option("header", True).csv(f"{root}/2000-12-31/bars")
    counted = rd.upto_cutoff(rows, active).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_date"))
    return counted.join(F.broadcast(active.select("snapshot_date", "consistent")))


@query("src8_verify_sha256", "SELECT CAST(page_id AS VARCHAR) AS file, sha256(html) = sha256(html) AND page_id % 3 > 0 AS ok FROM pages")
def _(spark, sf):
    path = wr.scratch_path(spark, "files")
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file"), "html")
    wr.write_files(pages.select("file", F.col("html").alias("value")), path, "\u0000")
    expected = pages.select("file", F.when(F.col("file").cast("int") % 3 > 0, F.sha2(F.concat("html", F.lit("\u0000")), 256)).otherwise("stale").alias("sha256"))
    files = rd.verify_sha256(spark, path, expected, name=wr.FILE_NAME, under="*.txt")
    return files.select("file", "ok")


UPDATES = f"""{fx.BARS}, base AS (SELECT symbol, date, 'yahoo' AS source, close FROM bars WHERE date < DATE '2000-01-01'),
upd AS (SELECT symbol, date, CASE WHEN day(date) % 2 = 0 THEN 'yahoo' ELSE 'stooq' END AS source, close * 2 AS close FROM bars WHERE date >= DATE '1999-06-15')"""


def _tables(spark, sf):
    bars = fx.daily_bars(spark, sf)
    stamp = F.lit("2002-01-01").cast("timestamp")
    base = bars.where("date < DATE'2000-01-01'").select(*KEY, F.lit("yahoo").alias("source"), "close", stamp.alias("fetched_at"))
    source = F.when(F.dayofmonth("date") % 2 == 0, "yahoo").otherwise("stooq")
    upd = bars.where("date >= DATE'1999-06-15'").select(*KEY, source.alias("source"), (F.col("close") * 2).alias("close"), stamp.alias("fetched_at"))
    return base, upd


@query("snk2_upsert_bars", f"WITH {UPDATES} SELECT * FROM upd UNION ALL SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.symbol = b.symbol AND u.date = b.date AND u.source = b.source)")
def _(spark, sf):
    path = wr.scratch_path(spark, "table")
    base, upd = _tables(spark, sf)
    wr.upsert_bars(spark, path, base)
    wr.upsert_bars(spark, path, upd)
    return wr.read_bars(spark, path).select(*KEY, "source", "close")


@query("snk3_append_absent", f"WITH {UPDATES} SELECT * FROM base UNION ALL SELECT * FROM upd u WHERE NOT EXISTS (SELECT 1 FROM base b WHERE u.symbol = b.symbol AND u.date = b.date)")
def _(spark, sf):
    base, upd = _tables(spark, sf)
    return wr.append_absent(base.drop("fetched_at"), upd)


@query("snk4_upsert_fx", f"""WITH {fx.FX}, u AS (SELECT date, base, quote, rate + 1 AS rate FROM fx WHERE day(date) % 2 = 0 AND NOT (base = 'C0' AND day(date) % 4 = 0))
SELECT date, base, quote, {r('rate', 'rate', 8)} FROM u UNION ALL SELECT date, base, quote, {r('rate', 'rate', 8)} FROM fx f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.date = f.date AND u.base = f.base AND u.quote = f.quote)""")
def _(spark, sf):
    rates = fx.fx_rates(spark, sf)
    day = F.dayofmonth("date")
    updates = rates.where(day % 2 == 0).withColumns({
        "rate": F.col("rate") + 1, "status": F.when((F.col("base") == "C0") & (day % 4 == 0), "blocked").otherwise("ok")})
    return rounded(wr.upsert_fx(rates, updates), 8, "rate")


@query("snk5_export_csv", f"""WITH {fx.BARS} SELECT symbol, date::VARCHAR AS date, volume AS positions_volume FROM bars""")
def _(spark, sf):
    path = wr.scratch_path(spark, "export")
    nested = F.create_map(F.col("symbol"), F.struct(F.col("volume").alias("volume")))
    wr.export_csv(fx.daily_bars(spark, sf).select(*KEY, "close", nested.alias("positions")), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    first = back.columns[0]
    parsed = F.from_json("positions", "MAP<STRING,STRUCT<volume:DOUBLE>>")
    return back.withColumnRenamed(first, "symbol").select("symbol", "date", parsed[F.col("symbol")]["volume"].alias("positions_volume"))


@query("snk6_export_views", f"WITH {fx.BARS} SELECT symbol, date, close, volume FROM bars")
def _(spark, sf):
    path = wr.scratch_path(spark, "views")
    wr.export_views(fx.daily_bars(spark, sf).select(*KEY, "close", "volume"), path)
    return spark.read.schema("date DATE, close DOUBLE, volume DOUBLE, symbol STRING").json(path)


@query("snk7_publish_allowed", f"WITH {fx.BARS} SELECT symbol, date, close FROM bars")
def _(spark, sf):
    return wr.publish_allowed(fx.daily_bars(spark, sf).select(*KEY, "close"), ["symbol", "date", "close", "score"])


@query("snk8_seed_dim", """SELECT c_custkey AS symbol, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1""")
def _(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"))
    return wr.seed_dim(customers.where("symbol % 2 = 0"), customers.withColumn("name", F.lit("new")))
