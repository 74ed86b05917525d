"""Readers: bar snapshots, chart payloads, plain delimited bars, records inside pages, trade files, published snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.quality import clean_bars
from quoteflow.operators.timeline import running
from quoteflow.sources import tables

BAR_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close", "volume", "split_factor")]
)
INPUT_SCHEMA = "date DATE, close DOUBLE, open DOUBLE, score DOUBLE, score_rank DOUBLE, score_partial_rank DOUBLE, raw_close DOUBLE"
# File name of a snapshot, one record of a public history page, the page's own symbol.
SNAPSHOT_NAME = r"([^/=]+?)_(?:public_|benchmark_)?snapshot\.csv"
HISTORY_RECORD = (
    r"\{a:([^,{}]+),c:([^,{}]+),h:([^,{}]+),l:([^,{}]+),o:([^,{}]+),"
    r't:"(\d{4}-\d{2}-\d{2})",v:([^,{}]+),ch:[^{}]+\}'
)
HISTORY_FIELDS = ("adjusted_close", "close", "high", "low", "open", "date", "volume")
PAGE_IDENTITY = r'data:\{id:\d+,symbol:"([^"]+)",source:"([^"]+)"'


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one per symbol; the symbol comes from the file name."""
    rows = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_NAME, 1).alias("symbol"), *BAR_SCHEMA.fieldNames())


QUOTES = "STRUCT<open:ARRAY<DOUBLE>,high:ARRAY<DOUBLE>,low:ARRAY<DOUBLE>,close:ARRAY<DOUBLE>,volume:ARRAY<DOUBLE>>"
CHART_SCHEMA = f"""STRUCT<chart:STRUCT<result:ARRAY<STRUCT<meta:STRUCT<exchangeTimezoneName:STRING>,timestamp:ARRAY<BIGINT>,
indicators:STRUCT<quote:ARRAY<{QUOTES}>,adjclose:ARRAY<STRUCT<adjclose:ARRAY<DOUBLE>>>>,
events:STRUCT<splits:MAP<STRING,STRUCT<date:BIGINT,numerator:DOUBLE,denominator:DOUBLE>>>>>>>"""


def bars_from_chart_json(df: DataFrame, column: str, key: str = "symbol") -> DataFrame:
    """Chart payloads to bars: parallel arrays zipped, exchange-local dates, split events joined on the date.

    Split events sit in the same payload as the bars they belong to, so they are matched inside the row.
    """
    parsed = df.select(key, F.from_json(column, CHART_SCHEMA).alias("_j")).select(key, F.get(F.col("_j.chart.result"), F.lit(0)).alias("_r"))
    quote = F.get(F.col("_r.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("_r.indicators.adjclose"), F.lit(0))["adjclose"]
    zone = F.coalesce(F.col("_r.meta.exchangeTimezoneName"), F.lit("UTC"))
    local = lambda seconds: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), F.col("_zone")))
    fields = parsed.select(
        key, zone.alias("_zone"), F.map_values("_r.events.splits").alias("_splits"),
        F.col("_r.timestamp").alias("t"), *[quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.when(F.size(adjusted) > 0, adjusted).otherwise(quote["close"]).alias("adjusted_close"),
    )
    names = ("t", "open", "high", "low", "close", "volume", "adjusted_close")
    rows = fields.select(key, "_zone", "_splits", F.posexplode(F.arrays_zip(*names)).alias("_i", "_b"))
    rows = rows.select(key, "_zone", "_splits", "_i", local(F.col("_b.t")).alias("date"), *[F.col("_b")[c].alias(c) for c in names[1:]])
    same_day = F.filter("_splits", lambda s: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(s["date"]), F.col("_zone"))) == F.col("date"))
    last = F.try_element_at(same_day, F.lit(-1))
    factor = F.coalesce(F.coalesce(last["numerator"], F.lit(1.0)) / F.coalesce(last["denominator"], F.lit(1.0)), F.lit(1.0))
    bars = rows.withColumn("split_factor", factor)
    return clean_bars(bars.drop("_zone", "_splits"), "_i", key).select(key, *BAR_SCHEMA.fieldNames())


def bars_from_plain_csv(df: DataFrame, key: str = "symbol", order_col: str | None = None) -> DataFrame:
    """Delimited bars with any header case; adjusted price = close, split = 1; the last row by ``order_col`` counts for a date.

    Without ``order_col`` the frame must come from :func:`read_plain_csv`, which numbers the rows as they stand in their files.
    """
    rows = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    rows = rows.withColumns({"date": F.to_date("date"), "adjusted_close": F.col("close"), "split_factor": F.lit(1.0)})
    return clean_bars(rows, order_col or "_seq", key).select(key, *BAR_SCHEMA.fieldNames())


def read_plain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with a header as text columns, their file and their input order in it (``_seq``, numbered as the file is scanned)."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_seq"))


def extract_records(pages: DataFrame, text: str, pattern: str, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per match of ``pattern`` in the whole text, one string column per group."""
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("match_no", "_m"))
    groups = [F.regexp_extract("_m", pattern, i + 1).alias(name) for i, name in enumerate(fields)]
    return found.select(*keep, "match_no", *groups)


def history_records(pages: DataFrame, text: str, start, end, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(bars, problems) of history pages: invalid numbers, duplicate dates or no record in range make a page unusable."""
    raw = extract_records(pages, text, HISTORY_RECORD, HISTORY_FIELDS, [key])
    numbers = [c for c in HISTORY_FIELDS if c != "date"]
    rows = raw.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in numbers}).withColumn("date", F.expr("try_cast(date AS date)"))
    bad = F.lit(False)
    for c in (*numbers, "date"):
        bad = bad | F.col(c).isNull()
    inside = F.col("date").isNull() | F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = rows.where(inside).withColumn("_bad", bad)
    days = rows.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_bad").alias("_b"))
    found = days.groupBy(key).agg(F.count_if(F.col("_n") > 1).alias("duplicate_dates"), F.sum("_b").alias("invalid_records"))
    table = pages.select(key).distinct().join(found, key, "left")
    problem = (
        F.when(F.col("invalid_records").isNull(), "no_records").when(F.col("invalid_records") > 0, "invalid_number")
        .when(F.col("duplicate_dates") > 0, "duplicate_date")
    )
    problems = table.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(key, "problem")
    bars = rows.join(problems, key, "left_anti").withColumn("split_factor", F.lit(1.0))
    return clean_bars(bars.drop("_bad"), "match_no", key).select(key, *BAR_SCHEMA.fieldNames()), problems


def require_identity(pages: DataFrame, text: str, requested: str = "symbol") -> DataFrame:
    """Add the page's own symbol and whether it is the requested one."""
    own = F.nullif(F.regexp_extract(text, PAGE_IDENTITY, 1), F.lit(""))
    same = F.coalesce(F.upper(own) == F.upper(requested), F.lit(False))
    return pages.withColumns({"page_symbol": own, "identity_ok": same})


# --- trade import --------------------------------------------------------------------------------------------

ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _quoted_fields(record: Column) -> Column:
    """Fields of one delimited record, quotes removed: null where empty and not quoted. Separators count outside quotes only, which are every other
    stretch between quotes."""
    parts = F.split(record, '"')
    marked = F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 0, F.translate(part, ",", "\x01")).otherwise(part)), '"')
    bare = lambda f: F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    quoted = F.transform(F.split(marked, "\x01"), lambda f: F.when(f.startswith('"'), bare(f)).when(f != "", f))
    # most records have no quotes
    return F.when(record.contains('"') | record.contains("\x01"), quoted).otherwise(F.transform(F.split(record, ","), lambda f: F.nullif(f, F.lit(""))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of delimited files of any size: file, line (record number; blank lines outside quotes do not count), record, header, the file's first, and
    names, its fields, null where they are empty or repeated.

    A file is read in blocks by many tasks. A line of text ends a record where an even number of quotes lies behind it, and how many lie before a block
    is not known inside it; so each block counts its records for both cases, a running sum over the blocks of a file tells which holds, and where its
    numbers begin. Only records that stretch over several lines are put together by another shuffle. Quotes stand in quoted values only, doubled.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = text.select(
        file.alias("file"), block.alias("block"), F.xxhash64(file, block).alias("block_id"), F.monotonically_increasing_id().alias("at"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"), F.col("value").rlike("[^\\r\\t\ufeff ]").alias("filled"),
    )
    # the number in front spares comparing the paths of other blocks
    inside = Window.partitionBy("block_id", "file", "block").orderBy("at")
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    filled = F.col("filled")
    starts = {f"starts{case}": F.sum(((F.col("odd") == case) & filled).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for case in (0, 1)}
    lines = lines.withColumns(starts)
    # one row a block
    heading = F.when((F.col("block") == 0) & (F.col("starts0") == 1), F.struct("block", "at", "value"))
    blocks = lines.groupBy("block_id", "file", "block").agg(F.sum("quotes").alias("quotes"), F.max("starts0").alias("n0"), F.max("starts1").alias("n1"), F.when((F.col("block") == 0) & (F.max("starts0") > 0), _joined(heading)).alias("header"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("case", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("case") == 0, F.col("n0")).otherwise(F.col("n1"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    # the header stands in the first block; a file without one has no records
    blocks = blocks.withColumn("header", F.first(F.when(F.col("block") == 0, F.col("header"))).over(earlier.rowsBetween(Window.unboundedPreceding, 0))).where("header IS NOT NULL")
    table = blocks.select("block_id", "file", "block", "case", "base", "header", _header_names(F.col("header")).alias("names"))
    placed = lines.join(table, ["block_id", "file", "block"]).select(
        "file", "block", "at", "value", "quotes", "filled", "header", "names", ((F.col("odd") + F.col("case")) % 2).alias("open"),
        (F.col("base") + F.when(F.col("case") == 0, F.col("starts0")).otherwise(F.col("starts1"))).alias("line"),
    )
    whole = (F.col("open") == 0) & (F.col("quotes") % 2 == 0)
    single = placed.where(whole & filled).select("file", "line", F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("record"), "header", "names")
    several = placed.where(~whole).groupBy("file", "line").agg(_joined().alias("record"), F.first("header").alias("header"), F.first("names").alias("names"))
    return single.unionByName(several)


def _header_names(header: Column) -> Column:
    names = F.transform(_quoted_fields(F.regexp_replace(header, "^\ufeff", "")), lambda c: F.coalesce(F.trim(c), F.lit("")))
    return F.transform(names, lambda name, i: F.when((name != "") & (F.array_position(names, name) == i + 1), name))


def _joined(line: Column | None = None) -> Column:
    """The lines of a record in their order; null ones are left out."""
    lines = F.array_sort(F.collect_list(F.struct("block", "at", "value") if line is None else line))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: x["value"]), "\n"), "\r$", "")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Records of delimited files: file, line (see :func:`read_records`; the header is 1) and ``fields``, a map by the file's own header of any width.

    Quoted values may hold separators and line breaks. Fields beyond the header are dropped, missing ones are null; of equal names the first counts.
    """
    rows = read_records(spark, path).where("line > 1")
    # side by side: a column that a lambda names is computed again for every element
    named = F.zip_with("names", _quoted_fields(F.col("record")), lambda name, value: F.struct(name.alias("name"), value.alias("value")))
    return rows.select("file", "line", F.map_from_entries(F.filter(named, lambda e: e["name"].isNotNull())).alias("fields"))


TRADE_COLUMNS = ("symbol", "portfolio_kind", "side", "quantity", "price", "fee", "currency", "executed_at", "note")


def parse_trades(records: DataFrame) -> DataFrame:
    """Records with the trade fields as text columns, and ``_given``, the names in the file's header."""
    return records.select("file", "line", F.map_keys("fields").alias("_given"), *[F.col("fields")[c].alias(c) for c in TRADE_COLUMNS])


def validate_trades(rows: DataFrame, instruments: DataFrame, holdings: DataFrame, mode: str = "committed") -> DataFrame:
    """Typed trades with an ``errors`` array per row.

    ``instruments``: symbol, instrument, currency. ``holdings``: kind, instrument, quantity already committed. In mode
    ``committed`` a sell is compared with those only; ``running`` also counts the file's earlier rows. A file without a portfolio_kind column
    holds live trades; an empty kind in a file that has one is an error. Times must be ISO dates or date-times.
    """
    if mode not in ("committed", "running"):
        raise ValueError("mode must be committed or running")
    has = lambda c: F.lit(c in rows.columns) if "_given" not in rows.columns else F.array_contains("_given", c)
    have = lambda c, default=None: F.col(c) if c in rows.columns else F.lit(default)
    money = "decimal(18,6)"
    cast = lambda c, kind: F.expr(f"try_cast({c} AS {kind})") if c in rows.columns else F.lit(None).cast(kind)
    typed = rows.select(
        "file", "line", F.upper("symbol").alias("symbol"), F.when(has("portfolio_kind"), F.coalesce("portfolio_kind", F.lit(""))).otherwise("live").alias("kind"), F.lower("side").alias("side"),
        cast("quantity", money).alias("quantity"), cast("price", money).alias("price"),
        F.when(F.coalesce(have("fee"), F.lit("")) == "", F.lit(0).cast(money)).otherwise(cast("fee", money)).alias("fee"),
        have("currency").alias("_currency"), F.when(F.col("executed_at").rlike(ISO_TIME), cast("executed_at", "timestamp")).alias("executed_at"), F.coalesce(have("note"), F.lit("")).alias("note"),
    )
    joined = typed.join(instruments.select("symbol", "instrument", F.col("currency").alias("_own")), "symbol", "left")
    joined = joined.join(holdings.select("kind", "instrument", F.col("quantity").alias("_held")), ["kind", "instrument"], "left")
    held = F.coalesce("_held", F.lit(0).cast(money))
    if mode == "running":
        usable = joined.where(F.col("instrument").isNotNull() & F.col("quantity").isNotNull())
        signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("decimal(38,6)")
        walked = running(usable.select("file", "line", "kind", "instrument", signed.alias("_s")), ["kind", "instrument"], "line", _sum=("sum", F.col("_s")))
        joined = joined.join(walked.select("file", "line", (F.col("_sum") - F.col("_s")).alias("_moved")), ["file", "line"], "left")
        held = held + F.coalesce("_moved", F.lit(0).cast(money))
    errors = F.array_compact(F.array(
        F.when(F.col("instrument").isNull(), "unknown symbol"),
        F.when(~F.col("kind").isin("paper", "live"), "invalid portfolio_kind"),
        F.when(F.col("side").isNull() | ~F.col("side").isin("buy", "sell"), "invalid side"),
        F.when(F.col("quantity").isNull(), "invalid quantity").when(F.col("quantity") <= 0, "quantity must be positive"),
        F.when(F.col("price").isNull(), "invalid price"), F.when(F.col("fee").isNull(), "invalid fee"),
        F.when(F.col("executed_at").isNull(), "invalid executed_at"),
        F.when((F.col("side") == "sell") & (F.col("quantity") > held), "sell exceeds holdings"),
    ))
    return joined.select(
        "file", "line", "symbol", "instrument", "kind", "side", "quantity", "price", "fee",
        F.coalesce(F.when(F.col("_currency") != "", F.col("_currency")), F.col("_own")).alias("currency"), "executed_at", "note", errors.alias("errors"),
    )


def import_trades(spark: SparkSession, path: str, instruments: DataFrame, holdings: DataFrame, mode: str = "committed") -> tuple[DataFrame, DataFrame]:
    """(trades, errors) of a trade file, all or nothing: any error empties the trades."""
    checked = validate_trades(parse_trades(read_trades(spark, path)), instruments, holdings, mode)
    wrong = checked.where(F.size("errors") > 0)
    errors = wrong.select("file", "line", F.explode("errors").alias("error"))
    failed = wrong.agg(F.count(F.lit(1)).alias("_bad"))
    accepted = checked.join(F.broadcast(failed)).where("_bad = 0").drop("_bad", "errors")  # a single row
    return accepted, errors


# --- published snapshots -------------------------------------------------------------------------------------

AUDIT = "STRUCT<adjustment_factor:DOUBLE,overlap_price_relative_error:DOUBLE,overlap_score_absolute_error:DOUBLE,continuity_factor:DOUBLE,preserved_through:DATE,new_rows:INT,source_url:STRING>"
MANIFEST_SCHEMA = (
    "strategy_version STRING, frozen_cutoff DATE, latest_completed_session DATE, market_last_completed_session DATE, captured_at_utc TIMESTAMP, "
    f"provider STRING, source_by_symbol MAP<STRING,STRING>, previous_snapshot DATE, symbols ARRAY<STRING>, audit MAP<STRING,{AUDIT}>"
)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all committed snapshots below ``root`` (only a committed one has a manifest)."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(f"{root}/*/manifest*")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})/manifest", 1)
    return rows.withColumn("snapshot_date", F.to_date(folder))


def pointed_snapshot(manifests: DataFrame, pointer: DataFrame) -> DataFrame:
    """The manifest that the pointer (one row, ``date``) names, and whether pointer, folder and manifest agree; the folder is missing where it is null."""
    named = pointer.select(F.col("date").alias("snapshot_date"))
    chosen = named.join(manifests, "snapshot_date", "left")
    return chosen.withColumn("consistent", F.col("latest_completed_session").eqNullSafe(F.col("snapshot_date")))


def active_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot: the one that the pointer names, though newer folders may be there whose publishing failed."""
    pointer = spark.read.schema("date DATE").json(f"{root}/latest.json")
    return pointed_snapshot(read_manifests(spark, root), pointer)


def upto_cutoff(rows: DataFrame, snapshot: DataFrame, ts: str = "date") -> DataFrame:
    """Rows not after the active snapshot's date (one row, so it is broadcast)."""
    cut = snapshot.select(F.col("snapshot_date").alias("_cut"))
    return rows.join(F.broadcast(cut), F.col(ts) <= F.col("_cut")).drop("_cut")


def verify_sha256(spark: SparkSession, path: str, expected: DataFrame, name: str = r"([^/]+)$", under: str | None = None) -> DataFrame:
    """File name, digest and whether it is the expected one; ``expected`` has file and sha256, ``name`` reads it from the path.

    With ``under`` the files are those of that pattern in all folders below ``path``. Where that is a folder of the local (mounted) file system, tasks list
    and read them, and the driver holds none of their names; elsewhere, and without ``under``, Spark's reader does."""
    folder = tables.local_folder(spark, path) if under is not None else None
    if folder is not None and os.path.isdir(folder):
        found = _local_digests(spark, folder, under)
    else:
        found = spark.read.format("binaryFile")
        if under is not None:
            found = found.option("recursiveFileLookup", True).option("pathGlobFilter", under)
        found = found.load(path).select("path", F.sha2("content", 256).alias("actual"))
    files = found.select(F.regexp_extract("path", name, 1).alias("file"), "actual")
    both = expected.join(files, "file", "full_outer")
    return both.withColumn("ok", F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)))


def _local_digests(spark: SparkSession, folder: str, under: str) -> DataFrame:
    """path and actual (SHA-256) of the files below a folder whose names match, without those that Spark's readers leave out: hidden and empty ones."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(under).compiled().pattern()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    top = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path"))
    # one task lists the first level, many what is below it; then the files are dealt out evenly
    level = top.mapInArrow(_listing(pattern, False), "path string").repartition(tasks)
    files = level.mapInArrow(_listing(pattern, True), "path string").repartition(tasks)
    return files.mapInArrow(_digests, "path string, actual string")


BLOCK = 4096  # names in a batch


def _listing(pattern: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files stay, folders become the matching files and the folders in them, with ``deep`` all matching files below them."""
    wanted = re.compile(pattern, re.DOTALL)

    def entries(folder: str) -> Iterator[str]:
        with os.scandir(folder) as found:
            for entry in found:
                hidden = re.match(r"\.|_(?!.*=)|.*\._COPYING_$", entry.name, re.DOTALL)
                if not entry.is_dir():
                    if not hidden and wanted.fullmatch(entry.name):
                        yield entry.path
                elif hidden and not entry.name.startswith(("_metadata", "_common_metadata")):
                    continue
                elif deep:
                    yield from entries(entry.path)
                else:
                    yield entry.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for name in entries(path) if os.path.isdir(path) else (path,):
                    names.append(name)
                    if len(names) == BLOCK:
                        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})
                        names = []
        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path as Spark writes it and the SHA-256 of each file, read in blocks of 1 MiB."""
    for batch in batches:
        found = {}
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with open(path, "rb", buffering=0) as file:
                while block := file.read(1 << 20):
                    digest.update(block)
                if file.tell():
                    found[f"file:{path}"] = digest.hexdigest()
        yield pa.RecordBatch.from_pydict({"path": pa.array(found.keys(), pa.string()), "actual": pa.array(found.values(), pa.string())})


def manifest_json(values: Mapping) -> str:
    return json.dumps(values, ensure_ascii=False, default=lambda v: v.isoformat() if isinstance(v, date) else str(v))
