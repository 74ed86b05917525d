"""Price series, trades, rates and calendars derived from the driver tables, in Spark and as SQL text.

Each builder reads whole tables; the SQL constants are the same derivations for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.session import settle

INSTRUMENTS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit_price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one bar per (return flag, line status) and ship date; written once, for a query reads its bars several times."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        order.alias("o"), _unit_price().alias("px"), "l_quantity", "l_discount",
    )
    grouped = rows.groupBy("symbol", "date").agg(
        F.min(F.struct("o", "px"))["px"].alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max(F.struct("o", "px"))["px"].alias("close"), F.min("l_discount").alias("_d"), F.sum("l_quantity").alias("volume"),
    )
    return settle(grouped.select(
        "symbol", "date", "open", "high", "low", "close",
        (F.col("close") * (1 - F.col("_d"))).alias("adjusted_close"), "volume", F.lit(1.0).alias("split_factor"),
    ))


BARS = """bars AS (
  SELECT l_returnflag || '-' || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) * (1 - min(l_discount)) AS adjusted_close,
    sum(l_quantity) AS volume, 1.0::DOUBLE AS split_factor
  FROM lineitem GROUP BY 1, 2)"""


def second_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one bar per order priority and order date."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice"
    )
    pair = F.struct("o_orderkey", "o_totalprice")
    return rows.groupBy("symbol", "date").agg(
        F.min(pair)["o_totalprice"].alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max(pair)["o_totalprice"].alias("close"), F.max(pair)["o_totalprice"].alias("adjusted_close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.lit(1.0).alias("split_factor"),
    )


SECOND = """second AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
    arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS close, arg_max(o_totalprice, o_orderkey) AS adjusted_close,
    count(*)::DOUBLE AS volume, 1.0::DOUBLE AS split_factor
  FROM orders GROUP BY 1, 2)"""


def underlying_name(symbol: Column) -> Column:
    """Which F2 series stands behind an F1 symbol."""
    return (
        F.when(symbol.startswith("A"), "1-URGENT").when(symbol.startswith("N"), "2-HIGH").otherwise("3-MEDIUM")
    )


def underlying_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 closes keyed by the F1 symbol that uses them."""
    symbols = (
        table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("symbol")).distinct()
    )
    other = second_bars(spark, sf_dir).select(F.col("symbol").alias("_u"), "date", "adjusted_close")
    return symbols.join(other, underlying_name(F.col("symbol")) == F.col("_u")).drop("_u")


UNDERLYING = """underlying AS (
  SELECT s.symbol, u.date, u.adjusted_close
  FROM (SELECT DISTINCT l_returnflag || '-' || l_linestatus AS symbol FROM lineitem) s
  JOIN second u ON u.symbol = CASE WHEN s.symbol LIKE 'A%' THEN '1-URGENT' WHEN s.symbol LIKE 'N%' THEN '2-HIGH' ELSE '3-MEDIUM' END)"""


def alternate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source for F1: days divisible by 7 are missing, prices drift by a known amount, one symbol disagrees."""
    bars = daily_bars(spark, sf_dir)
    day = F.unix_date("date")
    factor = F.when(F.col("symbol") == "N-O", 1 + (day % 5) * 0.4).otherwise(1 + (day % 3) * 0.00001)
    return bars.where(F.dayofmonth("date") % 7 != 0).select(
        "symbol", "date", "open", "high", "low", "close", (F.col("adjusted_close") * factor).alias("adjusted_close"),
        "volume", "split_factor",
    )


ALTERNATE = """alternate AS (
  SELECT symbol, date, open, high, low, close,
    adjusted_close * CASE WHEN symbol = 'N-O' THEN 1 + (date_diff('day', DATE '1970-01-01', date) % 5) * 0.4::DOUBLE
      ELSE 1 + (date_diff('day', DATE '1970-01-01', date) % 3) * 0.00001::DOUBLE END AS adjusted_close, volume, split_factor
  FROM bars WHERE day(date) % 7 <> 0)"""

TRADE_ORDER = ("o1", "o2", "o3", "o4")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one trade per line item; the four order columns make the time order total."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    money = "decimal(18,6)"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_suppkey") % 3 == 0, "live").otherwise("paper").alias("kind"),
        (F.col("l_partkey") % INSTRUMENTS).alias("instrument"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("l_linenumber") == 7, "sell").otherwise("buy").alias("side"),
        (F.col("l_quantity") * F.when(F.col("l_linenumber") == 7, 5).otherwise(1)).cast(money).alias("quantity"),
        (F.floor(_unit_price() * 100) / 100).cast(money).alias("price"), F.col("l_tax").cast(money).alias("fee"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3"),
        F.col("l_extendedprice").alias("o4"),
    )


TRADES = f"""trades AS (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'live' ELSE 'paper' END AS kind, l_partkey % {INSTRUMENTS} AS instrument,
    CAST(o_orderdate AS DATE) AS date, CASE WHEN l_linenumber = 7 THEN 'sell' ELSE 'buy' END AS side,
    CAST(l_quantity * CASE WHEN l_linenumber = 7 THEN 5 ELSE 1 END AS DECIMAL(18,6)) AS quantity,
    CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,6)) AS price, CAST(l_tax AS DECIMAL(18,6)) AS fee,
    l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


SPLITS = (2.0, 1 / 15, 1 / 20, 1.5, 0.066667, 1.0345678)


def instrument_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing price and split factor per traded instrument and ship date (rare splits, some of them reverse, some no plain fractions, some on four days in a row)."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % INSTRUMENTS).alias("instrument"), F.to_date("l_shipdate").alias("date"),
        F.floor(_unit_price() * 100) / 100,
    ).toDF("instrument", "date", "px")
    days = F.when(F.col("instrument") % 6 >= 4, 103).otherwise(100)
    split = F.dayofyear("date").between(100, days) & (F.year("date") % 3 == F.col("instrument") % 3)
    return rows.groupBy("instrument", "date").agg(F.max("px").alias("close")).withColumn(
        "split_factor", F.when(split, F.element_at(F.array(*[F.lit(f) for f in SPLITS]), (F.col("instrument") % 6 + 1).cast("int"))).otherwise(1.0)
    )


INSTRUMENT_BARS = f"""ibars AS (
  SELECT l_partkey % {INSTRUMENTS} AS instrument, CAST(l_shipdate AS DATE) AS date, max(floor(l_extendedprice / l_quantity * 100) / 100) AS close,
    CASE WHEN dayofyear(CAST(l_shipdate AS DATE)) BETWEEN 100 AND CASE WHEN (l_partkey % {INSTRUMENTS}) % 6 >= 4 THEN 103 ELSE 100 END AND year(CAST(l_shipdate AS DATE)) % 3 = (l_partkey % {INSTRUMENTS}) % 3
      THEN CASE (l_partkey % {INSTRUMENTS}) % 6 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1 / 15::DOUBLE WHEN 2 THEN 1 / 20::DOUBLE WHEN 3 THEN 1.5::DOUBLE WHEN 4 THEN 0.066667::DOUBLE ELSE 1.0345678::DOUBLE END
      ELSE 1.0::DOUBLE END AS split_factor
  FROM lineitem GROUP BY ALL)"""


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation n as currency Cn per order date, stored against C0; every third inverted, every fifth missing."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey > 0 AND n_nationkey % 5 <> 0").select("n_nationkey")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    inverted = F.col("n_nationkey") % 3 == 0
    name = F.concat(F.lit("C"), F.col("n_nationkey"))
    rate = 1 + F.col("n_nationkey") / 10 + F.dayofmonth("date") / 1000
    return days.crossJoin(F.broadcast(nations)).select(
        "date", F.when(inverted, F.lit("C0")).otherwise(name).alias("base"),
        F.when(inverted, name).otherwise(F.lit("C0")).alias("quote"), rate.alias("rate"),
    )


FX = """fx AS (
  SELECT date, CASE WHEN n_nationkey % 3 = 0 THEN 'C0' ELSE 'C' || n_nationkey END AS base,
    CASE WHEN n_nationkey % 3 = 0 THEN 'C' || n_nationkey ELSE 'C0' END AS quote,
    1 + n_nationkey::DOUBLE / 10 + day(date)::DOUBLE / 1000 AS rate
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), nation
  WHERE n_nationkey > 0 AND n_nationkey % 5 <> 0)"""


def currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey")).alias("currency"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trading sessions."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()


CALENDAR = "calendar AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
