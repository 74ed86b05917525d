"""URL filters by hash prefixes: each URL becomes host-suffix and path-prefix expressions, an equi-join on a short hash prefix
finds candidate rules, full digests confirm them, and the longest rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: hex digits of a digest that are joined on; more of them mean fewer false candidates
PREFIX = 8


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule, verdict.

    rules: verdict ('block' or 'allow'), host, path; a rule fits its host and all subdomains, if the path starts with the rule's. Of several the
    longest wins (host and path together), then the longer host, then block. Null URLs and such without :// have an empty host
    and path; repeated rows give repeated rows; rules with a null or empty host fit nothing; without rules every page gets `otherwise`."""
    rules = rules.select(F.col("verdict"), F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    named = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))
    digest = F.sha2("rule", 256)
    listed = named.select("verdict", "rule", "host_length", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"))
    shapes = named.select("labels", "path_length").distinct().agg(F.collect_set(F.struct("labels", "path_length")).alias("shapes"))  # one row

    parts = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffix = lambda n: F.array_join(F.slice("labels", -n, n), ".")
    fitting = F.filter("shapes", lambda s: (s["labels"] <= F.size("labels")) & (s["path_length"] <= F.length("path")) & (F.col("host") != ""))
    asked = F.transform(fitting, lambda s: F.concat(suffix(s["labels"]), F.substring(F.col("path"), F.lit(1), s["path_length"])))
    expanded = parts.withColumn("labels", labels).join(F.broadcast(shapes)).select("row", "id", "host", "path", F.explode_outer(asked).alias("asked"))
    expanded = expanded.withColumn("full", F.sha2("asked", 256)).withColumn("prefix", F.substring("full", 1, PREFIX)).drop("asked")
    met = expanded.join(listed, "prefix", "left")
    better = F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("verdict") == "block").alias("c"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    best = met.groupBy("row", "id", "host", "path").agg(F.max(F.when(F.col("full") == F.col("digest"), better)).alias("best"))
    return best.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
