"""Writers: immutable snapshots, upserts, absent-only appends, exports."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.quality import _pick
from quoteflow.session import checkpoint_root
from quoteflow.sources import tables
from quoteflow.sources.readers import manifest_json


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/quoteflow-{name}-{uuid.uuid4().hex}"


def publish_snapshot(spark: SparkSession, frames: Mapping[str, DataFrame], root: str, day, manifest: Mapping) -> None:
    """Write every frame below ``root/day``, then the manifest, then move the pointer that readers follow.

    Every write refuses to overwrite, and the pointer moves in one step, so a failed run leaves the snapshot before it in place.
    """
    folder = f"{root}/{day.isoformat()}"
    for name, frame in frames.items():
        frame.write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")
    record = {**manifest, "latest_completed_session": day}
    if not tables.create_text(spark, f"{folder}/manifest.json", manifest_json(record)):
        raise FileExistsError(f"{folder} is published already")
    tables.replace_text(spark, f"{root}/latest.json", manifest_json({"date": day}))


def last_write_wins(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Updates replace target rows of the same key whatever their age."""
    return updates.select(*target.columns).unionByName(target.join(updates.select(*key), list(key), "left_anti"))


BAR_KEY = ("symbol", "date", "source")


def upsert_bars(spark: SparkSession, path: str, updates: DataFrame, key: Sequence[str] = BAR_KEY, writer: str | None = None, batch: int | None = None) -> None:
    """Upsert into a committed table partitioned by ``month`` (:mod:`tables`): only months with updates are read and written anew.

    The old version stays whole until the new one is committed. Of several updates for a key the newest by ``fetched_at`` counts. ``batch``, a number that
    grows by ``writer``, makes a repeated call harmless.
    """
    incoming = _pick(updates.withColumn("month", F.date_format("date", "yyyy-MM")), list(key), F.max_by, F.col("fetched_at"))
    tables.upsert(spark, path, incoming, key, "month", writer, batch)


def read_bars(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """The table of :func:`upsert_bars` at a version, by default the newest."""
    return tables.read(spark, path, at)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_absent(target: DataFrame, new: DataFrame, key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Target plus the new rows whose (symbol, date) it lacks, whatever the source; of several for one the smallest by its columns."""
    return target.unionByName(_one_each(new.select(*target.columns), key).join(target.select(*key), list(key), "left_anti"))


def _one_each(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return _pick(rows, list(key), F.min_by, F.struct(*rest)) if rest else rows.distinct()


def upsert_fx(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Rates by (date, base, quote), updates win; rows of blocked feeds are skipped."""
    usable = updates.where(F.col("status") != "blocked") if "status" in updates.columns else updates
    return last_write_wins(target, usable, ["date", "base", "quote"])


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark in front of the first column name."""
    flat = flat_columns(df)
    first = flat.columns[0]
    flat.withColumnRenamed(first, "﻿" + first).write.option("header", True).option("escape", '"').csv(path)


def export_views(df: DataFrame, path: str, key: str = "symbol") -> None:
    """One folder of JSON per key."""
    df.hint("rebalance", key).write.partitionBy(key).json(path)


def publish_allowed(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only allow-listed columns may leave; an unknown one aborts."""
    unknown = [c for c in df.columns if c not in set(allowed)]
    if unknown:
        raise ValueError(f"columns need review before publishing: {unknown}")
    return df.select(*[c for c in allowed if c in df.columns])


NAMELESS = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of null and empty names
ESCAPED = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""  # as Spark escapes them in folder names


def write_files(df: DataFrame, path: str, end: str) -> None:
    """A file for each name in ``file``, with the ``value`` of each of its rows and ``end`` after each: what :data:`FILE_NAME` finds in a path is its name.

    Spark's writer makes a folder, a file and a checksum file for each, and starts a process for each of them to set its permissions where Hadoop has no
    native library. So in a local (mounted) file system Python tasks write the files, each task into one folder that takes its name when the task is done.
    """
    folder = tables.local_folder(df.sparkSession, path)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in ("file", "value")]).repartition("file")
    if folder is None:
        rows.write.partitionBy("file").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", end).text(path)
        return
    os.makedirs(folder)
    rows.mapInArrow(_file_writer(folder, end.encode()), "files long").write.format("noop").mode("overwrite").save()


FILE_NAME = r"file=([^/]+?)(?:\.txt$|/)"


def _file_writer(folder: str, end: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = f"{folder}/_attempt-{task.taskAttemptId()}"
        os.mkdir(own)
        try:
            for batch in batches:
                for name, value in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                    escaped = re.sub(ESCAPED, lambda c: f"%{ord(c[0]):02X}", name.as_py() or NAMELESS)
                    with open(f"{own}/file={escaped}.txt", "ab") as out:  # rows of a name need not follow each other
                        out.write((value.as_py() or b"") + end)
            commit_folder(own, f"{folder}/part-{task.partitionId():05d}")
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        yield from ()

    return run


def commit_folder(own: str, final: str) -> None:
    """What one attempt at a task has written gets its final name in one step; if another attempt had it first, it is deleted."""
    try:
        os.rename(own, final)
    except OSError:
        if not os.path.isdir(final):
            raise
        shutil.rmtree(own)


def seed_dim(target: DataFrame, rows: DataFrame, key: str = "symbol") -> DataFrame:
    """Add dimension rows whose key is missing; present rows stay as they are; of several for one key the smallest counts."""
    return target.unionByName(_one_each(rows.select(*target.columns), [key]).join(target.select(key), key, "left_anti"))
