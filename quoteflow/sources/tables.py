"""A committed Parquet table: immutable files by commit, and a log whose newest entry names the folder of each partition.

A writer writes new files beside the old ones and then creates the next entry of the log. Creating fails if the entry exists, so of two writers that began
at the same version one commits and the other has a :class:`CommitConflict`; one that fails earlier leaves files that no entry names. A reader keeps to the
version that it began with, whatever is committed meanwhile. An entry has one line per partition and the last batch of each writer, by which a batch
that is delivered again is known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "_commit"


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """An entry of the log: the commit that holds each partition, and the last batch of each writer."""

    number: int = -1
    partitions: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at, jvm


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as Python's ``open`` takes it where it is in the local (on a cluster, mounted) file system, None where only Spark reaches it."""
    files, at, _ = _file_system(spark, path)
    return at.toUri().getPath() if files.getUri().getScheme() == "file" else None


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    files, at, _ = _file_system(spark, path)
    try:
        stream = files.create(at, False)
    except Exception as error:  # the file system says in its own classes that the file is there
        if files.exists(at):
            return False
        raise error
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it at the path in one step, over an older one."""
    files, at, jvm = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    create_text(spark, at.toString(), text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(at, jvm.org.apache.hadoop.fs.Path(path), options)


def text_at(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    files, at, _ = _file_system(spark, path)
    return _read_text(spark, path) if files.exists(at) else None


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()["value"]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions."""
    files, at, _ = _file_system(spark, f"{root}/log")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The entry of a version, by default the newest; one without partitions before the first commit."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return Version()
        number = known[-1]
    entry = json.loads(_read_text(spark, _entry(root, number)))
    return Version(number, entry["partitions"], entry["batches"])


def _entry(root: str, number: int) -> str:
    return f"{root}/log/{number:012d}.json"


def read(spark: SparkSession, root: str, at: Version | int | None = None, only: Iterable[str] | None = None, by: str = "month") -> DataFrame | None:
    """The table at a version, by default the newest, or some of its partitions; None if there are none. Folders of other partitions are not listed."""
    entry = at if isinstance(at, Version) else version(spark, root, at)
    wanted = entry.partitions if only is None else {p: entry.partitions[p] for p in only if p in entry.partitions}
    if not wanted:
        return None
    folders = [f"{root}/data/{COMMIT}={commit}/{by}={name}" for name, commit in sorted(wanted.items())]
    rows = spark.read.option("basePath", f"{root}/data").parquet(*folders)
    return rows.withColumn(by, F.col(by).cast("string")).drop(COMMIT)


def commit(spark: SparkSession, root: str, rows: DataFrame, based_on: Version, by: str = "month", writer: str | None = None, batch: int | None = None) -> Version:
    """Write whole partitions and commit them as the version after ``based_on``; partitions that ``rows`` does not have stay as they are."""
    mark = uuid.uuid4().hex
    folder = f"{root}/data/{COMMIT}={mark}"
    rows.hint("rebalance", by).write.partitionBy(by).parquet(folder)
    files, at, _ = _file_system(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)]
    new = {n.removeprefix(f"{by}="): mark for n in names if n.startswith(f"{by}=")}
    batches = based_on.batches | ({writer: batch} if writer is not None else {})
    made = Version(based_on.number + 1, based_on.partitions | new, batches)
    text = json.dumps({"partitions": made.partitions, "batches": made.batches})
    if not create_text(spark, _entry(root, made.number), text):
        raise CommitConflict(f"version {made.number} of {root} was committed by another writer")
    return made


def upsert(spark: SparkSession, root: str, updates: DataFrame, key: Sequence[str], by: str = "month", writer: str | None = None, batch: int | None = None) -> Version:
    """Rows of ``updates`` replace those of the same key; only partitions with updates are read and written anew, and they become visible together.

    Keys of ``updates`` are unique, and a key never moves to another partition. A batch that its writer has committed before changes nothing.
    """
    current = version(spark, root)
    if writer is not None and batch is not None and current.batches.get(writer, -1) >= batch:
        return current
    # partitions are few: they go into the plan as paths
    touched = [r[0] for r in updates.select(F.col(by).cast("string")).distinct().collect()]
    if not touched:
        return current
    old = read(spark, root, current, touched, by)
    if old is not None:
        updates = updates.select(*old.columns).unionByName(old.join(updates.select(*key), list(key), "left_anti"))
    return commit(spark, root, updates, current, by, writer, batch)
