"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.session import checkpoint_root, settle

__all__ = ["Forest", "packed", "release", "settle", "shared_path", "shared_paths", "small_batches", "table", "texts_of", "unpacked", "vocabulary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def vocabulary(name: str, path: str | None = None) -> bytes:
    """The vocabulary file at path, or the installed public one of that name; read on the driver and sent along."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_bytes()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the driver and all executors share; `release` deletes what is there."""
    _MADE.append(f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def shared_paths() -> tuple[str, ...]:
    """The shared paths made so far and not released."""
    return tuple(_MADE)


def release(spark: SparkSession, keep: tuple[str, ...]) -> None:
    """Delete all shared paths but those to keep: for a caller whose results no longer need what was made on their way."""
    for path in set(_MADE) - set(keep):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _MADE.remove(path)


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, its session set to hand Python batches of at most 4 MB (and one row), so that long texts do not fill a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows of docs as one struct column beside columns of our own, so that no names clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(n) for n, c in own.items()])


def unpacked(rows: DataFrame, like: DataFrame, name: str = "_doc") -> DataFrame:
    """Back to the columns of `like`."""
    return rows.select(*[F.col(f"{name}.`{c}`").alias(c) for c in like.columns])


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string; null reads as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


class Forest:
    """Union-find over positions 0..n-1 that takes links as arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.label[left], self.label[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return
            self.label = up
