"""The training-data pipeline: quality rules, toxicity, SimHash near-dedup, mixing to target weights, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and its result is written as Parquet and read again as the next one's docs.
A result must be written before the next stage is called.
All but the last return the columns of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quoteflow.llm import mixing, pieces, quality, simhash, toxicity
from quoteflow.llm.common import release, shared_path, shared_paths, table, vocabulary

#: SQL cannot fit the estimates and the network of the first two stages; tests compare the stages with brute force instead
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return quality.passing(docs)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the network is fitted on labelled documents among docs."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where a block is taken in part."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids and decoded of each row of the mix."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


_LAST: list[str] = []


def _in_turn(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what the stage before it made on its way in the shared folder: that one's result is written when the next is called."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, tuple(p for p in shared_paths() if p not in _LAST))
        before = shared_paths()
        result = stage(spark, docs, sf_dir)
        _LAST[:] = [p for p in shared_paths() if p not in before]
        return result

    return run_stage


STAGES = [
    ("quality_rules", _in_turn(quality_rules)),
    ("toxicity", _in_turn(remove_toxic)),
    ("simhash_near_dedup", _in_turn(near_dedup)),
    ("mixing", _in_turn(mix_sources)),
    ("sentencepiece", _in_turn(encode_pieces)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, the last one's too. What a stage was made from is deleted when it is written, so
    the shared folder holds one stage and what the next one makes on its way."""
    docs, others = table(spark, sf_dir, "documents"), shared_paths()
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, (*others, path))
        docs = spark.read.parquet(path)
    return docs
