"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, every column in place; the last
returns token counts and digests.  A stage works on all documents the one before it kept.

1. quality: documents that the factorisation machine scores below its threshold go.
2. lines: lines that stand earlier, exactly or within one edit, go; ``n_chars`` follows.  Documents stay, if need be empty.
3. near copies: of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays.
4. benchmark: documents that hold ten consecutive words of a benchmark item go.
5. tokens: every text is encoded with byte-level BPE and decoded again.

Defined results, in every stage: a null text counts as empty and stays null; rows are judged one by one, also where they
share an id or have none, and none is lost or repeated for it.  Null ids come first in the order of lines and last in that of
near copies; rows that share an id are told apart by their text; of rows equal in id and text the near-copy stage
keeps one.  Texts without words are no copies of each other and hold no benchmark window.  Empty tables give empty results.  Further
columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import posixpath
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shiftboard.llm import bpe_fst, decontaminate, line_dedup, near_dup, quality_fm, store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality_fm.train(docs, _table(spark, sf_dir, "labels"))
    return quality_fm.drop_low_quality(docs, machine)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, size="n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return bpe_fst.round_trip(docs, ranks, public_tokenizers.PATTERN, less=5).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: no SQL: the classifier and the tokenizer are not expressible; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored, so the next reads it and not its history."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
