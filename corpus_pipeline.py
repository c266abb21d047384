"""The corpus pipeline: documents to token ids, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import new_path, scratch
from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.mixing import mixed_documents
from codeloom.llm.ngram_join import without_near_copies
from codeloom.llm.quality import kept_documents
from codeloom.llm.token_file import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, of hosts that pass (operator 9).

    Null and empty texts fail; nulls elsewhere, repeated rows and extra columns change nothing; empty input gives no rows.
    """
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 (operator 10).

    Copies of a text go but for one, whatever their ids; texts without words stay; null ids are told apart by their texts;
    empty input gives no rows.
    """
    return without_near_copies(docs, words=5, pct=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly copied ones go (operator 3).

    Null and empty texts stay; a benchmark without items changes nothing; empty input gives no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 2).

    Null and empty texts are never taken; a null source is one of its own; ties are broken by the id and size; empty input
    gives no rows.
    """
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in chunks, read back: a row for each document and repeat (operator 5).

    Null texts are empty ones and have the end id alone; null ids come first; empty input gives no rows. The file stays.
    """
    out = new_path(spark, "corpus-ids")
    write_tokens(docs, out, at_once=2 << 20)
    return read_tokens(spark, out)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("mix", mix), ("token_ids", token_ids)]

#: No SQL: near copies, encoding and sampling as a chain are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents. Tables that only serve a stage are deleted once it is written.

    Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, whatever their names, fare as the
    operators' docstrings say: texts without words fail the quality rules, ids must be whole numbers, rows of null id
    are documents of their own, and an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
