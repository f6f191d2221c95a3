"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents`` for the rows that it keeps; the mixing
stage keeps all rows and returns them in the mixed order, and the last stage returns each row's place
in the order that was written.  Import errors are not caught here: ``__spark_entry__`` decides whether
the pipeline is registered.
"""

from __future__ import annotations

import os
import re
import uuid
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, mixing, ngram_join, quality
from ledgerloom.llm.catalog import vocabulary
from ledgerloom.llm.columns import pick, table
from ledgerloom.session import scratch_path

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with confidence; the model learns from their labels."""
    docs = pick(docs, COLUMNS)
    found = langid.identify(docs, langid.train(docs), keep=tuple(COLUMNS))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by their text and their site."""
    docs = pick(docs, COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, F.col("source"), F.col("lang")).filter("_kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    docs = pick(docs, COLUMNS)
    return ngram_join.keep_one(docs, ngram_join.join(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources at tempered weights."""
    return mixing.mixed(pick(docs, COLUMNS), most_sources=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, as digests, and its position (from 0) in the order written before."""
    return bpe.digests(in_written_order(docs, {"doc_id": "long", "text": "string"}), vocabulary(), keep=("doc_id", "position"))


def in_written_order(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns and ``position``, the number of rows before this one in the Parquet as written.

    A sorted table is written as one file per range, numbered in order, but a scan packs files by size:
    so a row's position is its file's first position (by part number) and its index within the file.
    Rows that were not read from Parquet files have a null position.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return pick(docs, columns).withColumn("position", F.lit(None).cast("long"))
    named = docs.withColumns({"_file": F.col("_metadata.file_path"), "_index": F.col("_metadata.row_index")})
    # One row per file: the driver lists the files anyway.
    sizes = sorted(named.groupBy("_file").count().collect(), key=lambda r: part_number(r["_file"]))
    firsts = accumulate((r["count"] for r in sizes), initial=0)
    starts = docs.sparkSession.createDataFrame([(r["_file"], first) for r, first in zip(sizes, firsts)], "_file string, _first long")
    placed = pick(named, columns | {"_file": "string", "_index": "long"}).join(F.broadcast(starts), "_file")
    return placed.select(*columns, (F.col("_first") + F.col("_index")).alias("position"))


def part_number(path: str) -> tuple[int, str]:
    """Sort key of a written file: its task's number, then its name (one task's files count up in it)."""
    name = path.rsplit("/", 1)[-1]
    found = re.match(r"part-(\d+)", name)
    return int(found[1]) if found else 0, name


STAGES = [
    ("language ID", languages),
    ("quality classifier", good),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mixed),
    ("byte-level BPE", encode),
]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a Parquet table between each two."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = os.path.join(base, str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
