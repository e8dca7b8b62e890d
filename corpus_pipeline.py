"""A corpus from documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import ensure_checkpoint_dir, table
from memlake.llm.decontaminate import drop_leaks
from memlake.llm.neardup import near_duplicates
from memlake.llm.packing import pack
from memlake.llm.queries import tokenizer_path
from memlake.llm.suffixdedup import without_repeats
from memlake.llm.toxicity import drop_toxic, train

# Every stage but the last returns all columns of its documents, whatever they are called; an empty table gives no rows.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score reaches the threshold; the model learns from the labels of the documents given.

    Documents without words (null and empty texts too) stay, and rows that repeat stay or go together, whatever their ids. Without
    labels nothing goes.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates.

    Documents without an id or without words stay; rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that a document of a smaller id has; n_chars follows the text, and no document goes.

    A document without an id keeps its text and takes none from others; a null text becomes an empty one.
    """
    left = without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item of the benchmark; those without a text stay, and all where there are no items."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null or empty text is a piece of one token."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL cannot express the stages (a trained model, sketches, suffix arrays, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the table documents.

    What each returns is written in the shared checkpoint folder, and goes when the next one's has been written.
    """
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
