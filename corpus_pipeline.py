"""The corpus pipeline: documents in, packed token sequences out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of documents; run()
writes each stage's result as Parquet in the shared folder and hands what it reads again to the next.

Defined cases.  An empty table goes through all stages and gives no rows.  A null or letterless text goes at the first
stage.  Rows with a null doc_id are never copies of others, so near-dedup keeps them, and substring dedup counts them as
larger than every id.  Rows equal in doc_id and text are one document for near-dedup; rows with one doc_id and different
texts are documents each.  Among equal texts the smallest doc_id stays.  Texts that lose all words stay as empty rows;
packing makes them a document of the end id alone.  Very long texts are read whole by every stage.  doc_id is a column of
whole numbers.  Columns besides doc_id, text, lang and n_chars are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import bagminhash, decontaminate, language_id, packing, substring_dedup
from graphmill.llm.queries import VOCABULARY
from graphmill.partitioning import spread
from graphmill.workspace import folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters or that no learned language explains."""
    docs = spread(docs, "doc_id")
    return language_id.keep_known(spark, docs, language_id.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id."""
    return bagminhash.keep_one(spread(docs, "doc_id"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that a document with a smaller doc_id has."""
    return substring_dedup.remove_repeats(docs, measures=False)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more is text of the benchmark."""
    return decontaminate.drop_contaminated(spread(docs, "doc_id"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    return packing.pack(spread(docs, "doc_id"), VOCABULARY)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither trained language models nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
