"""The corpus pipeline: four stages over documents, each written as Parquet and read again as the next one's input.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. line dedup: lines of later copies of a passage go; documents of which nothing is left go with them.
3. MinHash near-dedup: of each group on five-word shingles with a similarity of 0.8 and more, the smallest doc_id stays.
4. packing: what is left is packed into sequences of 2048 tokens; a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm.common import materialise, table
from litforge.llm.line_dedup import remove_repeats
from litforge.llm.minhash import near_duplicates
from litforge.llm.packing import packed
from litforge.llm.quality import keep_good
from litforge.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(docs).filter("n_removed = 0 or trim(text) <> ''")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    later = near_duplicates(docs, k=5, percent=80).filter("not kept").select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, docs["doc_id"] == F.col("_later"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the other stages, and the packed lengths, against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
