"""From raw documents to packed training sequences, a stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read
again as the next stage's docs. All but the last keep the columns of documents.

Edge cases: a row without a doc_id is judged by its own text, like any other; a null or empty text has no shingle, no
passage and no leak, so only the quality score decides on it, and it is packed as its end token; of equal texts the
smallest doc_id stays (null last), and rows that repeat a doc_id with different texts stay each; a document whose
words are all repeats goes; very long texts are processed whole; without labels every document scores one half and
stays; empty tables give an empty result; further columns, whatever their names, come through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import drop, materialise
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.near import drop_near_copies
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.substrings import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash tries, then Jaccard of five-word shingles of 0.8 or more."""
    return drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id has too go."""
    return drop_repeats(docs, window=13)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after, new = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if path:
            drop(spark, path)
        docs, path = after, new
    return docs


#: The classifier and the latent search have no SQL.
ORACLE_SQL = None
