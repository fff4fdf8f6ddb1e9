"""The training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptward.llm.common import new_folder, read_documents
from promptward.llm.decontaminate import drop_contaminated
from promptward.llm.exact import drop_exact_duplicates
from promptward.llm.near import drop_near_duplicates
from promptward.llm.pieces import encode_decode
from promptward.llm.queries import tokenizer
from promptward.llm.toxicity import drop_toxic, read_labels


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, read_labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text decoded from them."""
    return encode_decode(docs, tokenizer("piece_bpe_32k.model")).select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids_text",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]

#: SQL can express neither the classifier nor the sampling nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
