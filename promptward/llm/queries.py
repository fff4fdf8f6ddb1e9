"""The operators over their tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptward.llm.common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; it is installed beside Spark on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.pieces import encode_decode

    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return encode_decode(docs, tokenizer("piece_bpe_32k.model")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.decontaminate import contamination

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(read_documents(spark, sf_dir), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.passages import drop_repeated_passages

    return drop_repeated_passages(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.near import near_duplicates

    return near_duplicates(read_documents(spark, sf_dir))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.suffixes import drop_repeated_bytes

    return drop_repeated_bytes(read_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.shards import pack

    return pack(read_documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm import personal as pd

    found = pd.find_personal_data(read_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[pd.count_of("base", k).alias(f"n_{k}") for k in pd.KINDS],
        F.sha2(pd.listed("base"), 256).alias("base_sha256"),
        pd.listed("spans").alias("spans"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm import toxicity as tox

    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    index = tox.fit(docs, tox.read_labels(spark, sf_dir))
    return tox.score(docs, index).select("doc_id", tox.held_out().alias("held_out"), "score", "predicted", "evidence")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.tokenfile import round_trip

    docs = read_documents(spark, sf_dir)
    return round_trip(spark, docs, tokenizer("word_bpe_49k.json"), end_id=2).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.exact import exact_duplicates

    return exact_duplicates(read_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.packing import pack

    return pack(read_documents(spark, sf_dir).select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.lexical import search

    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptward.llm.collocations import collocations

    return collocations(read_documents(spark, sf_dir).select("text", "lang"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_passages": op3_passages,
    "op4_minhash": op4_minhash,
    "op5_suffixes": op5_suffixes,
    "op6_shards": op6_shards,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}
