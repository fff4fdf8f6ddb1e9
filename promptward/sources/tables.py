"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptward.functions.scalars import digest_bytes, digest_text, other_text, utc_day

CONVERSATIONS_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
AUDIT_SCHEMA = (
    "id STRING, timestamp TIMESTAMP, prompt_hash STRING, masked_prompt STRING, "
    "risk_level STRING, attack_type STRING, latency INT, model_used STRING, blocked BOOLEAN, "
    "triggered_rules ARRAY<STRING>, similarity_score DOUBLE, session_id STRING"
)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet file or directory."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_table_stream(
    spark: SparkSession, path: str, schema: str, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a directory as a stream; ``glob`` filters file names."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_stored_table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table ``name`` of a folder of tables as a stream, be it one Parquet file or a directory of files.

    A stream reads directories or globs; the name as a glob of one choice lets Spark list either.
    """
    return read_table_stream(spark, f"{folder.rstrip('/')}/{{{name}}}", schema)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages: one row per turn of a conversation."""
    return read_table(spark, path, CONVERSATIONS_SCHEMA)


def read_conversations_stream(spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Chat messages as they arrive: new Parquet files of a directory."""
    return read_table_stream(spark, path, CONVERSATIONS_SCHEMA, glob, max_files)


#: Digests of an audit row, and the column of the key of a text that is stored beside the rows.
DIGESTS = ("id", "prompt_hash")
TEXT_KEY = "text_key"

#: Files that a day of audit rows is split into, and rows a file holds at most.
DAY_BUCKETS = 8
FILE_ROWS = 5_000_000


def write_audit(
    audit: DataFrame, path: str, mode: str = "append", day_buckets: int = DAY_BUCKETS, file_rows: int = FILE_ROWS
) -> None:
    """Append audit rows, partitioned by UTC day so that time-bounded reads prune files.

    Rows are dealt out by day and a bucket of their id first, so that a day has
    ``day_buckets`` files at most per write and a busy day is spread over as many tasks.
    Digests are dealt out as bytes.  Rows of ``store_texts`` bring the key of their text only.
    """
    days = audit.withColumn("dt", utc_day(F.col("timestamp")))
    bucket = F.pmod(F.xxhash64("id"), F.lit(day_buckets)).cast("int")
    packed = days.withColumns({"_bucket": bucket} | _digests_as_bytes())
    (
        packed.repartition("dt", "_bucket")
        .withColumns({c: F.coalesce(digest_text(F.col(f"_{c}")), c) for c in DIGESTS})
        .select(*days.columns)
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy("dt")
        .parquet(path)
    )


def _digests_as_bytes() -> dict[str, Column]:
    """Every digest as bytes, and as text only where its bytes do not give it back."""
    return {f"_{c}": digest_bytes(F.col(c)) for c in DIGESTS} | {c: other_text(F.col(c)) for c in DIGESTS}


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{AUDIT_SCHEMA}, {TEXT_KEY} BINARY, dt DATE").parquet(path)
    return _with_texts(rows, path)


def read_audit_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stored audit as a stream of its files; texts are those stored when the stream is made."""
    rows = read_table_stream(spark, path, f"{AUDIT_SCHEMA}, {TEXT_KEY} BINARY", max_files=max_files)
    return _with_texts(rows, path)


def _texts_folder(path: str) -> str:
    return f"{path.rstrip('/')}-texts"


def store_texts(parts: DataFrame, path: str, text: str) -> DataFrame:
    """Store ``parts``, one row per prompt, beside the audit at ``path``; they come back with the key of their ``text`` for it.

    A prompt that many rows of the audit repeat is so stored once, and no shuffle carries it.
    ``read_audit`` gives rows with that key their text.  The key is of the text alone, so writes may repeat it.
    """
    folder = f"{_texts_folder(path)}/{uuid.uuid4().hex}"
    key = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    keyed = parts.withColumn(TEXT_KEY, key).withColumnRenamed(text, "masked_prompt")
    keyed.write.option("compression", "zstd").parquet(folder)
    return parts.sparkSession.read.schema(keyed.schema).parquet(folder).drop("masked_prompt")


def _with_texts(rows: DataFrame, path: str) -> DataFrame:
    """Rows with the texts of their keys.  Keys are distinct, so a query without ``masked_prompt`` is planned without the join."""
    reader = rows.sparkSession.read.schema(f"{TEXT_KEY} BINARY, masked_prompt STRING")
    try:
        texts = reader.option("recursiveFileLookup", True).parquet(_texts_folder(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.drop(TEXT_KEY)
    texts = texts.groupBy(TEXT_KEY).agg(F.first("masked_prompt").alias("_text"))
    whole = rows.join(texts, TEXT_KEY, "left").withColumn("masked_prompt", F.coalesce("masked_prompt", "_text"))
    return whole.select(*[c for c in rows.columns if c != TEXT_KEY])


def write_report(report: DataFrame, path: str) -> None:
    """Write report lines in order as one text file; a report has some sixty lines."""
    report.orderBy("section", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def triggered_rules_to_json(audit: DataFrame) -> DataFrame:
    """Rule list as JSON text, for sinks that hold no arrays."""
    return audit.withColumn("triggered_rules", F.to_json("triggered_rules"))


def triggered_rules_from_json(audit: DataFrame) -> DataFrame:
    return audit.withColumn("triggered_rules", F.from_json("triggered_rules", "array<string>"))
