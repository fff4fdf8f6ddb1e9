"""Detectors against labelled payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptward.rules import PAYLOADS


def payload_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled attack payloads."""
    return spark.createDataFrame(
        [tuple(p) for p in PAYLOADS],
        "payload_id STRING, session_id STRING, category STRING, text STRING, expected_risk STRING",
    )


def detector_eval(verdicts: DataFrame, expected: str = "expected_risk") -> DataFrame:
    """Verdicts that carry their expected risk level, with a match flag."""
    return verdicts.withColumn("matches", F.col("risk_level") == F.col(expected))


def confusion_matrix(verdicts: DataFrame, expected: str = "expected_risk") -> DataFrame:
    """Texts per expected and actual risk level."""
    return verdicts.groupBy(
        F.col(expected).alias("expected_risk"), F.col("risk_level").alias("actual_risk")
    ).agg(F.count("*").alias("texts"))


def label_eval(
    scored: DataFrame,
    labels: DataFrame,
    score: Column | str,
    label: str = "toxic",
    id_col: str = "doc_id",
    cuts: int = 100,
) -> DataFrame:
    """Precision and recall of ``score >= cut`` against a label table, for ``cuts`` + 1 cuts from 0 to 1.

    ``score`` lies between 0 and 1, ``label`` is the 0/1 column that counts as the truth.  Scores are
    counted by cut and label first; the sweep is a running sum over those few counts, so nothing
    is sorted.  Rows without a score or label are left out; an id with several labels counts
    once for each.  A ratio without a denominator is null.
    """
    value = F.col(score) if isinstance(score, str) else score
    truth = labels.select(F.col(id_col), F.col(label).cast("int").alias("_truth")).filter(F.col("_truth").isin(0, 1))
    step = F.when(value.isNotNull(), F.least(F.floor(value * cuts), F.lit(cuts))).cast("int")
    counted = (
        scored.select(id_col, step.alias("step"))
        .filter("step IS NOT NULL")
        .join(truth, id_col)
        .groupBy("step")
        .agg(F.count_if(F.col("_truth") == 1).alias("pos"), F.count_if(F.col("_truth") == 0).alias("neg"))
    )
    steps = scored.sparkSession.range(cuts + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step"))  # over cuts + 1 rows
    everything = Window.partitionBy()
    counts = steps.join(F.broadcast(counted), "step", "left").na.fill(0, ["pos", "neg"])
    swept = counts.select(
        (F.col("step") / F.lit(cuts)).alias("cut"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("_all"),
    )
    return swept.select(
        "cut",
        "tp",
        "fp",
        (F.col("_all") - F.col("tp")).alias("fn"),
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("_all") > 0, F.col("tp") / F.col("_all")).alias("recall"),
    )
