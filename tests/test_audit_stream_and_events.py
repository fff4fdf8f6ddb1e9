"""Documents are scanned and written as JSON once, however many events they have."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from promptward.operators import events as evt
from promptward.operators.verdict import scan
from promptward.plans import planted as pl
from promptward.plans import queries as q


def _tables(spark, tmp_path):
    docs = [(i, f"text {i} of “words” }}}}", "en", "web", 20) for i in range(120)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    events = spark.range(300).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("value"),
        F.lit("").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_audit_stream_scans_no_document_again(spark, tmp_path):
    stream = q._audit_stream(spark, _tables(spark, tmp_path))
    assert "rlike" not in stream._jdf.queryExecution().logical().toString().lower()
    rows = q._to_table(stream.select("prompt_hash", "risk_level"), "stream_test")
    batch = pl.planted_audit(spark, str(tmp_path)).select("prompt_hash", "risk_level")
    assert rows.count() == 300 and not rows.exceptAll(batch).count()


def test_events_of_a_prompt_share_its_json(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    events = pl.link_events(pl.read_table(spark, f"{folder}/events.parquet"), pl.documents(spark, folder))
    whole = evt.scan_events(events.join(scan(pl.planted_corpus(spark, folder)), "doc_id"))
    shared = pl.planted_events(spark, folder)
    assert not shared.exceptAll(whole).count() and not whole.exceptAll(shared).count()
    for r in shared.filter("event_type = 'metadata'").collect():
        found = json.loads(r.event)
        assert list(found) == ["type", "scanResult", "model", "requestId", "timestamp"]
        assert found["requestId"] == r.request_id and isinstance(found["scanResult"].get("latencyMs", 0), int)
    assert {"latencyMs" in json.loads(r.event).get("scanResult", {}) for r in shared.collect()} == {True, False}
