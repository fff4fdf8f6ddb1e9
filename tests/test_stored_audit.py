"""The stored audit gives the rows of the audit, holds each text once, and moves no text with its rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from promptward.operators import audit as au
from promptward.operators import dashboard as dash
from promptward.operators import sessions as ss
from promptward.plans import planted as pl
from promptward.plans import queries as q
from promptward.sources import tables
from promptward.streaming import jobs


def _tables(spark, tmp_path):
    """60 documents, one without a text, one that comes twice and one id with two texts; 600 events."""
    docs = [(i, f"text {i} of some words", "en", "web", 20) for i in range(57)]
    docs += [(57, None, "en", "web", 0), docs[3], (4, "another text of the same id", "en", "web", 20)]
    spark.createDataFrame(docs, tables.DOCUMENTS_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(600).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.col("id") * 900)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") * 1.5).alias("value"),
        F.lit("").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(str, df.select(*au.AUDIT_COLUMNS).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_audit_is_the_audit_with_each_text_once(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    path = pl.store_audit(spark, folder)
    stored = tables.read_audit(spark, path)
    assert stored.columns == [*au.AUDIT_COLUMNS, "dt"]
    assert _rows(stored) == _rows(pl.planted_audit(spark, folder)) and stored.count() == 600
    assert stored.filter("masked_prompt LIKE '%text 5 of%'").count() >= 10
    # On disk: a text for each document, none with the rows.
    files = spark.read.schema(tables.AUDIT_SCHEMA).parquet(path)
    assert files.filter("masked_prompt IS NOT NULL").count() == 0
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{path}-texts").count() == 60


def test_queries_without_texts_join_none(spark, tmp_path):
    audit = pl.stored_audit(spark, _tables(spark, tmp_path))
    now = datetime(1970, 1, 5)
    page = au.audit_page_after(audit, (now, "f"), 5).select("id", "timestamp", "risk_level")
    for df in (
        au.recent_audit(audit, now),
        dash.summary_metrics(audit, now),
        ss.session_activity(audit),
        ss.session_alerts(audit),
        ss.first_in_horizon(audit),
        page,
    ):
        assert "Join" not in _plan(df) and "masked_prompt" not in _plan(df)


def test_stream_of_a_stored_audit_has_its_texts(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    stream = q._stored_audit_stream(spark, folder)
    jobs.start_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "out").glob("*.parquet"))
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == _rows(pl.planted_audit(spark, folder))


def test_rows_with_and_without_texts_apart_share_a_table(spark, tmp_path):
    """Two writes of the same texts double no row; digests of any shape come back as they were."""
    path, at = str(tmp_path / "audit"), datetime(2024, 1, 1)
    digests = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "abc", "", "id1", None, "密" * 3, "00" * 32]
    rest = "LOW", "NONE", 1, "m", False, ["r"], None, "s"
    whole = spark.createDataFrame([(d, at, d, f"own {d}", *rest) for d in digests], tables.AUDIT_SCHEMA)
    tables.write_audit(whole, path)
    for _ in range(2):
        parts = spark.createDataFrame([("h1", "shown 1"), ("h2", "shown 2"), ("h3", None)], "prompt_hash STRING, t STRING")
        keyed = tables.store_texts(parts, path, "t")
        assert keyed.columns == ["prompt_hash", "text_key"]
        tables.write_audit(whole.limit(1).drop("prompt_hash", "masked_prompt").join(keyed).withColumn("masked_prompt", F.lit(None).cast("string")), path)
    got = tables.read_audit(spark, path)
    want = [(d, f"own {d}") for d in digests] + 2 * [("h1", "shown 1"), ("h2", "shown 2"), ("h3", None)]
    assert sorted(map(str, got.select("prompt_hash", "masked_prompt").collect())) == sorted(
        map(str, spark.createDataFrame(want, "prompt_hash STRING, masked_prompt STRING").collect())
    )
    assert sorted(map(str, got.filter("masked_prompt LIKE 'own%'").select("id").collect())) == sorted(
        map(str, whole.select("id").collect())
    )


def test_dealing_out_rows_moves_digests_as_bytes(spark, tmp_path):
    """Rows of an audit are dealt to days with 32 bytes for a digest and without their texts."""
    path = pl.store_audit(spark, _tables(spark, tmp_path))
    rows = tables.read_audit(spark, path)
    assert rows.filter(F.length("id") == 64).count() == rows.count()
    packed = rows.withColumns(tables._digests_as_bytes())
    assert packed.filter("id IS NOT NULL OR octet_length(_id) <> 32").count() == 0


def test_first_rows_of_digests_and_of_other_ids(spark):
    """The smallest of equal times among ids that are digests and ids that are not; digests travel as bytes."""
    at = datetime(2024, 1, 1)
    ids = ["ab" * 32, "aa" * 32, "AA" * 32, "abc", "zz", "00", "0", "", None, "密", "a\n", "0a", "0b0", "9f" * 32]
    some = [("d" * 64, [0, 1]), ("d" * 64, ids[5:8]), ("D" * 64, ids[2:5]), (None, ids[8:10]), ("", ids[10:]), ("h", [0])]
    rest = "m", "LOW", "NONE", 1, "m", False, ["r"], None, "s"
    rows = []
    for n, (digest, mine) in enumerate(some):
        for i in mine:
            rows.append((ids[i] if isinstance(i, int) else i, at.replace(day=n + 1), digest, *rest))
    audit = spark.createDataFrame(rows + rows[:1], tables.AUDIT_SCHEMA)
    got = {(r.prompt_hash, r.timestamp): (r.id, r.times) for r in ss.first_in_horizon(audit).collect()}
    want = {}
    for r in rows + rows[:1]:
        first, n = want.get((r[2], r[1]), (r[0], 0))
        least = None if None in (first, r[0]) else min(first, r[0], key=lambda x: x.encode())
        want[r[2], r[1]] = (least, n + 1)
    assert got == want and len(want) == 6
    plan = _plan(ss.first_in_horizon(audit))
    keys = plan.split("Exchange hashpartitioning(")[1].split("),")[0]
    assert not keys.startswith("prompt_hash")
    before = plan.split("Exchange hashpartitioning(")[1].split("SortAggregate")[1].split("\n")[0]
    assert "unhex" in before and "struct(timestamp, timestamp" in before
