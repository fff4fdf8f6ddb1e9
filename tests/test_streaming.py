"""Streams give what the batch operators give, also after a replay."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptward.operators.audit import to_audit
from promptward.operators.verdict import scan
from promptward.plans.planted import PLANTED
from promptward.plans.queries import QUERIES
from promptward.sources.folders import checkpoint_root
from promptward.sources.tables import read_table_stream
from promptward.streaming import jobs

SCHEMA = "id INT, session_id STRING, ts TIMESTAMP, latency_ms INT, text STRING"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def prompts(spark, tmp_path_factory):
    """Four files, one per micro-batch, in time order."""
    path = str(tmp_path_factory.mktemp("prompts"))
    rows = [
        (i, f"User-{i % 5}" if i % 7 else None, START + timedelta(minutes=10 * i), i, PLANTED[i % 60][1])
        for i in range(120)
    ]
    for n in range(4):
        part = spark.createDataFrame(rows[n * 30 : n * 30 + 30], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def source(spark, prompts):
    return lambda: read_table_stream(spark, prompts, SCHEMA, max_files=1)


@pytest.fixture(scope="module")
def expected(spark, prompts):
    return scan(spark.read.schema(SCHEMA).parquet(prompts)).cache()


def as_set(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_stream_scan_equals_batch_scan(spark, source, expected, tmp_path):
    out = str(tmp_path / "out")
    jobs.start_parquet(jobs.stream_scan(source()), out, str(tmp_path / "cp")).awaitTermination()
    columns = sorted(expected.columns)
    assert as_set(spark.read.parquet(out), *columns) == as_set(expected, *columns)


def test_router_outputs_and_replay(spark, source, expected, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    jobs.route_stream(jobs.stream_scan(source()), out, str(tmp_path / "cp")).start().awaitTermination()

    def read(name):
        rows = jobs.read_routed(spark, out, name)
        return rows.select(*sorted(rows.columns))

    blocked = expected.filter("blocked").count()
    before = {n: as_set(read(n), "*") for n in ("passed", "blocked", "audit")}
    assert (len(before["passed"]), len(before["blocked"]), len(before["audit"])) == (120 - blocked, 2 * blocked, 120)
    assert as_set(read("audit"), "id", "risk_level") == as_set(to_audit(expected), "id", "risk_level")
    assert read("audit").select("batch_id").distinct().count() == 4
    assert "pii_matches" not in read("passed").columns

    # The same batch again, as after a failure between write and commit.
    first = read("audit").filter("batch_id = 0").select("timestamp")
    again = expected.join(first.withColumnRenamed("timestamp", "ts"), "ts", "left_semi")
    run = read("audit").first()["run"]
    monkeypatch.setattr(jobs, "run_of", lambda batch: run)
    jobs.route_batch(out)(again, 0)
    assert {n: as_set(read(n), "*") for n in before} == before


def test_timeline(spark, source, tmp_path):
    audit = to_audit(jobs.stream_scan(source()))
    out = str(tmp_path / "out")
    jobs.start_parquet(jobs.stream_timeline(audit), out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    # 120 prompts at six per hour; the last two hours are still open.
    assert sorted((r.hour_start, r.total) for r in rows) == [(START + timedelta(hours=h), 6) for h in range(18)]


def test_session_threats(spark, source, expected, tmp_path):
    counts = jobs.stream_session_threats(to_audit(jobs.stream_scan(source())))
    out = str(tmp_path / "out")
    query = counts.writeStream.outputMode("complete").foreachBatch(jobs.ranking_batch(out))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = (
        expected.filter("session_id is not null")
        .groupBy("session_id")
        .agg(
            F.count_if(F.expr("attack_type <> 'NONE'")).alias("threat_count"),
            F.count_if("blocked").alias("blocked_count"),
            F.count("*").alias("total"),
        )
    )
    assert as_set(spark.read.parquet(out), *batch.columns) == as_set(batch, "*")


def test_dedup(spark, source, tmp_path):
    audit = to_audit(jobs.stream_scan(source()))
    out = str(tmp_path / "out")
    jobs.start_parquet(jobs.stream_dedup(audit, "30 hours"), out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("prompt_hash").distinct().count() == len({p[1] for p in PLANTED[:60]})


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("files", [0, 3], ids=["one file", "a directory"])
def test_queries_stream_tables_of_one_file_and_of_many(spark, tmp_path, files):
    """A table is one Parquet file or a directory of them; streams read either whole."""
    tables = {
        "documents": ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
                      [(i, f"text {i}", "en", "web", 6) for i in range(12)]),
        "conversations": ("conv_id BIGINT, turn BIGINT, role STRING, text STRING",
                          [(c, t, "user", f"{c} {t}") for c in range(4) for t in range(3)]),
    }
    for name, (schema, rows) in tables.items():
        made = spark.createDataFrame(rows, schema).repartition(max(files, 1))
        made.write.parquet(str(tmp_path / (f"{name}.parquet" if files else f"_{name}")))
        if not files:
            (part,) = (tmp_path / f"_{name}").glob("part-*.parquet")
            (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    # A neighbour whose name begins alike is another table.
    spark.createDataFrame(tables["documents"][1], tables["documents"][0]).write.parquet(str(tmp_path / "documents.parquet.old"))
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    assert run("stream_scan").count() == 12
    assert {r.output: r.rows for r in run("route_stream").collect()}["audit"] == 12
    assert sorted(map(tuple, run("stream_latest_prompt").collect())) == [(c, 2, f"{c} 2") for c in range(4)]
