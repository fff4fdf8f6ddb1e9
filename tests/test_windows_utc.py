"""Times do not depend on the session time zone, and windows end at their instant."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promptward.functions.scalars import utc_day, utc_text
from promptward.operators import audit as au
from promptward.sources import tables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture()
def zone(spark):
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def audit_rows(spark, hours):
    row = "low", "NONE", 1, "m", False, ["r"], None, "s"
    rows = [(f"id{i}", START + timedelta(hours=i), f"h{i}", "p", *row) for i in range(hours)]
    return spark.createDataFrame(rows, tables.AUDIT_SCHEMA)


def test_windows_are_equal_in_all_zones(spark, zone, tmp_path):
    zone("UTC")
    tables.write_audit(audit_rows(spark, 60), str(tmp_path / "a"))
    as_of = F.expr("timestamp_micros(1704214800000000)")  # 2024-01-02T17:00Z
    counts = []
    for name in ("UTC", "Asia/Shanghai", "America/Los_Angeles"):
        zone(name)
        recent = au.recent_audit(tables.read_audit(spark, str(tmp_path / "a")), as_of)
        counts.append(recent.count())
    assert counts == [25, 25, 25]


def test_day_bounds_prune_folders(spark, tmp_path):
    tables.write_audit(audit_rows(spark, 60), str(tmp_path / "a"))
    stored = tables.read_audit(spark, str(tmp_path / "a"))
    recent = au.recent_audit(stored, START + timedelta(hours=41))
    assert "PartitionFilters: [isnotnull(dt" in recent._jdf.queryExecution().executedPlan().toString()


def test_a_day_has_few_files(spark, tmp_path):
    rows = audit_rows(spark, 24).repartition(24)
    tables.write_audit(rows, str(tmp_path / "a"), day_buckets=3)
    assert 1 <= len(list((tmp_path / "a" / "dt=2024-01-01").glob("*.parquet"))) <= 3
    assert tables.read_audit(spark, str(tmp_path / "a")).count() == 24


@pytest.mark.parametrize("name", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_utc_text(spark, zone, name):
    zone(name)
    one = spark.range(1).select(F.expr("timestamp_micros(1710045000123456)").alias("t"))
    row = one.select(utc_text(F.col("t")).alias("text"), utc_day(F.col("t")).cast("string").alias("day")).first()
    assert tuple(row) == ("2024-03-10T04:30:00.123Z", "2024-03-10")
