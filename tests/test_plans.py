"""Physical plans keep the properties they need at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptward.operators import audit as au
from promptward.operators import dashboard as dash
from promptward.operators.conversation import latest_user_prompt, sanitize_conversation
from promptward.operators.injection import injection_signals, rule_prevalence
from promptward.operators.verdict import scan
from promptward.plans import planted as pl
from promptward.sources import tables


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.range(100).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("junk")
    ).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit") / "a")
    tables.write_audit(spark.createDataFrame([], tables.AUDIT_SCHEMA), path)
    spark.createDataFrame([], tables.AUDIT_SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(tables.AUDIT_SCHEMA).parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_shuffles_nothing(docs):
    assert "Exchange" not in plan(scan(docs)) and "Join" not in plan(scan(docs))


def test_scan_has_no_python(docs):
    assert "Python" not in plan(scan(docs))


def test_filters_on_verdicts_do_not_repeat_the_detectors(docs):
    base = plan(scan(docs)).count("RLIKE") + plan(scan(docs)).count("regexp_extract")
    for condition in ("blocked", "risk_level = 'HIGH' and attack_type <> 'NONE'", "size(pii_matches) > 0"):
        filtered = plan(scan(docs).filter(condition))
        assert filtered.count("RLIKE") + filtered.count("regexp_extract") == base


def test_filters_on_other_columns_reach_the_source(docs):
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan(scan(docs).filter("doc_id = 7"))


def test_only_needed_columns_are_read(docs):
    schema = plan(injection_signals(docs)).split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<doc_id:bigint,text:string"
    assert "junk" not in plan(rule_prevalence(docs, ["lang"]))


def test_counts_are_combined_before_the_shuffle(docs):
    text = plan(rule_prevalence(docs, ["lang"]))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_top_sessions_need_no_full_sort(audit):
    text = plan(dash.session_ranking(audit))
    assert "TakeOrderedAndProject" in text and text.count("Exchange hashpartitioning") == 1


def test_history_is_bounded_below_the_shuffle(audit):
    text = plan(au.recent_scans(audit))
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning")[1]


def test_page_needs_no_full_sort(audit):
    assert "TakeOrderedAndProject" in plan(au.audit_page(audit, 3, 20))


def test_latest_prompt_combines_before_the_shuffle(spark):
    messages = spark.createDataFrame([], tables.CONVERSATIONS_SCHEMA)
    assert "partial_max" in plan(latest_user_prompt(messages))
    assert "Exchange" not in plan(sanitize_conversation(messages))


def test_counts_by_risk_build_no_masked_text(docs):
    counted = scan(docs).groupBy("risk_level").count()
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "masked_prompt" not in text and "triggered_rules" not in text


def test_latest_prompts_and_first_rows_sort_no_texts(spark, audit):
    messages = spark.createDataFrame([], tables.CONVERSATIONS_SCHEMA)
    for df in (latest_user_prompt(messages), au.distinct_prompts(audit)):
        assert "SortAggregate" not in plan(df)


def test_cooccurrence_counts_before_its_shuffle(docs):
    from promptward.operators.injection import rule_cooccurrence

    exchanges = plan(rule_cooccurrence(docs)).count("Exchange")
    assert exchanges == 2  # by pair, and the few pairs into one row


def test_seed_table_broadcasts_nothing_by_hint(spark, docs, monkeypatch):
    from promptward.operators.seedtable import seed_pairs

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = spark.createDataFrame([(1, "some text")], "item_id INT, text STRING")
        pairs = seed_pairs(docs, seeds, threshold=0.5)
        assert "Broadcast" not in plan(pairs) and "Cartesian" not in plan(pairs)
        assert pairs.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_audit_joins_carry_no_texts(spark, docs):
    """Prompts are hashed and cut once per document, not once per event, and only that is joined."""
    many = docs.select("doc_id", F.concat("text", F.col("doc_id") % 7).alias("text"), "lang", F.lit("web").alias("source"))
    events = spark.range(300).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds("id").alias("ts"),
        (F.col("id") % 5).cast("string").alias("user_id"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"),
        F.lit(2.5).alias("value"),
    )
    audit = pl.audit_of(events, many)
    above, below = audit._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)
    assert "text#" not in above and "_hash" in above and "sha2" in below
    whole = au.to_audit(pl.link_events(events, many).join(scan(pl.plant(many)), "doc_id"))
    assert audit.columns == whole.columns == list(au.AUDIT_COLUMNS)
    assert sorted(map(str, audit.collect())) == sorted(map(str, whole.collect())) and audit.count() == 300
