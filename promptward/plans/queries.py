"""Registered queries: name -> function of (spark, directory of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptward.functions.patterns import pii_regex
from promptward.functions.pii import builtin_patterns, id_checksum_ok
from promptward.functions.scalars import prompt_hash, session_label
from promptward.operators import audit as au
from promptward.operators import conversation as conv
from promptward.operators import dashboard as dash
from promptward.operators import evaluation as ev
from promptward.operators import events as evt
from promptward.operators import injection as inj
from promptward.operators import pii
from promptward.operators import report as rep
from promptward.operators import seedtable as st
from promptward.operators import sessions as ss
from promptward.operators import similarity as sim
from promptward.operators import verdict as vd
from promptward.plans import planted as pl
from promptward.rules import SEEDS
from promptward.sources.folders import new_run
from promptward.sources.tables import (
    CONVERSATIONS_SCHEMA,
    DOCUMENTS_SCHEMA,
    EVENTS_SCHEMA,
    read_audit_stream,
    read_stored_table_stream,
)
from promptward.streaming import jobs as sj

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register under the function's name; times are UTC as in the given tables."""

    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, sf_dir)

    QUERIES[run.__name__] = in_utc
    return run


# --- personal data ----------------------------------------------------------


def _matches_of(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        only = [p for p in builtin_patterns() if p.type == kind]
        return pii.pii_matches(pl.documents(spark, sf_dir), patterns=only, include_raw=True)

    return run


for _name, _kind in (("email", "EMAIL"), ("ip", "IP_ADDRESS"), ("card", "CREDIT_CARD")):
    _run = _matches_of(_kind)
    _run.__name__ = f"pii_matches_{_name}"
    query(_run)


@query
def pii_matches(spark, sf_dir):
    return pii.pii_matches(pl.planted_corpus(spark, sf_dir), include_raw=True)


@query
def pii_counts(spark, sf_dir):
    return pii.pii_counts(pl.documents(spark, sf_dir), by=["type", "lang"])


@query
def pii_counts_planted(spark, sf_dir):
    return pii.pii_counts(pl.planted_corpus(spark, sf_dir), by=["type", "source"])


@query
def pii_density(spark, sf_dir):
    return pii.pii_density(pl.planted_corpus(spark, sf_dir))


@query
def mask_pii(spark, sf_dir):
    return pii.mask_pii(pl.documents(spark, sf_dir)).select("doc_id", "masked_text")


@query
def masked_corpus(spark, sf_dir):
    return pii.masked_corpus(pl.planted_corpus(spark, sf_dir)).select(
        "doc_id", "text", F.array_join("pii_types", ",").alias("pii_types"), "pii_count"
    )


@query
def id_checksum(spark, sf_dir):
    """All identity-number candidates of the corpus and whether their check digit holds."""
    found = F.regexp_extract_all("text", F.lit(pii_regex("ID_CARD_CN")), F.lit(0))
    rows = pl.planted_corpus(spark, sf_dir).select("doc_id", F.posexplode(found).alias("pos", "value"))
    return rows.select("doc_id", "pos", "value", id_checksum_ok(F.col("value")).alias("valid"))


@query
def prompt_hashes(spark, sf_dir):
    return pl.documents(spark, sf_dir).select("doc_id", prompt_hash(F.col("text")).alias("prompt_hash"))


# --- injection --------------------------------------------------------------


@query
def injection_signals(spark, sf_dir):
    return inj.injection_signals(pl.planted_corpus(spark, sf_dir))


@query
def injection_signals_raw(spark, sf_dir):
    """The given documents as they are."""
    return inj.injection_signals(pl.documents(spark, sf_dir))


@query
def keyword_hits(spark, sf_dir):
    return inj.keyword_hits(pl.planted_corpus(spark, sf_dir))


@query
def rule_prevalence(spark, sf_dir):
    return inj.rule_prevalence(pl.planted_corpus(spark, sf_dir), by=["lang"])


@query
def rule_cooccurrence(spark, sf_dir):
    """Planted texts in pairs of neighbours, so that rules meet."""
    docs = pl.planted_corpus(spark, sf_dir)
    more = F.concat("text", F.lit(" "), pl._planted(1, "doc_id DIV 3 + 11"))
    return inj.rule_cooccurrence(docs.select("doc_id", more.alias("text")))


@query
def max_severity(spark, sf_dir):
    return inj.max_severity(pl.planted_corpus(spark, sf_dir))


# --- similarity -------------------------------------------------------------


@query
def seed_similarity(spark, sf_dir):
    return sim.seed_similarity(pl.planted_corpus(spark, sf_dir))


@query
def vector_check(spark, sf_dir):
    return sim.vector_check(pl.planted_corpus(spark, sf_dir))


@query
def similarity_histogram(spark, sf_dir):
    return sim.similarity_histogram(pl.planted_corpus(spark, sf_dir))


@query
def seed_table_check(spark, sf_dir):
    """The benchmark as a table of seeds: the best item of every document that comes near one."""
    items = pl.read_table(spark, f"{sf_dir}/benchmark.parquet")
    return st.seed_table_check(pl.documents(spark, sf_dir), items, threshold=0.3)


@query
def seed_table_pairs(spark, sf_dir):
    """All pairs of a planted document and a built-in seed or benchmark item above a low threshold."""
    items = pl.read_table(spark, f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string"), "text")
    builtin = spark.createDataFrame(list(SEEDS.items()), "item_id STRING, text STRING")
    return st.seed_pairs(pl.planted_corpus(spark, sf_dir), builtin.unionByName(items), threshold=0.25)


# --- verdict ----------------------------------------------------------------


@query
def verdicts(spark, sf_dir):
    return vd.scan(pl.planted_corpus(spark, sf_dir)).select(
        "doc_id",
        "risk_level",
        "attack_type",
        "blocked",
        F.size("pii_matches").alias("n_pii"),
        F.size("injection_signals").alias("n_signals"),
        "vector_check.*",
        "masked_prompt",
    )


@query
def verdicts_raw(spark, sf_dir):
    """Full scan of the given documents."""
    return vd.scan(pl.documents(spark, sf_dir)).select(
        "doc_id", "risk_level", "attack_type", "blocked", "vector_check.*", "masked_prompt"
    )


@query
def risk_level(spark, sf_dir):
    """Texts per verdict."""
    return (
        vd.scan(pl.planted_corpus(spark, sf_dir))
        .groupBy("risk_level", "attack_type", "blocked")
        .agg(F.count("*").alias("texts"))
    )


@query
def triggered_rules(spark, sf_dir):
    return vd.scan(pl.planted_corpus(spark, sf_dir)).select(
        "doc_id", F.posexplode("triggered_rules").alias("pos", "rule")
    )


@query
def stage_status(spark, sf_dir):
    rows = vd.stage_status(vd.scan(pl.planted_corpus(spark, sf_dir)), "doc_id")
    tags = ("pii_tags", "injection_tags", "vector_tags")
    return rows.select(
        *[F.array_join(c, "|").alias(c) if c in tags else c for c in rows.columns]
    )


@query
def badge_columns(spark, sf_dir):
    return vd.badge_columns(vd.scan(pl.planted_corpus(spark, sf_dir)), "doc_id")


# --- conversations ----------------------------------------------------------


def _conversation_verdicts(messages: DataFrame) -> DataFrame:
    return vd.scan(conv.latest_user_prompt(messages))


@query
def latest_user_prompt(spark, sf_dir):
    return conv.latest_user_prompt(pl.conversations(spark, sf_dir))


@query
def rejected_messages(spark, sf_dir):
    """Messages without text; the empty turns are made from the assistant's."""
    messages = pl.conversations(spark, sf_dir).withColumn(
        "text", F.when(F.col("role") != "assistant", F.col("text"))
    )
    return conv.rejected_messages(messages).select("conv_id", "turn", "role")


@query
def sanitize_conversation(spark, sf_dir):
    return conv.sanitize_conversation(pl.planted_conversations(spark, sf_dir))


@query
def sanitize_latest(spark, sf_dir):
    messages = pl.planted_conversations(spark, sf_dir)
    return conv.sanitize_conversation(messages, _conversation_verdicts(messages), "latest_only")


@query
def forwardable(spark, sf_dir):
    messages = pl.planted_conversations(spark, sf_dir)
    return conv.forwardable(messages, _conversation_verdicts(messages))


# --- audit ------------------------------------------------------------------


@query
def audit_rows(spark, sf_dir):
    return pl.planted_audit(spark, sf_dir).withColumn("triggered_rules", F.to_json("triggered_rules"))


@query
def recent_audit(spark, sf_dir):
    return au.recent_audit(pl.planted_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


def _past(spark, sf_dir):
    """An instant before the newest event."""
    return pl.as_of(spark, sf_dir) - F.expr("INTERVAL 30 HOURS")


@query
def recent_audit_past(spark, sf_dir):
    """The window of an instant in the past; later rows do not count."""
    return au.recent_audit(pl.stored_audit(spark, sf_dir), _past(spark, sf_dir))


@query
def summary_metrics_past(spark, sf_dir):
    return dash.summary_metrics(pl.stored_audit(spark, sf_dir), _past(spark, sf_dir))


@query
def not_forwardable(spark, sf_dir):
    """What stays behind; conversations whose id ends in 7 have no user turn and so no verdict."""
    messages = pl.planted_conversations(spark, sf_dir).withColumn(
        "role", F.when(F.col("conv_id") % 10 == 7, "assistant").otherwise(F.col("role"))
    )
    return conv.not_forwardable(messages, _conversation_verdicts(messages))


@query
def threats(spark, sf_dir):
    return au.threats(pl.planted_audit(spark, sf_dir)).select("id", "session_id", "attack_type")


@query
def hourly_timeline(spark, sf_dir):
    return dash.hourly_timeline(pl.planted_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def attack_breakdown(spark, sf_dir):
    return dash.attack_breakdown(pl.planted_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def attack_share(spark, sf_dir):
    return dash.attack_share(pl.planted_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def risk_distribution(spark, sf_dir):
    return dash.risk_distribution(pl.planted_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def session_ranking(spark, sf_dir):
    return dash.session_ranking(pl.planted_audit(spark, sf_dir))


@query
def summary_metrics(spark, sf_dir):
    return dash.summary_metrics(pl.stored_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def all_time_metrics(spark, sf_dir):
    return dash.all_time_metrics(pl.planted_audit(spark, sf_dir))


@query
def pii_rows(spark, sf_dir):
    return dash.pii_rows(pl.planted_scan(spark, sf_dir))


@query
def audit_page(spark, sf_dir):
    return au.audit_page(pl.planted_audit(spark, sf_dir), page=3, limit=20).select(
        "id", "timestamp", "risk_level", "attack_type", "session_id"
    )


@query
def audit_page_filtered(spark, sf_dir):
    return au.audit_page(pl.planted_audit(spark, sf_dir), page=2, limit=25, risk="CRITICAL").select(
        "id", "timestamp", "risk_level", "attack_type", "session_id"
    )


@query
def audit_page_after(spark, sf_dir):
    """The third page, reached from row to row."""
    audit, after = pl.stored_audit(spark, sf_dir), None
    for _ in range(2):
        after = au.page_end(au.audit_page_after(audit, after, 20))
    return au.audit_page_after(audit, after, 20).select("id", "timestamp", "risk_level", "attack_type", "session_id")


@query
def session_activity(spark, sf_dir):
    return ss.session_activity(pl.stored_audit(spark, sf_dir), "90 minutes")


@query
def session_alerts(spark, sf_dir):
    return ss.session_alerts(pl.stored_audit(spark, sf_dir))


@query
def first_in_horizon(spark, sf_dir):
    return ss.first_in_horizon(pl.stored_audit(spark, sf_dir), "1 day")


@query
def page_info(spark, sf_dir):
    return au.page_info(pl.planted_audit(spark, sf_dir), page=2, limit=20, risk="HIGH")


@query
def risk_counts(spark, sf_dir):
    return au.risk_counts(pl.planted_audit(spark, sf_dir))


@query
def risk_counts_wide(spark, sf_dir):
    return au.risk_counts_wide(pl.planted_audit(spark, sf_dir))


@query
def recent_scans(spark, sf_dir):
    return au.recent_scans(pl.planted_audit(spark, sf_dir)).select(
        "session_id", "id", "timestamp", "risk_level", "position"
    )


@query
def prompt_repeats(spark, sf_dir):
    return au.prompt_repeats(pl.planted_audit(spark, sf_dir))


@query
def distinct_prompts(spark, sf_dir):
    return au.distinct_prompts(pl.planted_audit(spark, sf_dir)).select(
        "prompt_hash", "id", "timestamp", "risk_level", "masked_prompt"
    )


@query
def session_labels(spark, sf_dir):
    """Display labels of session ids of all shapes, one made from each event."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    digest = F.sha2(event, 256)
    uuid = F.concat_ws(
        "-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    session = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("User-"), user))
        .when(F.col("event_type") == "view", uuid)
        .when(F.col("event_type") == "error", F.concat(F.lit("Sim-"), digest))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("s"), event))
        .otherwise(digest)
    )
    events = pl.read_table(spark, f"{sf_dir}/events.parquet")
    return events.select("event_id", session.alias("session_id")).select(
        "event_id", "session_id", session_label(F.col("session_id")).alias("label")
    )


# --- events, report, evaluation ---------------------------------------------


@query
def scan_events(spark, sf_dir):
    return pl.planted_events(spark, sf_dir)


@query
def scan_history(spark, sf_dir):
    return evt.scan_history(pl.planted_audit(spark, sf_dir))


@query
def compliance_report(spark, sf_dir):
    return rep.compliance_report(pl.stored_audit(spark, sf_dir), pl.as_of(spark, sf_dir))


@query
def detector_eval(spark, sf_dir):
    return ev.detector_eval(vd.scan(pl.planted_corpus(spark, sf_dir))).select(
        "doc_id", "payload_id", "expected_risk", "risk_level", "matches"
    )


@query
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(vd.scan(pl.planted_corpus(spark, sf_dir)))


@query
def label_eval(spark, sf_dir):
    """The similarity score against the ``toxic`` label."""
    checked = sim.vector_check(pl.planted_corpus(spark, sf_dir))
    labels = pl.read_table(spark, f"{sf_dir}/labels.parquet")
    return ev.label_eval(checked, labels, "similarity_score")


# --- streams ----------------------------------------------------------------
# Each runs over all files available now, into a folder that is then read.


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stored_table_stream(spark, sf_dir, "documents.parquet", DOCUMENTS_SCHEMA)


def _audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, each with the stored verdict of its document."""
    docs = pl.documents(spark, sf_dir)
    events = read_stored_table_stream(spark, sf_dir, "events.parquet", EVENTS_SCHEMA)
    return pl.audit_stream_of(events, docs)


def _to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = new_run(spark, name)
    sj.start_parquet(stream, out, checkpoint, mode).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_scan(spark, sf_dir):
    verdicts = sj.stream_scan(pl.plant(_document_stream(spark, sf_dir)))
    rows = verdicts.select(
        "doc_id", "risk_level", "attack_type", "blocked", "vector_check.*", "masked_prompt"
    )
    return _to_table(rows, "stream_scan")


@query
def route_stream(spark, sf_dir):
    """Rows per output of the router."""
    prompts = pl.plant(_document_stream(spark, sf_dir)).select(
        "doc_id",
        "text",
        F.concat(F.lit("User-"), F.col("source")).alias("session_id"),
        F.timestamp_seconds("doc_id").alias("ts"),
        F.length("text").alias("latency_ms"),
    )
    out, checkpoint = new_run(spark, "route_stream")
    sj.route_stream(sj.stream_scan(prompts), out, checkpoint).start().awaitTermination()
    counts = [
        sj.read_routed(spark, out, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")
        for name in ("passed", "blocked", "audit")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def stream_timeline(spark, sf_dir):
    return _to_table(sj.stream_timeline(_audit_stream(spark, sf_dir)), "stream_timeline")


@query
def stream_session_threats(spark, sf_dir):
    counts = sj.stream_session_threats(_audit_stream(spark, sf_dir))
    out, checkpoint = new_run(spark, "stream_session_threats")
    (
        counts.writeStream.outputMode("complete")
        .foreachBatch(sj.ranking_batch(out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out)


@query
def stream_dedup(spark, sf_dir):
    kept = sj.stream_dedup(_audit_stream(spark, sf_dir))
    return _to_table(kept, "stream_dedup").select("prompt_hash", "risk_level")


def _stored_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored audit, read as a stream of files."""
    return read_audit_stream(spark, pl.store_audit(spark, sf_dir))


def _upserted(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = new_run(spark, name)
    writer = stream.writeStream.outputMode("update").foreachBatch(sj.upsert_batch(out, name))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sj.read_latest(spark, out, name, keys)


@query
def stream_session_activity(spark, sf_dir):
    rows = sj.stream_session_activity(_stored_audit_stream(spark, sf_dir), "90 minutes")
    return _to_table(rows, "stream_session_activity")


@query
def stream_alerts(spark, sf_dir):
    return _to_table(sj.stream_session_alerts(_stored_audit_stream(spark, sf_dir)), "stream_alerts")


@query
def stream_first_in_horizon(spark, sf_dir):
    rows = sj.stream_first_in_horizon(_stored_audit_stream(spark, sf_dir), "1 day")
    return _to_table(rows, "stream_first_in_horizon")


@query
def stream_session_ranking(spark, sf_dir):
    """The ranking from the upserted counts per session and day."""
    counts = sj.stream_session_counts(_stored_audit_stream(spark, sf_dir))
    return sj.ranked_sessions(_upserted(counts, "session_counts", ["session_id", "day"]))


@query
def stream_latest_prompt(spark, sf_dir):
    """Newest user message of every conversation, from a stream of messages."""
    stream = read_stored_table_stream(spark, sf_dir, "conversations.parquet", CONVERSATIONS_SCHEMA)
    latest = _upserted(sj.stream_latest_turns(stream), "latest_turns", ["conv_id"])
    return conv.with_text_of(latest, pl.conversations(spark, sf_dir))
