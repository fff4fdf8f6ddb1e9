"""Streaming forms of the scan and of the audit analytics.

The scan is a projection, so a stream is scanned by the same expressions as a
table.  Aggregates over event time are bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from promptward.functions.scalars import utc_day
from promptward.operators import sessions as ss
from promptward.operators.audit import to_audit
from promptward.operators.conversation import latest_turns
from promptward.operators.events import scan_events
from promptward.operators.verdict import scan
from promptward.rules import ATTACK_NONE, RANKED_SESSIONS
from promptward.sources.committed import CommittedFolders


def stream_scan(source: DataFrame, text: str = "text", **options) -> DataFrame:
    """Verdict per arriving prompt; stateless."""
    return scan(source, text, **options)


def start_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available now into a Parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("compression", "zstd")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def route_batch(
    out_dir: str,
    text: str = "text",
    session: Column | str = "session_id",
    timestamp: Column | str = "ts",
    latency: Column | str = "latency_ms",
) -> Callable[[DataFrame, int], None]:
    """Write passed prompts, their events, block events and audit rows of a scanned micro-batch.

    The outputs of a batch become visible together, by one entry of the manifest of
    ``CommittedFolders``; ``read_routed`` reads them.  A batch that is replayed after its commit is
    left alone, one that broke off before is written again, and a stream with a new
    checkpoint is a run of its own, which overwrites nothing.  The batch is kept on disk between
    the writes; partitions lost with an executor are scanned again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folders = CommittedFolders(batch.sparkSession, out_dir)
        run = run_of(batch)
        if folders.is_committed(run, batch_id):
            return
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            passed = batch.filter(~F.col("blocked")).withColumn(text, F.col("masked_prompt"))
            outputs = {
                # The matched values stay behind: only the masked text goes on.
                "passed": passed.drop("masked_prompt", "pii_matches"),
                "passed_events": scan_events(batch.filter(~F.col("blocked")), text, session, timestamp, latency),
                "blocked": scan_events(batch.filter("blocked"), text, session, timestamp, latency),
                "audit": to_audit(batch, text, session, timestamp, latency),
            }
            for name, rows in outputs.items():
                rows.write.mode("overwrite").parquet(folders.path(name, run, batch_id))
            folders.commit(run, batch_id, outputs)
        finally:
            batch.unpersist()

    return write


def run_of(batch: DataFrame) -> str:
    """The stream a micro-batch belongs to: the same after a restart, another one with a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def read_routed(spark: SparkSession, out_dir: str, name: str, run: str | None = None) -> DataFrame:
    """Committed rows of one output (``passed``, ``passed_events``, ``blocked`` or ``audit``) of the newest run or of ``run``."""
    return CommittedFolders(spark, out_dir).read(name, run)


def route_stream(verdicts: DataFrame, out_dir: str, checkpoint: str, **columns) -> DataStreamWriter:
    """Send a scanned stream to its outputs."""
    return (
        verdicts.writeStream.foreachBatch(route_batch(out_dir, **columns))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def stream_timeline(audit: DataFrame, delay: str = "1 hour") -> DataFrame:
    """All and blocked rows per hour; an hour is final once the watermark passed it."""
    return (
        audit.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 hour"))
        .agg(F.count("*").alias("total"), F.count_if("blocked").alias("blocked"))
        .select(F.col("window.start").alias("hour_start"), "total", "blocked")
    )


def stream_session_threats(audit: DataFrame) -> DataFrame:
    """Running findings and totals per session; state is one row per session."""
    return (
        audit.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count_if(F.col("attack_type") != ATTACK_NONE).alias("threat_count"),
            F.count_if("blocked").alias("blocked_count"),
            F.count("*").alias("total"),
        )
    )


def ranking_batch(path: str, top: int = RANKED_SESSIONS) -> Callable[[DataFrame, int], None]:
    """Write the sessions with most findings of a complete-mode batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ranked = (
            batch.filter(F.col("threat_count") > 0)
            .orderBy(F.col("threat_count").desc(), "session_id")
            .limit(top)
        )
        ranked.write.mode("overwrite").parquet(path)

    return write


def stream_dedup(audit: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """First row of every prompt hash; repeats within the horizon are dropped."""
    return audit.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["prompt_hash"])


# --- windows over event time ----------------------------------------------------
# A window is final, and its row written, once the watermark has passed its end; rows
# that come later than ``delay`` behind the newest one are dropped.


def stream_session_activity(audit: DataFrame, gap: str = ss.ACTIVITY_GAP, delay: str = "1 hour") -> DataFrame:
    """``session_activity`` of closed stretches; open ones that a late row connects are merged."""
    return ss.session_activity(audit.withWatermark("timestamp", delay), gap)


def stream_session_alerts(
    audit: DataFrame,
    limit: int = ss.ALERT_LIMIT,
    window: str = ss.ALERT_WINDOW,
    every: str = ss.ALERT_EVERY,
    delay: str = "1 hour",
) -> DataFrame:
    """``session_alerts`` of closed windows: one alert for each, on its whole count."""
    return ss.session_alerts(audit.withWatermark("timestamp", delay), limit, window, every)


def stream_first_in_horizon(audit: DataFrame, horizon: str = ss.REPEAT_HORIZON, delay: str = "1 hour") -> DataFrame:
    """``first_in_horizon`` of closed horizons: by event time, not by arrival; state is one narrow row per open one."""
    return ss.first_in_horizon(audit.withWatermark("timestamp", delay), horizon)


def stream_latest_turns(messages: DataFrame) -> DataFrame:
    """``latest_turns`` as a stream in update mode; state is two numbers per conversation.

    Messages carry no time, so a conversation never closes and its two numbers stay.
    """
    return latest_turns(messages)


# --- tables that streams update ----------------------------------------------------


def stream_session_counts(audit: DataFrame, delay: str = "1 day") -> DataFrame:
    """Findings and totals per session and UTC day, in update mode.

    State is one row per session and open day: a day closes ``delay`` after its end.
    """
    day = F.window("timestamp", "1 day")
    return (
        audit.filter(F.col("session_id").isNotNull())
        .withWatermark("timestamp", delay)
        .groupBy("session_id", day.alias("_window"))
        .agg(
            F.count_if(F.col("attack_type") != ATTACK_NONE).alias("threat_count"),
            F.count_if("blocked").alias("blocked_count"),
            F.count("*").alias("total"),
        )
        .select("session_id", utc_day(F.col("_window.start")).alias("day"), "threat_count", "blocked_count", "total")
    )


def upsert_batch(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """Add the changed rows of an update-mode batch as the next version of a table.

    A version is a folder of its own, so readers go on with what was committed before it.
    ``read_latest`` takes the newest version of every key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folders, run = CommittedFolders(batch.sparkSession, path), run_of(batch)
        if not folders.is_committed(run, batch_id):
            batch.write.mode("overwrite").parquet(folders.path(name, run, batch_id))
            folders.commit(run, batch_id, [name])

    return write


def read_latest(spark: SparkSession, path: str, name: str, keys: list[str], run: str | None = None) -> DataFrame:
    """The newest committed row of every key of an upserted table."""
    rows = CommittedFolders(spark, path).read(name, run)
    values = [c for c in rows.columns if c not in (*keys, "run", "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in values])


def ranked_sessions(counts: DataFrame, top: int = RANKED_SESSIONS) -> DataFrame:
    """Sessions with most findings, from their counts per day."""
    sums = [F.sum(c).alias(c) for c in ("threat_count", "blocked_count", "total")]
    totals = counts.groupBy("session_id").agg(*sums)
    return totals.filter(F.col("threat_count") > 0).orderBy(F.col("threat_count").desc(), "session_id").limit(top)
