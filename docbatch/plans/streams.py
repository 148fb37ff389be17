"""Queries that run a stream over the event table to its end and read what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.plans import telemetry  # noqa: F401  its SQL is that of the streams, too
from docbatch.plans.catalog import SQL, query
from docbatch.plans.staging import shared_dir, staged
from docbatch.sources import tables as S
from docbatch.streaming import events as E


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return E.read_events(spark, f"{sf_dir}/events.parquet*", schema)


def finished(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/docbatch-stream-{uuid.uuid4().hex}"
    E.run_to_table(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_ingest", "SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS files FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream, counted afterwards."""
    rows = finished(source(spark, sf_dir).select("event_id", "user_id", "event_type"))
    return rows.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("files"))


def closed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stateful stream has given when it has run over all events and was then closed: the same query goes on from its checkpoint over the closing rows."""
    table = S.table(spark, sf_dir, "events")
    ends = staged(E.closing_events(table), "closing-events")
    base = f"{shared_dir(spark)}/docbatch-stream-{uuid.uuid4().hex}"
    stream = make(as_runs(source(spark, sf_dir)))
    E.run_to_table(stream, f"{base}/out", f"{base}/state")
    E.run_to_table(make(as_runs(E.read_events(spark, ends.inputFiles()[0].rsplit("/", 1)[0], table.schema, files_per_trigger=1))), f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "stream_mark_pairs",
    f"""WITH m AS (SELECT user_id AS file, event_id, event_type AS stage, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'purchase')),
    n AS (SELECT *, lead(stage) OVER w AS after, lead(event_id) OVER w AS after_id, lead(us) OVER w - us AS gap FROM m WINDOW w AS (PARTITION BY file ORDER BY us, event_id))
    SELECT file, event_id AS start_id, CASE WHEN gap <= {E.DAY_US} THEN after_id END AS end_id, CASE WHEN gap <= {E.DAY_US} THEN gap ELSE {E.DAY_US} END AS us, NOT coalesce(gap <= {E.DAY_US}, FALSE) AS forced
    FROM n WHERE stage = 'click' AND (after = 'purchase' OR gap IS NULL OR gap > {E.DAY_US})""",
)
def stream_mark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of start and end marks kept in keyed state; a start without an end for a day is forced to close."""
    return closed(spark, sf_dir, lambda rows: E.by_key(rows, ["file"], E.PairedMarks("click", "purchase")))


def as_runs(rows: DataFrame) -> DataFrame:
    """Events as runs, a day each."""
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), "event_id", "ts", F.col("user_id").alias("file"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


@query("stream_quiet_sessions", SQL["quiet_sessions"])
def stream_quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a file until two hours pass without an event, as a stream; each is given once, when the watermark has passed its end."""
    out = closed(spark, sf_dir, lambda rows: E.quiet_sessions(rows, "file", "2 hours"))
    return out.select("file", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "quiet_at")), "n")


@query("stream_debounce_last", SQL["debounce_last"])
def stream_debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes less than 150 s apart are one, as a stream; the last of them is written."""
    return closed(spark, sf_dir, lambda rows: E.quiet_sessions(rows, "run_id", "150 seconds")).select("run_id", "event_id", F.col("n").alias("merged"))


@query("stream_latest_cycle", SQL["latest_cycle"])
def stream_latest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cycle of a file; what it supersedes is taken back in the stream, so that what stands is what was given once more than taken."""
    cycles = lambda rows: E.by_key(rows.withColumn("cycle", F.expr("event_id div 100")), ["run_id", "file"], E.LatestCycle("cycle"))
    return closed(spark, sf_dir, cycles).groupBy("run_id", "file", "event_id").agg(F.sum("change").alias("n")).filter("n > 0").drop("n")


BEAT_US = 600_000_000


@query(
    "stream_heartbeats",
    f"""WITH {S.EVENTS_SQL} SELECT run_id, unnest(list_reduce(list_transform(list(epoch_us(ts) ORDER BY ts), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {BEAT_US} THEN list_concat(a, x) ELSE a END)) AS us FROM run_events GROUP BY 1""",
)
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least ten minutes after the last one that was emitted: the rule itself, which needs state."""
    return closed(spark, sf_dir, lambda rows: E.by_key(rows, ["run_id"], E.Heartbeats(BEAT_US)))


@query("stream_changed_tokens", SQL["changed_tokens"])
def stream_changed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work is done again only where the change token differs from the key's last, as a stream."""
    token = F.concat_ws(":", "stage", F.floor(F.col("ms") / 10))
    return closed(spark, sf_dir, lambda rows: E.by_key(rows.withColumn("token", token), ["run_id", "file"], E.ChangedTokens("token")))


@query("stream_settled_runs", SQL["settled_runs"])
def stream_settled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without an error for at least 900 ms before their end, and since when, from keyed state."""
    rows = closed(spark, sf_dir, lambda rows: E.by_key(rows, ["run_id"], E.Settled("error", 900_000)))
    return rows.select("run_id", F.timestamp_micros("since_us").cast("timestamp_ntz").alias("settled_since"))


@query("stream_stage_timeouts", SQL["stage_timeouts"])
def stream_stage_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting for an end mark is bounded by three hours; the end of the stream ends all waiting."""
    return closed(spark, sf_dir, lambda rows: E.by_key(rows, ["run_id", "file"], E.BoundedWaits("click", "purchase", 3 * 3_600_000_000)))
