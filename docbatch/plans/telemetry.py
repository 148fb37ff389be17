"""Queries of run telemetry: stage times, pairing of marks, completion, change detection and quiet periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.operators import telemetry as R
from docbatch.operators.numbering import asof, numbered
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

EV = f"WITH {S.EVENTS_SQL}"
RUN = "PARTITION BY run_id ORDER BY ts, event_id"
#: Sums of doubles are rounded in the outermost select.
ROUND = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_events(S.table(spark, sf_dir, "events"))


@query("stage_totals", f"{EV} SELECT run_id, stage, round(sum(ms), 4) AS ms, count(*) AS n, count(DISTINCT file) AS files FROM run_events GROUP BY 1, 2")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_totals(events(spark, sf_dir)).withColumn("ms", F.round("ms", ROUND))


@query("stage_share", f"{EV} SELECT run_id, stage, round(sum(ms) / sum(sum(ms)) OVER (PARTITION BY run_id) * 100, 1) AS share FROM run_events GROUP BY 1, 2")
def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("ms").over(Window.partitionBy("run_id"))
    return R.stage_totals(events(spark, sf_dir)).select("run_id", "stage", F.round(F.col("ms") / total * 100, 1).alias("share"))


@query(
    "stage_split",
    f"""{EV}, s AS (SELECT run_id, sum(ms) AS broad, sum(CASE WHEN stage = 'view' THEN ms ELSE 0 END) AS files, sum(CASE WHEN stage = 'error' THEN ms ELSE 0 END) AS ocr FROM run_events GROUP BY 1),
    b AS (SELECT run_id, broad, least(broad, files) AS base, least(greatest(0, broad - least(broad, files)), ocr) AS ocr FROM s)
    SELECT run_id, part, round(ms, 4) AS ms FROM (SELECT run_id, 'base' AS part, base AS ms FROM b UNION ALL SELECT run_id, 'ocr', ocr FROM b UNION ALL SELECT run_id, 'other', broad - base - ocr FROM b WHERE broad - base - ocr >= 50)""",
)
def stage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.residual_split(events(spark, sf_dir), broad=F.lit(True), files=F.col("stage") == "view", ocr=F.col("stage") == "error").withColumn("ms", F.round("ms", ROUND))


@query(
    "run_peaks",
    f"""{EV} SELECT run_id, max(ms) AS peak, arg_min(ms, (ts, event_id)) AS first_ms, round(max(ms) - arg_min(ms, (ts, event_id)), 4) AS delta, count_if(ms >= 50) AS long_tasks, round(sum(CASE WHEN ms >= 50 THEN ms ELSE 0 END), 4) AS long_ms FROM run_events GROUP BY 1""",
)
def run_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_peaks(events(spark, sf_dir)).withColumns({"delta": F.round("delta", ROUND), "long_ms": F.round("long_ms", ROUND)})


@query(
    "run_complete",
    f"""{EV}, w AS (SELECT run_id, count_if(stage = 'error') AS error_events, count_if(stage = 'signup' AND ms < 1) AS metadata FROM run_events GROUP BY 1),
    i AS (SELECT run_id, count(DISTINCT file) AS failed_files FROM run_events WHERE stage = 'error' AND ms > 100 GROUP BY 1)
    SELECT run_id, error_events + metadata + coalesce(failed_files, 0) AS warnings, error_events + metadata + coalesce(failed_files, 0) = 0 AS complete FROM w LEFT JOIN i USING (run_id)""",
)
def run_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    failed = F.countDistinct(F.when((F.col("stage") == "error") & (F.col("ms") > 100), F.col("file")))
    n = e.groupBy("run_id").agg((F.count_if(F.col("stage") == "error") + F.count_if((F.col("stage") == "signup") & (F.col("ms") < 1)) + failed).alias("warnings"))
    return n.withColumn("complete", F.col("warnings") == 0)


STAGES = ["view", "click", "signup", "purchase", "error"]


@query(
    "run_barrier",
    f"""{EV}, need(ord, stage) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES))}),
    d AS (SELECT f.run_id, f.file, n.ord, n.stage, EXISTS (SELECT 1 FROM run_events e WHERE e.run_id = f.run_id AND e.file = f.file AND e.stage = n.stage) AS done FROM (SELECT DISTINCT run_id, file FROM run_events) f CROSS JOIN need n)
    SELECT run_id, file, bool_and(done) AS all_done, arg_min(stage, ord) FILTER (NOT done) AS first_open FROM d GROUP BY 1, 2""",
)
def run_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.barrier(events(spark, sf_dir), STAGES)


@query("status_changes", f"{EV} SELECT run_id, file, event_id, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS before FROM run_events) WHERE stage IS DISTINCT FROM before")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(events(spark, sf_dir), ["run_id", "file"], "stage").select("run_id", "file", "event_id", "stage")


@query(
    "stage_durations",
    f"""{EV}, c AS (SELECT * FROM (SELECT *, lag(stage) OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS before, max(ts) OVER (PARTITION BY run_id) AS run_end FROM run_events) WHERE stage IS DISTINCT FROM before)
    SELECT run_id, file, event_id, stage, (epoch_us(coalesce(lead(ts) OVER (PARTITION BY run_id, file ORDER BY ts, event_id), run_end)) - epoch_us(ts))::BIGINT AS us FROM c""",
)
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.durations(events(spark, sf_dir)).select("run_id", "file", "event_id", "stage", "us")


@query("last_n_events", f"{EV} SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM run_events) WHERE r <= 50")
def last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ring buffer of 50 events keeps of each run."""
    order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r <= 50").select("run_id", "event_id")


@query("heartbeats", f"{EV}, h AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS beat FROM run_events) SELECT run_id, beat, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM h GROUP BY 1, 2")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one beat for each ten minutes of activity."""
    beat = F.window("ts", "10 minutes")
    out = events(spark, sf_dir).groupBy("run_id", beat.alias("w")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))
    return out.select("run_id", F.col("w.start").cast("timestamp_ntz").alias("beat"), "event_id", "n")


@query(
    "hidden_time",
    f"""{EV}, v AS (SELECT run_id, file, stage, ts, lead(ts) OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS next FROM run_events)
    SELECT run_id, file, sum(CASE WHEN stage = 'signup' THEN epoch_us(next) - epoch_us(ts) ELSE 0 END)::BIGINT AS hidden_us, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS span_us FROM v GROUP BY 1, 2""",
)
def hidden_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a hide mark (signup) and the next event, which elapsed time excludes."""
    return R.hidden(events(spark, sf_dir), F.col("stage") == "signup")


@query(
    "mark_pairs",
    f"""{EV}, m AS (SELECT *, max(CASE WHEN stage = 'click' THEN (epoch_us(ts), event_id) END) OVER ({RUN.replace("run_id ORDER", "run_id, file ORDER")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start, lead(stage) OVER ({RUN.replace("run_id ORDER", "run_id, file ORDER")}) AS following,
        lag(stage) OVER (PARTITION BY run_id, file, stage IN ('click', 'purchase') ORDER BY ts, event_id) AS mark_before, lead(stage) OVER (PARTITION BY run_id, file, stage IN ('click', 'purchase') ORDER BY ts, event_id) AS mark_after, max(epoch_us(ts)) OVER (PARTITION BY run_id) AS run_end FROM run_events)
    SELECT run_id, file, start[2] AS start_id, event_id AS end_id, (epoch_us(ts) - start[1])::BIGINT AS us, false AS forced FROM m WHERE stage = 'purchase' AND mark_before = 'click'
    UNION ALL SELECT run_id, file, event_id, NULL, (run_end - epoch_us(ts))::BIGINT, true FROM m WHERE stage = 'click' AND mark_after IS NULL""",
)
def mark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start marks (click) and end marks (purchase) of a file: the newest start wins, open ones close at the end of the run."""
    return R.paired_marks(events(spark, sf_dir), start="click", end="purchase")


@query(
    "latest_event",
    f"""{EV} SELECT u.file, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(stage, (ts, event_id)) AS stage FROM (SELECT DISTINCT file FROM run_events) u
    LEFT JOIN (SELECT * FROM run_events WHERE stage IN ('purchase', 'signup')) e USING (file) GROUP BY 1""",
)
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    last = e.filter(F.col("stage").isin("purchase", "signup")).groupBy("file").agg(F.max_by(F.struct("event_id", "stage"), F.struct("ts", "event_id")).alias("l"))
    return e.select("file").distinct().join(last, "file", "left").select("file", "l.event_id", "l.stage")


@query(
    "top_stages",
    f"""{EV}, t AS (SELECT run_id, stage, sum(ms) AS ms FROM run_events GROUP BY 1, 2) SELECT run_id, stage, place, place = 1 AS bottleneck FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(ms, 4) DESC, stage)::INTEGER AS place FROM t) WHERE place <= 3""",
)
def top_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc(F.round("ms", ROUND)), "stage")
    return R.stage_totals(events(spark, sf_dir)).withColumn("place", F.row_number().over(order)).filter("place <= 3").select("run_id", "stage", "place", (F.col("place") == 1).alias("bottleneck"))


@query(
    "top_files",
    f"""{EV}, t AS (SELECT run_id, file, sum(ms) AS ms FROM run_events GROUP BY 1, 2) SELECT run_id, file, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(ms, 4) DESC, file)::INTEGER AS place FROM t) WHERE place <= 5""",
)
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc(F.round("ms", ROUND)), "file")
    return events(spark, sf_dir).groupBy("run_id", "file").agg(F.sum("ms").alias("ms")).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("run_id", "file", "place")


@query(
    "snapshot_changes",
    f"""{EV}, s AS (SELECT run_id, file, event_id, '{{"stage":"' || stage || '","big":' || (ms >= 50) || '}}' AS snapshot, ts FROM run_events)
    SELECT run_id, file, event_id, snapshot FROM (SELECT *, lag(snapshot) OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS before FROM s) WHERE snapshot IS DISTINCT FROM before""",
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = events(spark, sf_dir).withColumn("snapshot", F.to_json(F.struct("stage", (F.col("ms") >= 50).alias("big"))))
    return R.changes(snap, ["run_id", "file"], "snapshot").select("run_id", "file", "event_id", "snapshot")


@query(
    "event_report",
    f"""{EV} SELECT run_id, event_id, CASE WHEN row_number() OVER ({RUN}) > 99999 THEN (row_number() OVER ({RUN}))::VARCHAR ELSE lpad((row_number() OVER ({RUN}))::VARCHAR, 5, '0') END || ' | ' || stage || CASE WHEN ms >= 100 THEN ' | slow' ELSE '' END || ' | file=' || file AS line FROM run_events""",
)
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of each run; five digits, more where there are more lines."""
    rows = numbered(events(spark, sf_dir), ["run_id"], [F.col("ts"), F.col("event_id")])
    return rows.select("run_id", "event_id", R.report_line(F.col("number"), F.col("stage"), F.col("ms"), F.col("file")).alias("line"))


@query(
    "word_numbers",
    """WITH w AS (SELECT doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS n FROM (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents))
    SELECT doc_id, min(n) AS first, max(n) AS last FROM w GROUP BY 1""",
)
def word_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents numbered in one run, and the first and last number of each document."""
    words = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word")).drop("word")
    return numbered(words, [], [F.col("doc_id"), F.col("i")]).groupBy("doc_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))


@query(
    "asof_event",
    """WITH r AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT l.event_id, l.user_id, r.click_id FROM (SELECT * FROM events WHERE event_type <> 'click') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every other event the user's latest click until then."""
    rows = S.table(spark, sf_dir, "events")
    clicks = rows.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof(rows.filter("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id"]).drop("ts")


@query(
    "quiet_sessions",
    f"""{EV}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY file ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS new FROM run_events),
    n AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY ts, event_id) AS session FROM g)
    SELECT file, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS quiet_at, count(*) AS n FROM n GROUP BY file, session""",
)
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of a file until two hours pass without an event; the end of the session is the quiet point."""
    out = events(spark, sf_dir).groupBy("file", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("file", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("quiet_at"), "n")


@query(
    "debounce_last",
    f"""{EV}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id)) < 150000000 THEN 0 ELSE 1 END AS new FROM run_events),
    n AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS session FROM g)
    SELECT run_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS merged FROM n GROUP BY run_id, session""",
)
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes less than 150 s apart are one; the last of them is written."""
    out = events(spark, sf_dir).groupBy("run_id", F.session_window("ts", "150 seconds")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("merged"))
    return out.select("run_id", "event_id", "merged")


@query(
    "settled_runs",
    f"""{EV}, b AS (SELECT *, sum(CASE WHEN stage = 'error' THEN 1 ELSE 0 END) OVER ({RUN}) AS epoch, max(ts) OVER (PARTITION BY run_id) AS run_end FROM run_events)
    SELECT run_id, min(ts) AS settled_since FROM b WHERE epoch = (SELECT max(epoch) FROM b x WHERE x.run_id = b.run_id) AND stage <> 'error' GROUP BY run_id, run_end HAVING epoch_us(run_end) - epoch_us(min(ts)) >= 900000""",
)
def settled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without an error for at least 900 ms before their end, and since when."""
    return R.settled(events(spark, sf_dir), F.col("stage") == "error", "900 milliseconds").withColumn("settled_since", F.col("settled_since").cast("timestamp_ntz"))


@query("latest_cycle", f"{EV}, c AS (SELECT *, max(event_id // 100) OVER (PARTITION BY run_id, file) AS newest FROM run_events) SELECT run_id, file, event_id FROM c WHERE event_id // 100 = newest")
def latest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an older cycle of the same file are superseded. A cycle is a hundred events."""
    cycle = F.expr("event_id div 100")
    return events(spark, sf_dir).withColumn("newest", F.max(cycle).over(Window.partitionBy("run_id", "file"))).filter(cycle == F.col("newest")).select("run_id", "file", "event_id")


@query(
    "changed_tokens",
    f"""{EV} SELECT run_id, file, event_id FROM (SELECT *, stage || ':' || floor(ms / 10)::BIGINT AS token, lag(stage || ':' || floor(ms / 10)::BIGINT) OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS before FROM run_events) WHERE token IS DISTINCT FROM before""",
)
def changed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work is done again only where the cheap change token differs from the last."""
    token = events(spark, sf_dir).withColumn("token", F.xxhash64("stage", F.floor(F.col("ms") / 10)))
    return R.changes(token, ["run_id", "file"], "token").select("run_id", "file", "event_id")


@query(
    "stage_timeouts",
    f"""{EV}, p AS (SELECT c.run_id, c.file, c.event_id, (SELECT min(ts) FROM run_events e WHERE e.run_id = c.run_id AND e.file = c.file AND e.stage = 'purchase' AND e.ts > c.ts) AS done_at, c.ts FROM run_events c WHERE stage = 'click')
    SELECT run_id, file, event_id, CASE WHEN done_at <= ts + INTERVAL 3 HOUR THEN 'done' ELSE 'timed out' END AS state FROM p""",
)
def stage_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting for an end mark is bounded by three hours."""
    return R.timeouts(events(spark, sf_dir), F.col("stage") == "click", F.col("stage") == "purchase", "3 hours").select("run_id", "file", "event_id", "state")
