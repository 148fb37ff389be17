"""Telemetry of runs. Events have (run_id, event_id, ts, file, stage, ms); windows are per run and file, so no run need fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_file() -> Window:
    return Window.partitionBy("run_id", "file").orderBy("ts", "event_id")


def stage_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "stage").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def residual_split(events: DataFrame, broad: Column, files: Column, ocr: Column) -> DataFrame:
    """Time of a broad stage split into what its parts explain; an unexplained rest below 50 ms is dropped."""
    part = lambda c: F.sum(F.when(c, F.col("ms")).otherwise(0.0))
    s = events.groupBy("run_id").agg(part(broad).alias("broad"), part(files).alias("files"), part(ocr).alias("ocr"))
    s = s.withColumn("base", F.least("broad", "files")).withColumn("ocr", F.least(F.greatest(F.lit(0.0), F.col("broad") - F.col("base")), F.col("ocr")))
    s = s.withColumn("other", F.col("broad") - F.col("base") - F.col("ocr"))
    out = s.select("run_id", F.expr("stack(3, 'base', base, 'ocr', ocr, 'other', other) as (part, ms)"))
    return out.filter("part <> 'other' or ms >= 50")


def run_peaks(events: DataFrame, long_ms: float = 50.0) -> DataFrame:
    first = F.min_by("ms", F.struct("ts", "event_id"))
    long = F.col("ms") >= long_ms
    return events.groupBy("run_id").agg(F.max("ms").alias("peak"), first.alias("first_ms"), (F.max("ms") - first).alias("delta"), F.count_if(long).alias("long_tasks"), F.sum(F.when(long, F.col("ms")).otherwise(0.0)).alias("long_ms"))


def barrier(events: DataFrame, stages: list[str]) -> DataFrame:
    """(run_id, file, all_done, first_open): whether all stages were seen, and the first that was not."""
    seen = events.groupBy("run_id", "file").agg(F.collect_set("stage").alias("seen"))  # at most one entry for each stage name
    open_ = F.filter(F.array(*map(F.lit, stages)), lambda s: ~F.array_contains("seen", s))
    return seen.select("run_id", "file", (F.size(open_) == 0).alias("all_done"), F.get(open_, F.lit(0)).alias("first_open"))


def changes(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return events.withColumn("_b", F.lag(value).over(order)).filter(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def durations(events: DataFrame) -> DataFrame:
    """Each change of stage with the microseconds to the next change, or to the end of the run."""
    ends = events.groupBy("run_id").agg(F.max("ts").alias("run_end"))
    changed = changes(events, ["run_id", "file"], "stage").join(ends, "run_id")
    until = F.coalesce(F.lead("ts").over(by_file()), F.col("run_end"))
    return changed.withColumn("us", F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))


def hidden(events: DataFrame, hide: Column) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.withColumn("gap", F.when(hide, us(F.lead("ts").over(by_file())) - us(F.col("ts"))).otherwise(0))
    return rows.groupBy("run_id", "file").agg(F.sum("gap").alias("hidden_us"), (us(F.max("ts")) - us(F.min("ts"))).alias("span_us"))


def paired_marks(events: DataFrame, start: str, end: str) -> DataFrame:
    """(run_id, file, start_id, end_id, us, forced): an end mark closes the mark before it if that is a start."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    ends = events.groupBy("run_id").agg(F.max("ts").alias("run_end"))
    marks = events.filter(F.col("stage").isin(start, end))
    marks = marks.withColumn("before", F.lag(F.struct("stage", "event_id", "ts")).over(by_file())).withColumn("after", F.lead("stage").over(by_file()))
    closed = marks.filter((F.col("stage") == end) & (F.col("before.stage") == start))
    closed = closed.select("run_id", "file", F.col("before.event_id").alias("start_id"), F.col("event_id").alias("end_id"), (us(F.col("ts")) - us(F.col("before.ts"))).alias("us"), F.lit(False).alias("forced"))
    forced = marks.filter((F.col("stage") == start) & F.col("after").isNull()).join(ends, "run_id")
    forced = forced.select("run_id", "file", F.col("event_id").alias("start_id"), F.lit(None).cast("long").alias("end_id"), (us(F.col("run_end")) - us(F.col("ts"))).alias("us"), F.lit(True).alias("forced"))
    return closed.unionByName(forced)


def settled(events: DataFrame, disturbs: Column, least: str) -> DataFrame:
    """(run_id, settled_since): the first event after the last disturbance, if that is at least so long before the end."""
    last = F.max(F.when(disturbs, F.struct("ts", "event_id")))
    bounds = events.groupBy("run_id").agg(last.alias("last"), F.max("ts").alias("run_end"))
    calm = events.join(bounds, "run_id").filter(~disturbs & (F.col("last").isNull() | (F.struct("ts", "event_id") > F.col("last"))))
    out = calm.groupBy("run_id").agg(F.min("ts").alias("settled_since"), F.first("run_end").alias("run_end"))
    return out.filter(F.col("run_end") >= F.col("settled_since") + F.expr(f"interval {least}")).select("run_id", "settled_since")


def timeouts(events: DataFrame, start: Column, end: Column, within: str) -> DataFrame:
    """Start marks with the state of their wait for the next end mark of the same file."""
    following = by_file().rowsBetween(1, Window.unboundedFollowing)
    done_at = F.min(F.when(end, F.col("ts"))).over(following)
    rows = events.withColumn("done_at", done_at).filter(start)
    state = F.when(F.col("done_at") <= F.col("ts") + F.expr(f"interval {within}"), "done").otherwise("timed out")
    return rows.withColumn("state", state)


def report_line(number: Column, stage: Column, ms: Column, file: Column, slow: float = 100, digits: int = 5) -> Column:
    """A line of a report: its number with leading zeros, never cut, what happened, whether it was slow, and the file."""
    shown = number.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(digits - F.length(shown), F.lit(0))), shown)
    return F.concat_ws(" | ", padded, stage, F.when(ms >= slow, "slow"), F.concat(F.lit("file="), file))
