"""Stateful streams over several batches: late rows, timers that fire while the stream runs, and state that goes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docbatch.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture
def batches(spark, tmp_path):
    """Runs a query over files that come one after the other; gives each batch's rows, and the rows of the state at the end."""

    def run(parts, make):
        for i, rows in enumerate(parts):
            spark.createDataFrame([(e, t, u, k, 1.0, None) for e, t, u, k in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        found = []
        for i in range(len(parts)):
            stream = E.read_events(spark, f"{tmp_path}/in{i}", spark.read.parquet(f"{tmp_path}/in{i}").schema, "1 hour", 1).select("event_id", "ts", F.col("user_id").alias("file"), F.col("event_type").alias("stage"))
            E.run_to_batches(make(stream), f"{tmp_path}/out{i}", f"{tmp_path}/state", "append")
            out = spark.read.option("basePath", f"{tmp_path}/out{i}").parquet(f"{tmp_path}/out{i}/*").drop("_batch")
            found.append(sorted(map(tuple, out.collect()), key=str))
        return found, spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state").count()

    return run


def test_waits_time_out_while_the_stream_runs(batches):
    """A start mark of an early batch is given up when the watermark has passed its time, once; a late end mark changes nothing."""
    hour = 3_600_000_000
    parts = [
        [(1, at(0), 7, "click"), (2, at(0.5), 7, "click"), (3, at(1), 8, "click")],
        [(4, at(2), 8, "purchase"), (5, at(6), 9, "view")],
        [(6, at(9), 9, "view")],
        [(7, at(1.5), 7, "purchase"), (8, at(9.5), 7, "click"), (9, at(10), 7, "purchase")],
    ]
    found, left = batches(parts, lambda s: E.by_key(s, ["file"], E.BoundedWaits("click", "purchase", 3 * hour)))
    assert found[0] == [] and (8, 3, "done") in found[1]
    timed_out = [r for rows in found for r in rows if r[2] == "timed out"]
    assert sorted(timed_out) == [(7, 1, "timed out"), (7, 2, "timed out")] and not any(r[2] == "timed out" for r in found[3])
    assert found[3] == [(7, 8, "done")] and left == 0


def test_settled_is_said_when_a_key_ends(batches):
    hour = 3_600_000_000
    parts = [[(1, at(0), 1, "error"), (2, at(1), 1, "view"), (3, at(2), 1, "view"), (4, at(2), 2, "error")], [(5, at(12), 3, "view")], [(6, at(12.5), 3, "view")]]
    found, left = batches(parts, lambda s: E.by_key(s, ["file"], E.Settled("error", hour // 2, 4 * hour)))
    said = [r for rows in found for r in rows]
    assert said == [(1, int(at(1).timestamp() * 1e6))] and found[0] == [] and left == 1


def test_superseded_rows_are_taken_back(batches):
    parts = [[(101, at(0), 1, "a"), (102, at(1), 1, "a")], [(99, at(1.2), 1, "late cycle"), (201, at(1.5), 1, "a")], [(202, at(2), 1, "a")]]
    found, _ = batches(parts, lambda s: E.by_key(s.withColumn("cycle", F.expr("event_id div 100")), ["file"], E.LatestCycle("cycle")))
    assert found == [[(1, 101, 1), (1, 102, 1)], [(1, 101, -1), (1, 102, -1), (1, 201, 1)], [(1, 202, 1)]]


def test_state_of_many_keys_is_bounded(batches):
    """Each day's keys go with the next days; only the last ones stay."""
    day = lambda d: [(1000 * d + i, at(24 * d + i / 100), 1000 * d + i, "view") for i in range(200)]
    for processor in (E.Heartbeats(1_000_000, 6 * 3_600_000_000),):
        found, left = batches([day(d) for d in range(4)] + [[(9999, at(24 * 4), 1, "view")]], lambda s, p=processor: E.by_key(s, ["file"], p))
        assert sum(map(len, found)) == 801 and left <= 201


def test_pairs_over_batches(batches):
    parts = [[(1, at(0), 5, "click"), (2, at(1), 5, "click")], [(3, at(2), 5, "purchase"), (4, at(3), 5, "purchase"), (5, at(3.5), 5, "click")], [(6, at(60), 6, "view")], [(7, at(61), 5, "purchase")]]
    found, left = batches(parts, lambda s: E.by_key(s, ["file"], E.PairedMarks("click", "purchase")))
    assert [r for rows in found for r in rows] == [(5, 2, 3, 3_600_000_000, False), (5, 5, None, E.DAY_US, True)] and left == 0


def test_sessions_are_given_when_the_watermark_has_passed_their_end(spark, tmp_path):
    """In append mode: once each, joined over batches, and not before nothing more can come."""
    parts = [[(1, at(0), 7), (2, at(1), 7)], [(3, at(2.5), 7), (4, at(30), 8)], [(5, at(60), 9)], [(6, at(61), 9)]]
    said = []
    for i, rows in enumerate(parts):
        spark.createDataFrame([(e, t, u, "view", 1.0, None) for e, t, u in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        stream = E.read_events(spark, f"{tmp_path}/in{i}", spark.read.parquet(f"{tmp_path}/in{i}").schema, "1 hour", 1)
        E.run_to_table(E.quiet_sessions(stream, "user_id", "2 hours"), f"{tmp_path}/out", f"{tmp_path}/state")
        said.append(sorted((r.user_id, r.n, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert said == [[], [(7, 3, 3)], [(7, 3, 3), (8, 1, 4)], [(7, 3, 3), (8, 1, 4)]]


def test_keys_share_rows_of_state(batches, monkeypatch):
    """Many keys, among them one that is null and one beyond 2^53, in few rows of state: their values and times stay apart."""
    monkeypatch.setattr(E, "BUCKETS", 4)
    big = 2**53 + 1
    files = [*range(500), big, None]
    first = [(10 * i, at(i / 1000), f, "a") for i, f in enumerate(files)]
    again = [(10 * i + 1, at(2 + i / 1000), f, "a" if i % 2 else "b") for i, f in enumerate(files)]
    make = lambda s: E.by_key(s, ["file"], E.ChangedTokens("stage"))
    found, left = batches([first, again], make)
    assert found[0] == sorted(((f, 10 * i) for i, f in enumerate(files)), key=str)
    assert found[1] == sorted(((f, 10 * i + 1) for i, f in enumerate(files) if i % 2 == 0), key=str)
    assert 0 < left <= 8
