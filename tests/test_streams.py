"""Streams over several batches, with late and re-sent rows and restarts."""
from datetime import datetime

from pyspark.sql import functions as F

from rolewright.streaming import jobs

EVENT = "run_id string, node string, status string, ts timestamp, seq int, ms double"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def at(spark, rows):
    """Rows with hours since midnight in the place of ``ts``."""
    return [(r, n, s, datetime(2024, 1, 1, int(h), round(h % 1 * 60)), i, 1.0) for r, n, s, h, i in rows]


def test_stages_are_paired_or_time_out_over_batches_and_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    go = lambda: jobs.finish(jobs.start_durations(jobs.read_landing(spark, folder, EVENT, max_files=1), out, state, timeout="1 hour", late="2 hours"))
    land(spark, folder, at(spark, [("a", "x", "start", 1, 1), ("a", "y", "start", 1, 2), ("a", "x", "done", 1.5, 3), ("a", "x", "done", 1.75, 4)]), EVENT)
    go()
    land(spark, folder, at(spark, [("a", "y", "failed", 1.9, 5), ("b", "x", "start", 2, 6), ("b", "x", "start", 9, 7), ("c", "x", "done", 9, 8)]), EVENT)
    go()
    land(spark, folder, at(spark, [("b", "x", "done", 2.5, 9), ("b", "x", "done", 9.25, 10), ("c", "x", "start", 9.5, 11)]), EVENT)
    go()
    got = {(r.run_id, r.node, r.start_seq): (r.ms, r.status) for r in jobs.stage_durations(spark, out).collect()}
    # the end of b's first start came when the watermark had passed it; c's start may still end
    assert got == {("a", "x", 1): (1_800_000, "done"), ("a", "y", 2): (3_240_000, "failed"), ("b", "x", 6): (None, "timed out"), ("b", "x", 7): (900_000, "done")}


def test_windows_keep_their_last_version_and_drop_late_events(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    go = lambda: jobs.finish(jobs.start_windows(jobs.read_landing(spark, folder, EVENT, max_files=1), out, state, window="1 hour", late="1 hour"))
    land(spark, folder, at(spark, [("a", "x", "one", 1, 1), ("a", "x", "two", 1.5, 2)]), EVENT)
    land(spark, folder, at(spark, [("a", "x", "three", 1.25, 3), ("a", "x", "four", 8, 4)]), EVENT)
    go()
    land(spark, folder, at(spark, [("a", "x", "late", 1.25, 9), ("a", "x", "five", 8.5, 5)]), EVENT)
    go()
    got = sorted((r.window_start.hour, r.n_events, r.last_status) for r in jobs.current_windows(spark, out).collect())
    assert got == [(1, 3, "three"), (8, 2, "five")]


def test_a_posting_that_is_sent_again_replaces_its_pairs(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    schema = "job_id string, skills array<string>, sent int"
    mine = spark.createDataFrame([("c", ["a", "b", "d"])], "cv_id string, skills array<string>")
    go = lambda: jobs.finish(
        jobs.start_scoring(jobs.read_landing(spark, folder, schema, max_files=1), mine, lambda b: b.select("job_id", "skills"), out, state, lambda n: F.lit(2), event_time="sent")
    )
    land(spark, folder, [("j", ["a", "b"], 1), ("k", ["a", "d"], 1), ("k", ["x"], 0), ("l", ["a", "b", "d"], 1)], schema)
    land(spark, folder, [("j", ["x"], 2)], schema)
    go()
    assert {(r.job_id, r.n_overlap) for r in jobs.current_pairs(spark, out).collect()} == {("k", 2), ("l", 3)}
    land(spark, folder, [("j", ["b", "d", "z"], 3), ("l", ["a", "b"], 3)], schema)
    go()
    assert {(r.cv_id, r.job_id, r.n_overlap) for r in jobs.current_pairs(spark, out).collect()} == {("c", "j", 2), ("c", "k", 2), ("c", "l", 2)}
