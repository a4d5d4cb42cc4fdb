from weir.sources import event_log
from weir.streaming import commit_stream, task_state

from tests.test_coordinator import random_log


def test_stream_of_a_log_equals_its_fold(spark, tmp_path):
    c = random_log(tmp_path / "log", 3)
    events = event_log.stream(spark, str(tmp_path / "log")).where("task_id IS NOT NULL")
    q = task_state.task_states(events).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("SELECT * FROM states").collect():
        if r.task_id not in last or r.seq >= last[r.task_id].seq:
            last[r.task_id] = r
    assert {k: (r.state, r.failures) for k, r in last.items()} == {k: (t.state, t.failures) for k, t in c.state.tasks.items()}


def test_stale_attempts_are_dropped():
    now = task_state.NEW
    for e in [
        {"type": "Submitted", "max_attempts": 2, "seq": 0}, {"type": "Leased", "attempt": "a", "seq": 1}, {"type": "Expired", "attempt": "a", "seq": 2},
        {"type": "Leased", "attempt": "b", "seq": 3}, {"type": "Completed", "attempt": "a", "seq": 4},
    ]:
        now = task_state.step(now, e)
    assert now[:2] == ("leased", 1)


def test_commits_are_accepted_once_over_runs(spark, tmp_path):
    c = random_log(tmp_path / "log", 4)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        commit_stream.run_once(commit_stream.accepted(event_log.stream(spark, str(tmp_path / "log"))), out, mark)
    got = sorted(r.submission_id for r in spark.read.parquet(out).collect())
    assert got == sorted(c.state.submissions)


def test_raw_repeats_and_traffic(spark, tmp_path):
    rows = [(k, 0, "Completed", f"t{k % 3}", f"s{k % 3}", "d", f"2024-01-01 00:00:0{k}") for k in range(6)]
    spark.createDataFrame(rows, "seq bigint, idx int, type string, task_id string, submission_id string, digest string, at string").write.json(str(tmp_path / "raw"))
    raw = spark.readStream.schema("seq bigint, idx int, type string, task_id string, submission_id string, digest string, at timestamp").json(str(tmp_path / "raw"))
    commit_stream.run_once(commit_stream.accepted_raw(raw, "at", "1 minute"), str(tmp_path / "o"), str(tmp_path / "m"))
    assert sorted(r.submission_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["s0", "s1", "s2"]
    spark.createDataFrame([("write", float(t), 7) for t in (0, 3, 11, 500)], "op string, second double, bytes bigint").write.json(str(tmp_path / "t"))
    traces = spark.readStream.schema("op string, second double, bytes bigint").json(str(tmp_path / "t"))
    q = commit_stream.traffic(traces, 10).writeStream.format("memory").queryName("traffic").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.second + 60 * r.start.minute, r.bytes) for r in spark.sql("SELECT * FROM traffic").collect()) == [(0, 14), (10, 7), (500, 7)]
