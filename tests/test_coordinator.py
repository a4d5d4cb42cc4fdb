import random

import pytest
from pyspark.sql import functions as F

from weir.errors import IdempotencyConflict, InvalidReference, LeaseExpired, StaleAttempt, StorageUnavailable, UnsafeRecovery, WriterFenced
from weir.functions.canon import positions
from weir.operators import queue, replay
from weir.plans.coordinator import Coordinator
from weir.sources import event_log


def order(c):
    return [t.task_id for t in c.pending_tasks()]


def test_scheduling_order_and_yield_to_the_tail(tmp_path):
    """Ties in priority, in priority and key, and in all but the place in the queue."""
    c = Coordinator(str(tmp_path), lambda: 0.0)
    c.submit_tasks("one", [{"task_id": f"p{p}k{k}", "priority": p, "scheduling_key": k} for p in (3, 5) for k in (8, -4)] + [{"task_id": "twin", "priority": 5, "scheduling_key": -4}])
    want = ["p5k-4", "twin", "p5k8", "p3k-4", "p3k8"]
    assert order(c) == want
    _, leases = c.acquire("w", 3)
    assert [t for t, _ in leases] == want[:3]
    held = dict(leases)
    c.yield_tasks([{"task_id": "twin", "attempt": held["twin"]}, {"task_id": "p5k-4", "attempt": held["p5k-4"]}, {"task_id": "p5k8", "attempt": held["p5k8"], "priority": 3, "scheduling_key": -4}])
    assert order(c) == ["twin", "p5k-4", "p3k-4", "p5k8", "p3k8"]
    assert [t for t, _ in c.acquire("w", 9)[1]] == ["twin", "p5k-4", "p3k-4", "p5k8", "p3k8"]


def test_retry_keeps_its_place_and_attempts_run_out(tmp_path):
    now = [0.0]
    c = Coordinator(str(tmp_path), lambda: now[0], lease_seconds=5)
    c.submit_tasks("r", [{"task_id": "a", "max_attempts": 2}, {"task_id": "b"}])
    _, [(_, first)] = c.acquire("w")
    now[0] = 6
    with pytest.raises(LeaseExpired):
        c.complete_task("a", first, "s", "d", 1)
    assert c.acquire("w")[1][0][0] == "a"  # in its old place
    with pytest.raises(StaleAttempt):
        c.fail_task("a", first)
    now[0] = 20
    c.acquire("w", task_ids={"b"})
    assert c.state.tasks["a"].state == "failed" and c.metrics() == {"failed": 1, "leased": 1}


def test_receipts_answer_before_validation(tmp_path):
    c = Coordinator(str(tmp_path), lambda: 0.0)
    assert c.submit_tasks("r", [{"task_id": "a"}]) == c.submit_tasks("r", [{"task_id": "a"}])
    with pytest.raises(IdempotencyConflict):
        c.submit_tasks("r", [{"task_id": "z"}])
    _, [(t, a)] = c.acquire("w")
    got = c.complete_task(t, a, "s", "d", 1)
    assert c.complete_task(t, "any", "s", "d", 1) == got
    with pytest.raises(IdempotencyConflict):
        c.complete_task(t, a, "s", "other", 1)
    c.seal_input()
    assert c.read_commits() == ([got], 1, True) and c.acquire("w")[0] == "end_of_input"


def test_recovery_revokes_leases_and_fences(tmp_path):
    c = Coordinator(str(tmp_path), lambda: 0.0)
    c.submit_tasks("r", [{"task_id": "a", "input_ref": "x"}, {"task_id": "b"}])
    c.acquire("w", 1)
    again = Coordinator(str(tmp_path), lambda: 0.0)
    assert again.state.tasks["a"].failures == 1 and order(again) == ["a", "b"] and again.state.epoch == 1
    with pytest.raises(WriterFenced):
        c.seal_input()


def random_log(folder, seed):
    rng, now = random.Random(seed), [0.0]
    c = Coordinator(str(folder), lambda: now[0], lease_seconds=8)
    for k in range(60):
        now[0] += rng.random() * 3
        c.submit_tasks(f"r{k}", [{"task_id": f"t{k}-{i}", "priority": rng.randrange(3), "max_attempts": rng.randrange(1, 4), "input_ref": "x"} for i in range(rng.randrange(1, 4))])
        _, leases = c.acquire(f"w{rng.randrange(4)}", rng.randrange(1, 5))
        for t, a in leases:
            x = rng.random()
            if x < 0.3:
                c.complete_task(t, a, f"s-{t}", "d", 1, 10, 2)
            elif x < 0.5:
                c.fail_task(t, a, retryable=rng.random() < 0.7)
            elif x < 0.7:
                c.yield_tasks([{"task_id": t, "attempt": a, "priority": rng.randrange(3)}])
            elif x < 0.8:
                c.save_task_progress([{"task_id": t, "attempt": a, "input_ref": "y"}])
            elif x < 0.85:
                c.cancel_task(t)
        if k == 40:
            c = Coordinator(str(folder), lambda: now[0], lease_seconds=8)
            c.retire_worker("w1")
    return c


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_over_all_tasks_equals_the_sequential_fold(spark, tmp_path, seed):
    c = random_log(tmp_path, seed)
    log = event_log.read(spark, str(tmp_path)).where("task_id IS NOT NULL").repartition(5)
    got = replay.replay(log).join(replay.pending_order(log), "task_id").collect()
    assert len(got) == len(c.state.tasks)
    for r in got:
        t = c.state.tasks[r.task_id]
        assert (r.state, r.failures, r.lease_worker, r.generation, r.pending_order) == (t.state, t.failures, t.worker, t.generation, t.pending_order)
    commits = {r.task_id: r.position for r in replay.commit_positions(log).collect()}
    assert commits == {x["task_id"]: x["position"] for x in c.state.commits}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_number_a_total_order(spark, tmp_path, adaptive):
    """Many files and columns beside the order: no row may be lost, however the ranges are sampled and merged."""
    n = 500_000
    spark.range(n).selectExpr("id * 7919 % 500000 AS x", "id * 3 AS y", "concat('r', id) AS z").repartition(13).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = positions(spark.read.parquet(f"{tmp_path}/t"), ["x"], "p")
        assert got.columns == ["x", "y", "z", "p"]
        assert got.agg(F.count("*"), F.count_distinct("p"), F.count_if(F.col("p") != F.col("x"))).first()[:] == (n, n, 0)
        assert got.where("y <> 3 * cast(substr(z, 2) AS bigint) OR x <> y div 3 * 7919 % 500000").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_accounting_and_first_writer(spark):
    s = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b")], "submission_id string, seq int, digest string")
    assert [r.verdict for r in queue.accepted_once(s).orderBy("seq").collect()] == ["accepted", "receipt", "conflict"]
    with pytest.raises(ValueError):
        queue.commits_page(s, 0, 0)


def queue_with_commits(folder, n=6, **more):
    c = Coordinator(str(folder), lambda: 0.0, **more)
    c.submit_tasks("r", [{"task_id": f"t{k}", "input_ref": f"in{k}", "estimated_tokens": 9} for k in range(n + 2)], "maker", "state-1")
    for t, a in c.acquire("w", n)[1]:
        c.complete_task(t, a, f"s-{t}", f"out-{t}", 2, 10, 3)
    return c


def test_receipts_of_every_operation(tmp_path):
    c = Coordinator(str(tmp_path), lambda: 0.0)
    c.submit_tasks("r", [{"task_id": x, "max_attempts": 2} for x in "abcd"])
    (_, a), (_, b) = c.acquire("w", 2)[1]
    assert c.fail_task("a", a, request_id="f") == c.fail_task("a", a, request_id="f") == "pending"
    with pytest.raises(IdempotencyConflict):
        c.fail_task("a", a, retryable=False, request_id="f")
    for _ in range(2):
        c.save_task_progress([{"task_id": "b", "attempt": b, "input_ref": "x"}], request_id="p")
        assert c.release_tasks([("b", b), ("a", a)], request_id="l") == ["released", "StaleAttempt"]
        c.cancel_task("d", request_id="c")
    assert c.release_tasks([("b", b)], request_id="none") == ["StaleAttempt"] and "release:none" not in c.state.requests
    again = Coordinator(str(tmp_path), lambda: 0.0)  # receipts outlive the process
    assert again.fail_task("a", a, request_id="f") == "pending" and again.release_tasks([("b", b), ("a", a)], request_id="l")[0] == "released"
    with pytest.raises(StaleAttempt):
        again.yield_tasks([{"task_id": "b", "attempt": b}], request_id="y")
    with pytest.raises(ValueError):
        again.submit_tasks("r2", [{"task_id": "z"}], producer_id="p")


def test_heartbeat_drain_and_storage_failure(tmp_path):
    now = [0.0]
    c = Coordinator(str(tmp_path), lambda: now[0], lease_seconds=5)
    c.submit_tasks("r", [{"task_id": x} for x in "abc"])
    (_, a), (_, b) = c.acquire("w", 2)[1]
    now[0] = 4
    assert c.heartbeat([("a", a), ("b", "other")]) == ["extended", "StaleAttempt"]
    now[0] = 6
    assert c.heartbeat([("a", a), ("b", b)]) == ["extended", "LeaseExpired"]
    assert [t for t, _ in c.acquire("v", 5)[1]] == ["b", "c"]
    c.fail_task("a", a, failure={"category": "Quota"})
    for call in (lambda: c.acquire("w"), lambda: c.submit_tasks("q", [{"task_id": "z"}])):
        with pytest.raises(StorageUnavailable):
            call()
    again = Coordinator(str(tmp_path), lambda: now[0])
    assert again.acquire("w", 3)[0] == "acquired" and again.drain() == 3 and again.acquire("w")[0] == "draining"


def test_lookups_and_reads(tmp_path):
    c = queue_with_commits(tmp_path)
    assert c.lookup_submission("s-t1")["position"] == 1 and c.lookup_submission("none") is None
    assert c.task_status("t0")["state"] == "completed" and c.task_status("no") is None
    assert c.producer_state("maker") == "state-1" and c.load_consumer_state("x") is None and c.get_batch("b") is None
    [(t, a)] = c.acquire("w2")[1]
    assert c.outstanding_reads() == {a: {"task_id": t, "worker": "w2", "roots": ["in6"]}}
    c.save_task_progress([{"task_id": t, "attempt": a, "input_ref": "next"}])
    assert c.outstanding_reads()[a]["roots"] == ["in6", "next"] and {("reader", "in6"), ("reader", "next")} <= c.live_roots()
    with pytest.raises(StaleAttempt):
        c.release_task_reads([("t0", a)])
    c.release_task_reads([(t, a)])
    assert c.outstanding_reads() == {} and c.dump()["journal_sequence"] == c.log.next
    assert c.snapshot()["codec"] == "json.v1" and b'"t7"' in c.snapshot()["payload"]
    with pytest.raises(InvalidReference):
        c.complete_task(t, a, "s", "d", 1, made_by=[("other", a)])


def test_consumers_batches_and_checkpoints(tmp_path):
    c = queue_with_commits(tmp_path)
    token = c.open_consumer("training", "builder")
    with pytest.raises(UnsafeRecovery):
        c.open_consumer("training", "second")
    with pytest.raises(StaleAttempt):
        c.save_consumer_state("training", "x", 1, 0)
    c.plan_batch("b", "training", [4, 5], "plan")
    with pytest.raises(IdempotencyConflict):
        c.plan_batch("b", "training", [4], "plan")
    with pytest.raises(InvalidReference):
        c.register_checkpoint("k", "root", ["b"])
    with pytest.raises(InvalidReference):
        c.save_consumer_state("training", "x", 6, 0, finished=("b",), token=token)
    c.batch_ready("b", "training", "ready", 4, 20, 6)
    c.batch_ready("b", "training", "ready", 4, 20, 6)
    assert c.usage()["train_ready"] == {"records": 4, "bytes": 20, "tokens": 6} and c.usage()["accepted_unprocessed"]["records"] == 12
    first = c.save_consumer_state("training", "x", 6, 2, (4,), token=token, request_id="r")
    assert c.save_consumer_state("training", "x", 6, 2, (4,), token=token, request_id="r") == first == c.load_consumer_state("training")
    assert c.usage()["accepted_unprocessed"] == {"records": 6, "bytes": 30, "tokens": 9} and c.usage()["tokens"] == 9
    c.acquire("w")
    assert c.usage()["tokens"] == 18 and c.usage()["inflight"] == 1
    c.register_checkpoint("k", "root", ["b"])
    c.register_checkpoint("k", "root", ["b"])
    with pytest.raises(IdempotencyConflict):
        c.register_checkpoint("k", "other", ["b"])
    assert c.usage()["train_ready"]["records"] == 0 and ("checkpoint", "root") in c.live_roots()
    c.release_checkpoint("k")
    assert c.usage()["train_ready"]["records"] == 4
    c.close_consumer("training", token)
    c.open_consumer("training", "second")


def test_history_is_retired_and_rewound(tmp_path):
    asked = []
    c = queue_with_commits(tmp_path, reactivate=lambda roots: asked.append(roots) or len(roots) < 3)
    c.save_consumer_state("training", "x", 6, 3, (4,))
    assert c.collect_garbage(lambda live: {"live": live})["live"] >= {"out-t3", "out-t5", "x", "state-1"} and "out-t4" not in c.collect_garbage(set)
    for cursor in (0, 2, 3, 4):
        with pytest.raises(InvalidReference):
            c.read_commits(cursor)
    assert [r["position"] for r in c.read_commits(5)[0]] == [5] and [r["position"] for r in c.read_commits(3, 1)[0]] == [3]
    assert c.lookup_submission("s-t0")["position"] == 0  # receipts stay
    with pytest.raises(UnsafeRecovery):
        c.save_consumer_state("training", "x", 6, 0, (4,))
    c.save_consumer_state("training", "x", 6, 2)
    assert asked == [["out-t0", "out-t1", "out-t2"], ["out-t2", "out-t4"]]
    assert [r["position"] for r in c.read_commits(2)[0]] == [2, 3, 4, 5]
    again = Coordinator(str(tmp_path), lambda: 0.0)
    assert again.state.retired_prefix == 2 and again.state.retired_positions == []
