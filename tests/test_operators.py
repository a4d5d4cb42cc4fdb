import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.functions import canon
from weir.operators import profile, retention, store, tensors


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_peaks_of_traces(spark):
    rows = [("write", 40.0, 700, None), ("write", 40.99, 50, None), ("write", 49.5, 200, None), ("write", 50.0, 640, None), ("read_range", 41.0, 10, 64), ("read_range", 42.0, 10, 128), ("read", 41.0, 1, None)]
    t = spark.createDataFrame(rows, "op string, second double, bytes bigint, checked_bytes bigint")
    assert profile.peak(t, 1).first()[:] == (750, 3)
    assert profile.peak(t, 10).first()[:] == (950, 2)
    assert profile.peak(t, 10, "read_range", checked=True).first().peak_bytes == 192
    assert profile.peak(t, 10, "read", checked=True).first().peak_bytes is None and profile.peak(t, 10, "none").first()[:] == (0, 0)
    assert profile.completion_peak(t, 10).first()[0] == 950 / 10 / 2**20
    p = {r.op: r for r in profile.profile(t).collect()}
    assert p["read_range"].checked_bytes == 192 and p["write"].checked_bytes is None


def test_percentiles_are_not_interpolated(spark):
    t = spark.createDataFrame([("a", x) for x in [5, 1, 3, 3, 9]], "g string, v bigint")
    for q in (0, 50, 80, 99, 100):
        r = profile.percentiles(t, "g", "v", q).first()
        s = sorted([5, 1, 3, 3, 9])
        assert r.floor_index == s[min(4, q * 4 // 100)] and r.nearest_rank == s[max(0, -(-5 * q // 100) - 1)]


@pytest.mark.parametrize("value,ok", [("-1", False), (str(2**64), False), (str(2**64 - 1), True), ("0.5", False), ("0", True), ("true", False), (None, False)])
def test_counters(spark, value, ok):
    assert one(spark, canon.valid_counter(F.lit(value).cast("string"))) is ok


def test_spans_paths_and_digests(spark):
    span = lambda a, b, n: one(spark, canon.authenticated_span(F.lit(a), F.lit(b), F.lit(4), F.lit(n)))
    assert tuple(span(3, 9, 10)) == (0, 10) and tuple(span(4, 8, 10)) == (4, 8) and tuple(span(5, 5, 10)) == (5, 5)
    assert span(6, 5, 10) is None and span(0, 11, 10) is None
    good = [one(spark, canon.plain_path(F.lit(p))) for p in ("a/b.pack", "a", "..a/b")]
    bad = [one(spark, canon.plain_path(F.lit(p))) for p in ("/a", "a/../b", "a//b", "a\\b", "", "./a", "a/")]
    assert all(good) and not any(bad)
    got = one(spark, canon.digest({"b": F.lit(None).cast("string"), "a": F.lit(1)}))
    assert got == hashlib.sha256(b'{"a":1,"b":null}').hexdigest()
    assert one(spark, canon.request_key(F.lit("op"), F.lit('i"d'))) == '["op","i\\"d"]' and one(spark, canon.request_key(F.lit("op"), F.lit(""))) is None
    assert one(spark, canon.checked_add(F.lit(2**63 - 1), F.lit(2**63 - 1))) == 2**64 - 2


def test_shared_dependencies_count_each_time(spark, tmp_path):
    records = spark.createDataFrame([(p, 0, f"{p}", 10, 1, "c") for p in (1, 2, 3, 4)], "pub int, ordinal int, record_id string, bytes int, tokens int, codec string")
    edges = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1)], "pub int, dep int")
    got = {r.pub: (r.records, r.payload_bytes, r.tokens) for r in store.result_usage(records, edges).collect()}
    assert got == {1: (1, 10, 1), 2: (1, 20, 2), 3: (1, 20, 2), 4: (1, 50, 5)}


def test_rotation_with_target_zero_and_oversize(spark):
    p = spark.createDataFrame([(0, k, s) for k, s in enumerate([5, 100, 5, 5, 20])], "writer int, seq int, size int")
    packs = lambda n: [r.pack for r in store.pack_rotation(p, n).orderBy("seq").collect()]
    assert packs(0) == [0, 1, 2, 3, 4] and packs(30) == [0, 1, 2, 2, 2] and packs(20) == [0, 1, 2, 2, 3]


def test_two_byte_floats_and_layouts(spark):
    x = np.array([1.5, -2.0, 0.25], np.float32)
    bf = (x.view(np.uint32) >> 16).astype("<u2").tobytes()
    df = spark.createDataFrame([(bf, x.astype("<f2").tobytes(), struct.pack("<3q", 1, -2, 3))], "b binary, h binary, i binary")
    r = df.select(tensors.decode("bfloat16")("b").alias("b"), tensors.decode("float16")("h").alias("h"), tensors.decode("int64")("i").alias("i")).first()
    assert r.b == r.h == x.tolist() and r.i == [1.0, -2.0, 3.0]
    with pytest.raises(TypeError):
        tensors.decode("complex64")
    t = spark.createDataFrame([(1, [2, 3], "int16", 12), (2, [2, 3], "int16", 13), (3, [2], "text", 2), (4, [], "bool", 1)], "id int, shape array<bigint>, dtype string, nbytes bigint")
    assert [r.id for r in tensors.layout_errors(t).orderBy("id").collect()] == [2, 3]


def test_ranges_touch_only_their_chunks_and_see_damage(spark):
    blobs = spark.createDataFrame([(1, b"abcdefghij"), (2, b"")], "id int, payload binary")
    chunks = tensors.chunk_table(blobs, "id", "payload", 4)
    asked = spark.createDataFrame([(0, 1, 3, 9), (1, 1, 0, 1), (2, 1, 5, 5)], "pos int, id int, start bigint, stop bigint")
    got = {r.pos: (bytes(r.bytes), r.intact) for r in tensors.read_ranges(asked, chunks, "id", 4).collect()}
    assert got == {0: (b"defghi", True), 1: (b"a", True)}
    bad = chunks.withColumn("data", F.when(F.col("chunk") == 2, F.lit(b"XX")).otherwise(F.col("data")))
    assert {r.pos: r.intact for r in tensors.read_ranges(asked, bad, "id", 4).collect()} == {0: False, 1: True}


def test_ownership_sets(spark):
    owned = spark.createDataFrame([("o:1", 1), ("p:1", 2)], "owner string, pack int")
    edges = spark.createDataFrame([(5, 6), (6, 5)], "parent int, child int")
    places = spark.createDataFrame([(5, 50), (6, 60)], "node int, pack int")
    roots = spark.createDataFrame([(5,)], "root int")
    rows = lambda df: sorted((r.owner, r.pack) for r in df.collect())
    assert rows(retention.retained(owned, "o:1", roots, edges, places)) == [("o:1", 50), ("o:1", 60), ("p:1", 2)]
    assert rows(retention.released(owned, "o:1")) == [("p:1", 2)]
    assert rows(retention.held_too(owned, "o:1", spark.createDataFrame([(1,), (3,)], "pack int"))) == [("o:1", 1), ("o:1", 3), ("p:1", 2)]


def test_publication_is_idempotent(spark, tmp_path):
    from weir.errors import IdempotencyConflict, InvalidReference
    from weir.operators import publish

    schema = "pub int, ordinal int, record_id string, payload binary, codec string, tokens int"
    one_ = spark.createDataFrame([(0, 0, "a", b"x", "bytes.v1", 1), (0, 1, "b", b"y", "bytes.v1", 1), (1, 0, "c", b"z", "bytes.v1", 1)], schema)
    first = publish.publish_many(one_, str(tmp_path), "s").collect()
    assert sorted(publish.publish_many(one_, str(tmp_path), "s").collect()) == sorted(first)
    with pytest.raises(IdempotencyConflict):
        publish.publish_many(one_.withColumn("payload", F.lit(b"q")), str(tmp_path), "s")
    with pytest.raises(ValueError):
        publish.publish_many(one_.union(one_), str(tmp_path), "t")
    assert [bytes(r.payload) for r in publish.read_published(spark, str(tmp_path), "s", 0, verify=True).collect()] == [b"x", b"y"]
    with pytest.raises(InvalidReference):
        publish.read_published(spark, str(tmp_path), "none", 0)
    r = publish.tensor_record("t", np.arange(6, dtype=np.int16).reshape(2, 3), chunk=8)
    assert r["nbytes"] == 12 and len(r["digests"]) == 2 and r["shape"] == [2, 3]
    with pytest.raises(TypeError):
        publish.tensor_record("t", np.array([1j]))


def test_a_published_set_with_dependencies(spark, tmp_path):
    from weir.errors import IdempotencyConflict, InvalidReference
    from weir.operators import publish

    schema = "pub int, ordinal int, record_id string, payload binary, codec string, tokens int"
    rows = [(p, k, f"{p}:{k}", bytes([p, k]), "bytes.v1", 1) for p in range(4) for k in range(2)]
    records = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([(3, 1, 0), (3, 2, 1), (1, 0, 0), (2, 0, 0)], "pub int, dep int, ord int")
    first = {r.pub: r.digest for r in publish.publish_many(records, str(tmp_path), "s", edges).collect()}
    assert {r.pub: r.digest for r in publish.publish_many(records, str(tmp_path), "s", edges).collect()} == first
    turned = spark.createDataFrame([(3, 2, 0), (3, 1, 1), (1, 0, 0), (2, 0, 0)], "pub int, dep int, ord int")
    for other in (None, turned):  # other dependencies, or in another order
        with pytest.raises(IdempotencyConflict):
            publish.publish_many(records, str(tmp_path), "s", other)
    with pytest.raises(InvalidReference):
        store.logical_digest(records.withColumn("bytes", F.lit(2)), spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "pub int, dep int, ord int"), levels=5)
    # a change deep down changes the digests of all that depend on it, and of no other
    changed = records.withColumn("payload", F.when(F.expr("pub = 2 AND ordinal = 1"), F.lit(b"!")).otherwise(F.col("payload")))
    now = {r.pub: r.digest for r in publish.publish_many(changed, str(tmp_path), "t", edges).collect()}
    assert {p for p in first if first[p] != now[p]} == {2, 3}
    assert [r.submission_id for r in publish.discover(spark, str(tmp_path)).collect()] == ["s", "t"]
    (tmp_path / "submission=begun" / "records").mkdir(parents=True)
    assert publish.discover(spark, str(tmp_path)).count() == 2

    x = np.array([2**60 + 1, -5], np.int64)
    publish.publish_tensors(spark, {"w": x, "b": np.zeros((2, 3), np.float32)}, str(tmp_path), "tensors", "model")
    got = publish.read_published(spark, str(tmp_path), "tensors", 0, verify=True).collect()
    assert [(r.record_id, r.shape, r.dtype) for r in got] == [("model:w", [2], "int64"), ("model:b", [2, 3], "float32")]
    back = spark.createDataFrame([(bytes(got[0].payload),)], "b binary").select(tensors.decode("int64")("b").alias("x")).first().x
    assert back == x.tolist()  # no digit is lost
    publish.write_report(spark, {"b": 1, "a": [2]}, f"{tmp_path}/report.json")
    publish.write_report(spark, {"b": 2}, f"{tmp_path}/report.json")
    assert (tmp_path / "report.json").read_text() == '{"b": 2}'


def test_records_are_read_and_checked(spark):
    good = hashlib.sha256(b"x").hexdigest()
    records = spark.createDataFrame([("s", 0, b"x", good, 7), ("s", 1, b"y", good, 7)], "segment string, ordinal int, payload binary, checksum string, pub int")
    refs = spark.createDataFrame([("s", 1), ("s", 0), ("s", 5)], "segment string, ordinal int")
    assert {r.ordinal: r.intact for r in store.read_record(refs, records, ["segment", "ordinal"]).collect()} == {0: True, 1: False}
    assert [r.ordinal for r in store.read(records, 7).collect()] == [0, 1]


def test_validation_finds_foreign_records_and_tainted_sets(spark):
    rows = [(p, k, f"{p}{k}", 5, 1, "c", "m", f"task{p}", "a" if (p, k) != (2, 1) else "b") for p in (1, 2, 3, 4) for k in (0, 1)]
    records = spark.createDataFrame(rows, "pub int, ordinal int, record_id string, bytes int, tokens int, codec string, metadata string, task_id string, attempt_id string")
    own = store.usage(records).join(store.logical_digest(records).drop("records"), "pub")
    own = own.withColumn("task_id", F.concat(F.lit("task"), "pub")).withColumn("attempt_id", F.lit("a"))
    assert [tuple(r) for r in store.validate(records, own).collect()] == [(2, "foreign")]
    edges = spark.createDataFrame([(3, 2), (4, 3), (1, 1)], "pub int, dep int")
    assert {tuple(r) for r in store.validate_closure(records, own, edges).collect()} == {(2, "foreign"), (3, "dependency"), (4, "dependency")}
    lost = store.validate_closure(records.where("pub <> 2"), own.where("pub <> 2"), edges)
    assert {tuple(r) for r in lost.collect()} == {(3, "dependency"), (4, "dependency")}
    other = records.withColumn("metadata", F.lit("n"))
    assert {r.pub for r in store.validate(other, own).collect()} == {1, 2, 3, 4}
    tricky = spark.createDataFrame([(1, 0, 'a","codec":"x', 5, 1, "c"), (2, 0, "a", 5, 1, 'x","record_id":"c')], "pub int, ordinal int, record_id string, bytes int, tokens int, codec string")
    assert len({r.digest for r in store.logical_digest(tricky).collect()}) == 2


def test_ownership_through_its_operations(spark):
    from weir.errors import UnsafeRecovery

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = frame([(1, 2), (2, 3), (4, 5), (5, 4)], "parent int, child int")
    places = frame([(k, 10 * k) for k in range(1, 7)], "node int, pack int")
    gone = frame([(60,)], "pack int")
    own = retention.Ownership(frame([("staged:1", 10), ("staged:2", 20), ("staged:4", 40), ("app:x", 30)], "owner string, pack int"), edges, places, gone)
    packs = lambda o: sorted(r.pack for r in own.owned.where(F.col("owner") == o).collect())
    own.retain("app:y", frame([(2,)], "root int"))
    assert packs("app:y") == [20, 30]
    own.retain("app:y", frame([(4,)], "root int"))
    assert packs("app:y") == [40, 50]  # a cycle, in place of what it held
    with pytest.raises(UnsafeRecovery):
        own.retain("app:z", frame([(6,)], "root int"))
    with own.pin("r", frame([(1,)], "root int")):
        assert packs("reader:r") == [10, 20, 30]
    assert packs("reader:r") == []
    own.release_publications(frame([(1,)], "node int"))
    assert sorted({r.owner for r in own.owned.collect()}) == ["app:x", "app:y", "staged:4"]
    left = retention.released_tensor_publications(own.owned, frame([(4, 0), (4, 1)], "pub int, ordinal int"), edges)
    assert sorted({r.owner for r in left.collect()}) == ["app:x", "app:y"]
    assert sorted(r.handoff for r in retention.handoffs_once(frame([("a",), ("a",), ("b",)], "handoff string"), frame([("b",)], "handoff string")).collect()) == ["a"]


def test_a_queue_collects_only_what_no_live_root_needs(spark):
    from weir.errors import UnsafeRecovery

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    owners = frame([("queue:a", 1), ("queue:b", 2), ("app:c", 3)], "owner string, root int")
    edges, places = frame([(2, 3)], "parent int, child int"), frame([(1, 10), (2, 20), (3, 30), (4, 40)], "node int, pack int")
    packs, none = frame([(10, True), (20, True), (30, True), (40, False)], "pack int, sealed boolean"), frame([], "pack int")
    stay, gone = retention.queue_collection(owners, frame([("queue:a", 1)], "owner string, root int"), "queue:", edges, places, packs, none)
    assert sorted(r.owner for r in stay.collect()) == ["app:c", "queue:a"] and [r.pack for r in gone.collect()] == [20]
    for live in ([("queue:x", 4)], [("queue:x", 9)]):
        with pytest.raises(UnsafeRecovery):
            retention.queue_collection(owners, frame(live, "owner string, root int"), "queue:", edges, places, packs, none)
    held = frame([(10,)], "pack int")
    found, digest = retention.orphan_report(packs, held)
    assert {(r.pack, r.kind) for r in found.collect()} == {(20, "sealed"), (30, "sealed"), (40, "partial")}
    assert retention.cleanup_orphans(packs, held, digest, stopped=True).count() == 3
    for bad in ({"stopped": False}, {"stopped": True, "errors": 1}):
        with pytest.raises(UnsafeRecovery):
            retention.cleanup_orphans(packs, held, digest, **bad)
    with pytest.raises(UnsafeRecovery):
        retention.cleanup_orphans(packs, frame([(20,)], "pack int"), digest, stopped=True)


def test_small_functions(spark, tmp_path):
    from weir.operators import publish
    from weir.sources import event_log

    assert [one(spark, canon.clip(F.lit(x), F.lit(2), F.lit(5))) for x in (1, 3, 9)] == [2, 3, 5]
    assert [one(spark, canon.hex_key(F.lit(x).cast("string"))) for x in ("0a" * 32, "0A" * 32, "0a" * 31, None)] == [True, False, False, False]
    layout = lambda *x: one(spark, canon.same_layout(*[F.lit(v) for v in x]))
    assert layout("s", "f", 4, "s", "f", 4) and not layout("s", "f", 4, "s", "f", 8)
    t = spark.createDataFrame([("write", 3.5, 9, None, "h")], "op string, time double, bytes bigint, checked_bytes bigint, host string")
    publish.emit(t, f"{tmp_path}/traces")
    publish.emit(t, f"{tmp_path}/traces")
    assert [(r.second, r.bytes) for r in event_log.traces(spark, f"{tmp_path}/traces/*.json").collect()] == [(3.5, 9)] * 2
    with pytest.raises(ValueError):
        store.retire_writer(t, t, 1, "forget")
