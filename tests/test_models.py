import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelbase.operators import dedup, keyvalue, queue, textsearch, timeseries, topics, vectors
from kestrelbase.operators.numbering import numbered
from kestrelbase.streaming import pipelines

BASE = datetime(2026, 8, 19, 10)


def test_time_series(spark):
    df = spark.createDataFrame([(BASE, "kitchen-1", 21.5), (BASE + timedelta(minutes=1), "kitchen-1", 22.5), (BASE + timedelta(minutes=1), "garage-1", 30.0)], "ts timestamp, device string, temperature double")
    q = timeseries.TimeQuery(df).range(BASE, BASE + timedelta(minutes=1)).tag("device", "kitchen-1")
    assert [r["temperature"] for r in q.all().collect()] == [21.5, 22.5]
    assert q.aggregate("temperature", 3600, "avg").first()["value"] == 22.0
    assert q.aggregate("nothing", 3600, "sum").first()["value"] == 0.0
    left, gone = timeseries.prune(df, BASE + timedelta(seconds=30))
    assert left.count() == 2 and gone.first()["removed"] == 1
    with pytest.raises(ValueError):
        q.aggregate("temperature", 0, "avg")


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "A small river engine that stores maps near the harbour"), (2, "Bread and soup from the kitchen across the square"), (3, "The engine of the river boat"), (4, None), (5, "!!")], "doc_id long, text string")
    hits = textsearch.bm25(docs, "small engine river", 5)
    assert hits.first()["doc_id"] == 1
    index = textsearch.build_index(docs)
    stored = textsearch.search_index(index, "small engine river", 5)
    assert [(r[0], round(r[1], 9)) for r in stored.collect()] == [(r["doc_id"], round(r["score"], 9)) for r in hits.collect()]
    assert 1 not in [r[0] for r in textsearch.search_index(textsearch.remove(index, docs.filter("doc_id = 1")), "small river", 5).collect()]
    assert textsearch.bm25(docs, "", 5).count() == 0 and index[1].count() == 3
    assert docs.select(textsearch.tokens(F.lit("Kestrels are Far-Sighted birds_2!"))).first()[0] == ["kestrels", "are", "far", "sighted", "birds", "2"]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, 140)).astype(np.float32)
    for dims in (16, 140):
        df = spark.createDataFrame([(i, x[i, :dims].tolist()) for i in range(200)] + [(900, [0.0] * dims), (901, [1.0]), (902, None)], "vec_id long, embedding array<float>")
        q = x[7, :dims].astype(float)
        v = np.vstack([x[:, :dims], np.zeros(dims)]).astype(float)
        names = [*range(200), 900]
        with np.errstate(invalid="ignore"):
            want = {"l2": np.linalg.norm(v - q, axis=1), "dot": -(v @ q), "cosine": np.nan_to_num(1 - (v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q)), nan=1.0)}
        for metric, d in want.items():
            got = [r["vec_id"] for r in vectors.top_k(df, q.tolist(), 5, metric=metric).collect()]
            assert got == [names[i] for i in np.argsort(d, kind="stable")[:5]]
    with pytest.raises(ValueError):
        vectors.distance(F.col("x"), [1.0], "taxi")


def test_inverted_file_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectors.inverted_file(df)
    asked = df.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    found = {}
    for r in index.search_all(asked, 10).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0).tolist():
        exact = np.lexsort((ids, vectors.distances(x, x[i], "cosine")))[:10]
        assert sorted(found[ids[i]]) == list(range(1, 11)) and found[ids[i]][1] == ids[i]
        hits += len(set(ids[exact].tolist()) & set(found[ids[i]].values()))
    assert len(found) == (ids % 20 == 0).sum() and hits / (10 * len(found)) >= 0.9
    one = index.search(rows[0][1], 10)
    assert {r["vec_id"] for r in one.collect()} == set(index.search_all(df.filter(F.col("vec_id") == int(ids[0])).select("vec_id", "embedding"), 10).toPandas()["vec_id"])
    # only the nearest cells' folders are read
    assert re.search(r"PartitionFilters: \[(isnotnull\(cell#\d+\), )?cell#\d+ IN", one._jdf.queryExecution().toString())


def test_batch_search_takes_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>").repartition(3)
    index = vectors.inverted_file(df, metric="l2", cells=5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search_all(df.filter("vec_id % 20 = 0 or vec_id > 800").select("vec_id", "embedding"), 4, probes=5).collect()}
    want = {(i, k + 1): int(v) for i in range(0, 300, 20) for k, v in enumerate(np.lexsort((np.arange(300), vectors.distances(x, x[i], "l2")))[:4])}
    assert got == want
    assert index.search_all(df.limit(0), 4).count() == 0
    none = vectors.inverted_file(df.limit(0))
    assert none.search([], 3).count() == 0 and none.search_all(df, 3).count() == 0


def test_broker_forgets_what_has_ended():
    b = queue.Broker(lease_seconds=1.0, dedup_seconds=5.0)
    for i in range(1000):
        b.apply(float(i), "enqueue", f"m{i}", {"dedup_id": f"d{i}", "max_retries": 1})
        b.apply(i + 0.2, "dequeue", None, {})
    b.tick(5000.0)
    assert (b.dead, b.seen, b.ends, b.flying, b.leases, b.held, b.delayed) == (1000, {}, [], {}, [], {}, [])
    assert vars(queue.Broker.load(b.dump())) == vars(b)


def broker_model(ops):
    """The same rules by looking at every message at every step."""
    held, seen, out = {}, {}, []
    for at, op, key, args in ops:
        for m in held.values():
            if m["state"] == "flying" and m["at"] <= at:
                m["state"], m["at"] = ("dead" if m["tries"] >= m["max"] else "ready"), min(m["at"], at)
        m = held.get(key)
        if op == "enqueue":
            dup = args.get("dedup_id")
            if dup is not None and seen.get(dup, at) > at:
                out.append((False, None))
                continue
            if dup is not None:
                seen[dup] = at + 3.0
            held[key] = {"state": "ready", "at": at + args.get("delay", 0.0), "priority": args.get("priority", 128), "max": args.get("max_retries", 5), "tries": 0, "end": at + args["ttl"] if "ttl" in args else None}
            out.append((True, key))
        elif op == "dequeue":
            open_ = [(-m["priority"], m["at"], k) for k, m in held.items() if m["state"] == "ready" and m["at"] <= at and (m["end"] is None or m["end"] > at)]
            if not open_:
                out.append((False, None))
                continue
            k = min(open_)[2]
            held[k].update(state="flying", tries=held[k]["tries"] + 1, at=at + args.get("lease", 2.0))
            out.append((True, k))
        elif m is None or m["state"] != "flying":
            out.append((False, key))
        else:
            out.append((True, key))
            if op == "ack":
                m["state"] = "done"
            elif op == "extend":
                m["at"] = at + args["by"]
            else:
                m.update(state="dead" if not args.get("requeue", True) or m["tries"] >= m["max"] else "ready", at=at)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_broker_against_a_model(seed):
    rnd, at, ops = random.Random(seed), 0.0, []
    for i in range(600):
        at += rnd.choice([0.0, 0.25, 0.5, 1.0])
        op = rnd.choice(["enqueue", "enqueue", "dequeue", "dequeue", "ack", "nack", "extend"])
        args = {"enqueue": lambda: {k: v for k, v in {"priority": rnd.randrange(3), "delay": rnd.choice([0.5, 2.0]), "ttl": 4.0, "max_retries": 2, "dedup_id": f"d{rnd.randrange(5)}"}.items() if rnd.random() < 0.4}, "nack": lambda: {"requeue": rnd.random() < 0.7}, "extend": lambda: {"by": 1.5}}.get(op, dict)()
        ops.append((at, op, f"m{i:04d}" if op == "enqueue" else f"m{rnd.randrange(max(0, i - 30), i + 1):04d}", args))
    b = queue.Broker(lease_seconds=2.0, dedup_seconds=3.0)
    assert [b.apply(*o) for o in ops] == broker_model(ops)


def test_key_value_replay_against_a_model(spark):
    rnd = random.Random(3)
    log, state, applied = [], {}, []
    for seq in range(600):
        key, op = f"k{rnd.randrange(8)}", rnd.choice(["put", "delete", "put_if_absent", "cas", "incr"])
        value, expected = str(rnd.randrange(5)), rnd.choice([None, str(rnd.randrange(5))])
        log.append((key, seq, op, value, expected))
        old = state.get(key)
        ok = {"put": True, "delete": old is not None, "put_if_absent": old is None, "cas": old == expected, "incr": True}[op]
        if op == "delete":
            state.pop(key, None)
        elif ok:
            state[key] = str(int(old or 0) + int(value)) if op == "incr" else value
        applied.append((key, seq, ok))
    results, final = keyvalue.replay(spark.createDataFrame(log, "key string, seq long, op string, value string, expected string"))
    assert sorted((r["key"], r["seq"], r["applied"]) for r in results.collect()) == sorted(applied)
    assert {r["key"]: r["value"] for r in final.collect()} == state


def test_key_value_views(spark):
    kv = spark.createDataFrame([(f"{p}:{i:03d}", i) for p in ("prod", "user") for i in range(50)], "key string, value int")
    assert keyvalue.scan_prefix(kv, "user:").count() == 50
    assert [r["value"] for r in keyvalue.scan_range(kv, "user:010", "user:020").collect()] == list(range(10, 20))
    assert keyvalue.scan_reverse(kv).first()["key"] == "user:049"
    log = spark.createDataFrame([("a", 1, "put", "x"), ("a", 2, "delete", None), ("b", 3, "put", "y"), ("b", 4, "put", "z")], "key string, seq long, op string, value string")
    assert [tuple(r)[0] for r in keyvalue.latest(log).select("value").collect()] == ["z"]


def test_queue_replay(spark):
    ops = [
        ("enqueue", "low", 0.0, '{"priority": 50}'), ("enqueue", "high", 0.0, '{"priority": 200, "delay": 5}'), ("enqueue", "mid", 0.0, "{}"), ("enqueue", "again", 0.0, '{"dedup_id": "d"}'), ("enqueue", "dup", 1.0, '{"dedup_id": "d"}'),
        ("dequeue", None, 2.0, '{"lease": 2}'), ("dequeue", None, 6.0, None), ("dequeue", None, 6.0, None), ("ack", "high", 6.5, None), ("ack", "high", 6.6, None), ("nack", "mid", 7.0, '{"requeue": false}'), ("dequeue", None, 7.0, None), ("dequeue", None, 8.0, None), ("dequeue", None, 9.0, None),
    ]
    log = spark.createDataFrame([("q", i, at, op, key, args) for i, (op, key, at, args) in enumerate(ops)], "queue string, seq long, at double, op string, id string, args string")
    got = [(r["applied"], r["id"]) for r in queue.replay(log).orderBy("seq").collect()]
    # the delayed one doesn't block; the lease of the first that was taken runs out and it comes back
    assert got[4] == (False, None) and got[5] == (True, "again") and got[6] == (True, "high") and got[8] == (True, "high") and got[9] == (False, "high")
    assert got[7][1] in ("mid", "again") and got[13][0] in (True, False) and {got[i][1] for i in (7, 11, 12)} <= {"mid", "again", "low"}


def test_queue_tables(spark):
    now = datetime(2024, 1, 1)
    rows = [(1, "q", 50, now, None, 0, 2, "ready"), (2, "q", 200, now, None, 0, 2, "ready"), (3, "q", 255, now + timedelta(1), None, 0, 2, "ready"), (4, "q", 255, now, now, 0, 2, "ready")]
    m = spark.createDataFrame(rows, "id long, queue string, priority int, visible_at timestamp, expire_at timestamp, retry_count int, max_retries int, state string")
    taken = queue.dequeue(m, now, 1)
    assert [r["id"] for r in taken.collect()] == [2]
    after = queue.lease(m, taken, now)
    assert after.filter("state = 'in_flight' and retry_count = 1 and id = 2").count() == 1
    assert queue.ack(after, taken).count() == 3 and queue.ack(after, m.filter("id = 1")).count() == 4
    assert queue.dead_letters(queue.nack(after, taken, requeue=False)).count() == 1
    assert queue.nack(after, taken).filter("state = 'ready'").count() == 4


@pytest.mark.parametrize(("pattern", "topic", "want"), [("a.*.c", "a.b.c", True), ("a.*.c", "a.b.d.c", False), ("a.>", "a", True), ("a.>", "a.b.c", True), ("a.>", "ab", False), (">", "x.y", True), ("a.b", "a.b", True), ("a.*", "a", False), ("a.>.z", "a.q", True)])
def test_topic_patterns(spark, pattern, topic, want):
    assert spark.createDataFrame([(topic,)], "topic string").select(topics.matches(F.col("topic"), pattern)).first()[0] is want


def test_bounded_buffers(spark):
    df = spark.createDataFrame([("s", i) for i in range(1, 4)], "subscriber string, seq int")
    assert sorted(r["seq"] for r in topics.bounded(df, 2, [F.col("seq")]).collect()) == [2, 3]
    assert sorted(r["seq"] for r in topics.bounded(df, 2, [F.col("seq")], "drop_newest").collect()) == [1, 2]
    assert topics.route(df.withColumn("topic", F.lit("a")), []).count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = numbered(df, ["k"], ["v"], F.floor(F.col("v") / 100)).collect()
    assert all(r["nth"] == r["v"] // 3 + 1 for r in got)


def test_dedup_against_a_model(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(5), BASE + timedelta(seconds=rnd.randrange(5000)), i) for i in range(800)]
    last, want = {}, []
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k] + timedelta(seconds=300):
            last[k] = t
            want.append(i)
    df = spark.createDataFrame(rows, "k int, ts timestamp, event_id long")
    assert sorted(r["event_id"] for r in dedup.fixed_window(df, ["k"], 300, tie="event_id").collect()) == sorted(want)


def test_streamed_rollup_keeps_late_data_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, BASE, 1.0), (2, BASE + timedelta(hours=5), 2.0)], "event_id long, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp, value double").parquet(src)
    out = pipelines.drain(pipelines.rollup(stream, "value", 3600, late="1 hour"))
    # append mode gives a window once the watermark has passed its end
    assert [(r["count"], r["total"]) for r in out.collect()] == [(1, 1.0)]


def test_streamed_queue_operations_are_those_of_the_replay(spark, tmp_path):
    rnd = random.Random(21)
    ops = []
    for i in range(400):
        op = rnd.choice(["enqueue", "enqueue", "dequeue", "ack", "nack", "extend"])
        args = {"enqueue": '{"priority": %d, "delay": %d, "dedup_id": "%d"}' % (rnd.randrange(9), rnd.randrange(3), rnd.randrange(60)), "extend": '{"by": 3}'}.get(op)
        ops.append((f"q{i % 3}", i, i / 2, op, f"m{i if op == 'enqueue' else rnd.randrange(400)}", args))
    schema = "queue string, seq long, at double, op string, id string, args string"
    for part in range(4):
        spark.createDataFrame(ops[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    want = queue.replay(spark.createDataFrame(ops, schema)).collect()
    assert sorted(map(tuple, pipelines.drain(pipelines.queue_operations(stream)).collect())) == sorted(map(tuple, want))
    assert {r["applied"] for r in want} == {True, False}
