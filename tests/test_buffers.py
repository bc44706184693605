"""Pools and ledgers on streams against all rows at once."""

import heapq
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.streaming import buffers


def run(spark, parts, schema, made, path, mode):
    """The rows that a stream of the parts gives, with the number of their batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))

    def each(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(path / "out" / f"n={n}"))

    with buffers.rocks_state(spark):
        q = made(stream).writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return spark.read.parquet(str(path / "out")).drop("n")


def pool_by_hand(rows, most, age):
    """Entries as they come in order, each addition followed by both evictions."""
    pools = {}
    for pool, step, seq, text in sorted(rows, key=lambda r: (r[1], r[2])):
        pools.setdefault(pool, []).append((step, seq, text))
        pools[pool] = [e for e in pools[pool] if age is None or step - e[0] <= age][-most:]
    return sorted((p, *e) for p, v in pools.items() for e in v)


@pytest.mark.parametrize(("most", "age"), [(5, None), (40, 3), (3, 0)])
def test_a_streamed_pool_equals_the_batch(spark, tmp_path, most, age):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.randint(0, 20), i, f"t{i}") for i in range(150)]
    rng.shuffle(rows)
    schema = "pool string, step long, seq long, text string"
    changes = run(spark, [rows[:50], rows[50:] + rows[:9], rows[20:30]], schema, lambda s: buffers.pool_changes(s, most, age, 3), tmp_path, "update")
    got = sorted(tuple(r) for r in buffers.pool_of(changes, "batch", most, age).select("pool", "step", "seq", "text").collect())
    want = sorted(tuple(r) for r in buffers.pool_batch(spark.createDataFrame(rows, schema), most, age).select("pool", "step", "seq", "text").collect())
    assert got == want == pool_by_hand(rows, most, age)
    assert changes.where("change = 'out'").count() > 0


def test_entries_without_room_stay_out(spark):
    rows = spark.createDataFrame([(1, 3600), (2, 3687), (3, 3688), (4, 5000)], "seq int, length int")
    assert [r.seq for r in buffers.with_room(rows, "length", 4096, 0.1).orderBy("seq").collect()] == [1, 2]


def ledger_by_clock(events, most, patience, upto):
    """Millisecond by millisecond."""
    waiting, flying, closed, out = [], {}, False, []
    by_time = {}
    for e in buffers._in_order(events):
        by_time.setdefault(e[0], []).append(e)

    def send(t):
        while waiting and len(flying) < most:
            asked, i = heapq.heappop(waiting)
            flying[i] = t
            out.append((i, "sent", t, t - asked))

    for t in range(upto + 1):
        for i in sorted(i for i, s in flying.items() if s + patience == t):
            del flying[i]
            out.append((i, "expired", t, patience))
            send(t)
        for _, i, kind in by_time.get(t, []):
            if kind == "drain":
                closed = True
            elif kind == "request" and (i in flying or i in {j for _, j in waiting}):
                out.append((i, "repeated", t, 0))
            elif kind == "request" and closed:
                out.append((i, "refused", t, 0))
            elif kind == "request":
                heapq.heappush(waiting, (t, i))
                send(t)
            elif i in flying:
                out.append((i, "answered" if kind == "answer" else "failed", t, t - flying.pop(i)))
                send(t)
            else:
                out.append((i, "stale", t, 0))
    return out


def requests(seed, n=120):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = rng.randint(0, 900)
        out.append((at, f"r{i % 90}", "request"))
        if rng.random() < 0.8:
            out.append((at + rng.randint(1, 120), f"r{i % 90}", rng.choice(["answer", "failure"])))
    return list(dict.fromkeys([*out, (850, "", "drain")]))


@pytest.mark.parametrize(("seed", "most", "patience"), [(1, 1, 40), (2, 4, 15), (3, 50, 200)])
def test_a_ledger_equals_a_clock(seed, most, patience):
    events = requests(seed)
    ledger = buffers.Ledger(most, patience)
    done = []
    for after, upto in ((-1, 300), (300, 700), (700, 9000)):
        done += ledger.advance([e for e in buffers._in_order(events) if after < e[0] <= upto], upto)
        assert len(ledger.flying) <= most
    assert done == ledger_by_clock(events, most, patience, 9000)
    assert not ledger.waiting and not ledger.flying


def test_a_streamed_ledger_equals_the_batch(spark, tmp_path):
    events = [(w, at, i, kind) for w, seed in (("u", 5), ("v", 6)) for at, i, kind in requests(seed, 60)]
    random.Random(0).shuffle(events)
    events.append(("end", 5000, "x", "request"))
    rows = spark.createDataFrame(events, "worker string, at long, id string, kind string")
    want = sorted(tuple(r) for r in buffers.ledger_batch(rows, 3, 60, 2000).collect())
    # The newest event comes last, so that none is late.
    got = run(spark, [events[0:-1:2], events[1:-1:2], events[-1:]], "worker string, at long, id string, kind string", lambda s: buffers.ledger_stream(s.withColumn("ts", F.timestamp_millis("at")).drop("at"), 3, 60, "3 seconds"), tmp_path, "append")
    assert sorted(tuple(r) for r in got.drop("batch").where("worker <> 'end' and at <= 2000").collect()) == want


def test_a_long_queue_takes_no_search_a_request():
    began, ledger = time.monotonic(), buffers.Ledger(1, 10)
    out = ledger.advance([(i, str(i), "request") for i in range(40_000)], 1 << 60)
    assert Counter(what for _, what, _, _ in out) == {"sent": 40_000, "expired": 40_000} and out[-1] == ("39999", "expired", 400_000, 10)
    assert time.monotonic() - began < 10


def test_a_worker_is_no_group_of_a_task(spark):
    """Its events come sorted, in batches, and give the same however these are cut."""
    events = [(w, *e) for w in ("a", "b", None) for e in requests(5)]
    rows = spark.createDataFrame(events, "worker string, at long, id string, kind string").repartition(3)
    want = sorted([(w, *r) for w in ("a", "b", None) for r in ledger_by_clock([e[1:] for e in events if e[0] == w], 3, 60, 2000)], key=str)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        made = buffers.ledger_batch(rows, 3, 60, 2000)
        assert sorted([tuple(r) for r in made.collect()], key=str) == want
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert buffers.ledger_batch(rows.limit(0), 3, 60, 2000).count() == 0


@pytest.mark.parametrize(("most", "parts"), [(3, {1}), (10**6, set(range(3, 9)))])
def test_a_worker_whose_requests_never_wait_is_dealt_out_by_id(spark, most, parts):
    """A worker with room for all that it asks is no one task's work; drains, repeats and what is late count as before."""
    events = requests(11) + [(1200, "drained", "drain"), (1500, "after", "request"), (1501, "after", "answer")]
    rows = spark.createDataFrame([("a", *e) for e in events], "worker string, at long, id string, kind string").repartition(3)
    want = sorted(("a", *r) for r in ledger_by_clock(events, most, 60, 2000))
    assert {"refused", "repeated", "stale", "expired", "answered"} <= {r[2] for r in want}
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = buffers.ledger_batch(rows, most, 60, 2000).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r)[:-1] for r in made) == want
    assert len({r.part for r in made}) in parts
