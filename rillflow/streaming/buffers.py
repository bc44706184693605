"""Bounded pools and a ledger of requests as keyed state of a stream (``transformWithStateInPandas``, RocksDB state).

What a key does with its events is a plain fold (``kept``, ``Ledger.advance``); a stream runs it on state that outlives a
micro-batch, a batch query runs it on all rows, and both give the same rows whatever the order in which rows arrive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillflow.operators.sampling import round_robin

#: What happens to a request: (id, what, at, how long).
Event = tuple[str, str, int, int]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as such state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# Pools: entries(pool, step, seq, …). The newest ``most`` of a pool stay, by (step, seq), and of these none older than ``most_age`` steps.


def with_room(entries: DataFrame, length: str, longest: int, least_share: float) -> DataFrame:
    """Entries that leave at least ``least_share`` of ``longest`` tokens to go on."""
    return entries.where(F.lit(longest) - F.col(length) >= int(longest * least_share))


def kept(places: Iterable[tuple[int, int]], newest: int, most: int, most_age: int | None) -> list[tuple[int, int]]:
    """Of the places (step, seq) those that stay at step ``newest``. What goes never counts again, since whatever is newer than it lasts as long."""
    alive = [p for p in places if most_age is None or newest - p[0] <= most_age]
    return heapq.nlargest(most, alive)


class PoolState(StatefulProcessor):
    """A shard of a pool: its entries by (step, seq), and the newest step that it saw. Writes only what comes and goes."""

    def __init__(self, most: int, most_age: int | None, payload: list[str], key: str, value: str, ttl_ms: int | None = None):
        self.most, self.most_age, self.payload, self.key, self.value, self.ttl_ms = most, most_age, payload, key, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "step long, seq long", self.value, *([self.ttl_ms] if self.ttl_ms else []))
        self.newest = handle.getValueState("newest", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).drop_duplicates(["step", "seq"], keep="last")
        newest = max(int(new["step"].max()), self.newest.get()[0] if self.newest.exists() else -(1 << 62))
        self.newest.update((newest,))
        before = {(int(s), int(q)) for s, q in self.entries.keys()} if self.entries.exists() else set()
        come = {(int(r.step), int(r.seq)): tuple(getattr(r, c) for c in self.payload) for r in new.itertuples(index=False)}
        stay = set(kept(before | set(come), newest, self.most, self.most_age))
        changes = []
        for place in sorted(before - stay):
            changes.append((*key, *place, *self.entries.getValue(place), "out"))
            self.entries.removeKey(place)
        for place in sorted(set(come) & stay):
            self.entries.updateValue(place, come[place])
            changes.append((*key, *place, *come[place], "in"))
        yield pd.DataFrame(changes, columns=["pool", "shard", "step", "seq", *self.payload, "change"])

    def close(self) -> None:
        pass


def pool_changes(entries: DataFrame, most: int, most_age: int | None = None, shards: int = 8, ttl_ms: int | None = None) -> DataFrame:
    """(pool, shard, step, seq, …, change: in or out) of a stream ``entries(pool, step, seq, …)``, in update mode, started within ``rocks_state``.

    A pool is spread over ``shards`` by seq, each of which keeps the newest ``most`` of its own: among them are the
    newest ``most`` of all, which ``pool_of`` takes, so that a hot pool is no hot key. With ``ttl_ms``, state that isn't
    written for so long goes by itself. An entry that comes again replaces itself.
    """
    payload = [f for f in entries.schema.fields if f.name not in ("pool", "step", "seq")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payload) or "none int"
    names = [f.name for f in payload] or ["none"]
    entries = entries if payload else entries.withColumn("none", F.lit(None).cast("int"))
    pool = entries.schema["pool"].dataType.simpleString()
    state = PoolState(most, most_age, names, pool, fields, ttl_ms)
    keyed = entries.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int"))
    out = f"pool {pool}, shard int, step long, seq long, {fields}, change string"
    return keyed.groupBy("pool", "shard").transformWithStateInPandas(state, out, "Update", "ProcessingTime" if ttl_ms else "None")


def pool_of(changes: DataFrame, batch: str, most: int, most_age: int | None = None) -> DataFrame:
    """The entries of every pool after all ``changes``, of which a place's last ``batch`` counts."""
    rest = [c for c in changes.columns if c not in (batch, "pool", "shard", "step", "seq")]
    # An entry comes and goes in this order within a batch.
    last = changes.groupBy("pool", "step", "seq").agg(F.max_by(F.struct(*rest), F.struct(F.col(batch), F.col("change") == "out")).alias("e"))
    return pool_batch(last.where("e.change = 'in'").select("pool", "step", "seq", *[F.col(f"e.{c}").alias(c) for c in rest if c != "change"]), most, most_age)


def pool_batch(entries: DataFrame, most: int, most_age: int | None = None) -> DataFrame:
    """The same of a table of all entries that ever came: two rankings, so that no task holds more of a pool than ``most`` a shard."""
    newest = entries.groupBy("pool").agg(F.max("step").alias("_newest"))
    alive = entries.join(newest, "pool").where(F.lit(most_age is None) | (F.col("_newest") - F.col("step") <= (most_age or 0))).drop("_newest")
    order = F.desc("step"), F.desc("seq")
    shard = Window.partitionBy("pool", F.pmod(F.xxhash64("seq"), F.lit(64))).orderBy(*order)
    some = alive.withColumn("_n", F.row_number().over(shard)).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("pool").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def taken(entries: DataFrame, group: str, n: int, seed: int, *keys: str) -> DataFrame:
    """``taken``: a stratified sample of ``n``, groups in turn and each in a random order of its own, which leaves the pool; the others stay in it."""
    out = round_robin(entries, group, n, seed, *keys).select(*keys, F.lit(True).alias("_out"))
    return entries.join(out, list(keys), "left").withColumn("taken", F.coalesce("_out", F.lit(False))).drop("_out")


# Requests: events(worker, at: milliseconds, id, kind: request, answer or failure).


@dataclass
class Ledger:
    """What a worker has waiting, (at, id), and in flight, id to (sent, expires). At most ``most`` are in flight, for ``patience`` ms at most;
    a freed place goes to the one that waited longest. ``closed``: after a ``drain`` nothing new is accepted, what is there is finished."""

    most: int
    patience: int
    waiting: list[tuple[int, str]] = field(default_factory=list)
    flying: dict[str, tuple[int, int]] = field(default_factory=dict)
    closed: bool = False

    def __post_init__(self) -> None:
        heapq.heapify(self.waiting)
        self._queued = {i for _, i in self.waiting}
        self._ends = self._ends_now()

    def _ends_now(self) -> list[tuple[int, str]]:
        """A heap of (expires, id) of what is in flight. What lands early stays in it until its time, or until most of it has landed."""
        out = [(e, i) for i, (_, e) in self.flying.items()]
        heapq.heapify(out)
        return out

    def _send(self, at: int) -> Iterator[Event]:
        while self.waiting and len(self.flying) < self.most:
            asked, i = heapq.heappop(self.waiting)
            self._queued.discard(i)
            self.flying[i] = (at, at + self.patience)
            heapq.heappush(self._ends, (at + self.patience, i))
            if len(self._ends) > 2 * len(self.flying) + 1000:
                self._ends = self._ends_now()
            yield i, "sent", at, at - asked

    def expired(self, upto: int) -> Iterator[Event]:
        """Requests whose patience ended by ``upto``, in order; each makes room when it ends."""
        while self._ends and self._ends[0][0] <= upto:
            expires, i = heapq.heappop(self._ends)
            if i in self.flying and self.flying[i][1] == expires:
                sent, _ = self.flying.pop(i)
                yield i, "expired", expires, expires - sent
                yield from self._send(expires)

    def told(self, events: Iterable[tuple[int, str, str]]) -> Iterator[Event]:
        """(id, what, at, how long) of ``events(at, id, kind)`` in order of time, and of what ends before the last of them. An answer at the very end of the patience is too late."""
        for at, i, kind in events:
            yield from self.expired(at)
            if kind == "drain":
                self.closed = True
            elif kind == "request":
                known = i in self.flying or i in self._queued
                if known or self.closed:
                    yield i, "repeated" if known else "refused", at, 0
                    continue
                heapq.heappush(self.waiting, (at, i))
                self._queued.add(i)
                yield from self._send(at)
            elif i in self.flying:
                sent, _ = self.flying.pop(i)
                yield i, "answered" if kind == "answer" else "failed", at, at - sent
                yield from self._send(at)
            else:
                yield i, "stale", at, 0

    def advance(self, events: Iterable[tuple[int, str, str]], upto: int) -> list[Event]:
        """All of ``events``, and of what ends by ``upto``."""
        return [*self.told(events), *self.expired(upto)]


LEDGER = "worker string, id string, what string, at long, took long"
_ORDER = {"request": 0, "answer": 1, "failure": 1, "drain": 2}
#: Rows that a task hands on at once, and ledgers of a worker whose requests don't wait for each other.
ROWS, SHARDS = 10_000, 256


def _in_order(events: Iterable[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    return sorted(events, key=lambda e: (e[0], _ORDER[e[2]], e[1], e[2]))


def _ledgers(batches: Iterable[pa.RecordBatch], most: int, patience: int, upto: int) -> Iterator[tuple]:
    """Rows (worker, …) of events (worker, shard, …) sorted by these and time, one ledger at a time."""
    key, ledger = None, None
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for its, mine in groupby(rows, key=itemgetter(0, 1)):
            if ledger is None or its != key:
                if ledger is not None:
                    yield from ((key[0], *r) for r in ledger.expired(upto))
                key, ledger = its, Ledger(most, patience)
            yield from ((key[0], *r) for r in ledger.told(r[2:] for r in mine))
    if ledger is not None:
        yield from ((key[0], *r) for r in ledger.expired(upto))


def ledger_batch(events: DataFrame, most: int, patience: int, upto: int) -> DataFrame:
    """(worker, id, what, at, took) of all that happens by ``upto`` (milliseconds). Spark sorts a worker's events by time; the task that folds them holds
    what waits or is in flight, and a batch of rows. Where no worker makes more than ``most`` requests in all, none ever waits for another: then
    a worker's events are dealt out by id, over as many as ``SHARDS`` ledgers, and each of these hears of every drain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _ledgers(batches, most, patience, upto)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["worker", "id", "what", "at", "took"])

    order = F.create_map(*[F.lit(x) for item in _ORDER.items() for x in item])[F.col("kind")]
    known = F.coalesce(order, F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))).cast("int"))
    mine = events.where(F.col("at") <= upto).select(F.col("worker").cast("string").alias("worker"), F.col("at").cast("long").alias("at"), F.col("id").cast("string").alias("id"), "kind", known.alias("_order"))
    asked = mine.where("kind = 'request'").groupBy("worker").count().agg(F.max("count"))
    shards = F.when(F.coalesce(asked.scalar(), F.lit(0)) <= most, SHARDS).otherwise(1)
    dealt = F.when(F.col("kind") == "drain", F.sequence(F.lit(0), shards - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), shards).cast("int")))
    by_id = mine.select("worker", F.explode(dealt).alias("_shard"), "at", "id", "kind", "_order")
    return by_id.repartition("worker", "_shard").sortWithinPartitions("worker", "_shard", "at", "_order", "id", "kind").drop("_order").mapInArrow(run, LEDGER)


class LedgerState(StatefulProcessor):
    """A worker's ledger. Events wait in state until the watermark has passed them, so that they count in order of time; timers wake it for events and for the ends of patience."""

    def __init__(self, most: int, patience: int):
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "at long, id string, kind string", "none int")
        self.waiting = handle.getMapState("waiting", "at long, id string", "none int")
        self.flying = handle.getMapState("flying", "id string", "sent long, expires long")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _advance(self, key, upto: int) -> pd.DataFrame:
        due = _in_order((int(at), i, kind) for at, i, kind in self.events.keys() if at <= upto) if self.events.exists() else []
        waiting = [(int(at), i) for at, i in self.waiting.keys()] if self.waiting.exists() else []
        flying = {k[0]: (int(v[0]), int(v[1])) for k, v in self.flying.iterator()} if self.flying.exists() else {}
        ledger = Ledger(self.most, self.patience, list(waiting), dict(flying), self.closed.exists())
        rows = ledger.advance(due, upto)
        for e in due:
            self.events.removeKey(e)
        for w in set(waiting) - set(ledger.waiting):
            self.waiting.removeKey(w)
        for w in set(ledger.waiting) - set(waiting):
            self.waiting.updateValue(w, (None,))
        for i in flying.keys() - ledger.flying.keys():
            self.flying.removeKey((i,))
        for i, times in ledger.flying.items():
            if flying.get(i) != times:
                self.flying.updateValue((i,), times)
                self.handle.registerTimer(times[1])
        if ledger.closed and not self.closed.exists():
            self.closed.update((True,))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["worker", "id", "what", "at", "took"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for r in part.itertuples(index=False):
                self.events.updateValue((int(r.at), r.id, r.kind), (None,))
                self.handle.registerTimer(int(r.at))
        yield pd.DataFrame([], columns=["worker", "id", "what", "at", "took"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Up to the watermark at once: a timer that is set now fires in a later batch only.
        yield self._advance(key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, most: int, patience: int, late: str) -> DataFrame:
    """The same of a stream ``events(worker, ts, id, kind)``, started within ``rocks_state``: what happened until the watermark, which is ``late`` behind the newest event."""
    keyed = events.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return keyed.groupBy("worker").transformWithStateInPandas(LedgerState(most, patience), LEDGER, "Append", "EventTime")
