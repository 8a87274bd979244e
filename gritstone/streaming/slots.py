"""The review queue and the result cache as keyed state of a stream: one pending row for each slot, one result for each key, both with an age limit.

Both keep their state in RocksDB (start them inside `state_store`), so a key's rows are on disk and a task holds one row at a time, however
many events a key has. What comes out does not depend on the order of a micro-batch's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import item_key, slot_key
from ..sources.store import SCHEMAS, fold

DAY_MS = 86_400_000
#: Items whose decisions a task gathers before it hands them to the state.
SOME = 1000


# What a session needs for keyed state with timers by the clock. Without data there would always be one more micro-batch,
# and availableNow would never end; so a row that is over its age goes with the next micro-batch that has data.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside this block keep their state in RocksDB; the session's own settings come back at its end."""
    before = {name: spark.conf.get(name) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class _Aged(StatefulProcessor):
    """One kept row for each key, with a timer that ends it `days` after its time."""

    KEPT = ""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", self.KEPT)

    def stop_timers(self) -> None:
        if self.days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def start_timer(self, at: int) -> None:
        self.stop_timers()
        if self.days is not None:
            self.handle.registerTimer(at // 1000 + self.days * DAY_MS)

    def close(self) -> None:
        pass


class _Slots(_Aged):
    """The newest proposal of a slot, and for each item the newest decision on it, so a decision may come before its proposal."""

    KEPT = "at long, ord long, item string, body string, is_open boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.decided = handle.getMapState("decided", "item string", "at long, ord long")

    def keep_decided(self, found: dict[str, tuple[int, int]]) -> None:
        """Takes the newest decisions of some items over into the state; found has the newest of all then."""
        for item, age in found.items():
            known = self.decided.getValue((item,))
            if known is not None and tuple(known) >= age:
                found[item] = tuple(known)
            else:
                self.decided.updateValue((item,), age)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # each call of the state is a message to the JVM and back, so a slot's decisions are gathered, for SOME items at most
        old = self.kept.get()
        best, found = old, {}
        for r in rows:
            age = (r.at, r.ord)
            if r.status == "pending":
                if best is None or age > (best[0], best[1]):
                    best = (r.at, r.ord, r.item, r.body, True)
                continue
            if found.get(r.item, age) <= age:
                found[r.item] = age
            if len(found) >= SOME:
                self.keep_decided(found)
                found = {}
            yield Row(change="decided", body=r.body)
        self.keep_decided(found)
        if best is None:
            return
        decision = found[best[2]] if best[2] in found else self.decided.getValue((best[2],))
        closed = decision is not None and tuple(decision) >= (best[0], best[1])
        new = (best[0], best[1], best[2], best[3], bool(best[4]) and not closed)
        if old is not None and new == tuple(old):
            return
        self.kept.update(new)
        if new[4]:
            self.start_timer(new[0])
            yield Row(change="pending", body=new[3])
        else:
            self.stop_timers()
            yield Row(change="closed", body=new[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            yield Row(change="expired", body=self.kept.get()[3])
        self.kept.clear()
        self.decided.clear()


class _Answers(_Aged):
    """The newest result of a key; the requests of a micro-batch wait on disk until all its results are in."""

    KEPT = "at long, result string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.kept.get() if self.kept.exists() else None
        best = old

        def requests():
            nonlocal best
            for r in rows:
                if r.id is not None:
                    yield (r.id, r.at)
                elif r.result and (best is None or (r.at, r.result) > (best[0], best[1])):
                    best = (r.at, r.result)

        for some in batched(requests(), 1000):
            self.waiting.appendList(list(some))
        if best is not old:
            self.kept.update(best)
            self.start_timer(best[0])
        if self.waiting.exists():
            least = None if best is None or self.days is None else best[0] + self.days * DAY_MS * 1000
            for id_, at in self.waiting.get():
                live = best is not None and (least is None or at <= least)
                yield Row(id=id_, key=key[0], result=best[1] if live else None)
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())


def pending_slots(events: DataFrame, days: int | None = None) -> DataFrame:
    """(change, *queue columns): how the queue changes with a stream of its rows.

    A pending row is a proposal: the newest of a slot, by (ts, ord), is its pending row. A row of any other status is a decision: it comes out as
    it is (`decided`) and closes the slot's pending row if that is the same proposal and not newer. Other changes carry the slot's row:
    `pending` (it is new or took another's place), `closed`, `expired` (undecided for `days` by the clock; None: never).
    A proposal older than its slot's row, and a decision that was there already, change nothing. A null ts counts as 1970, a null ord as 0.
    """
    body = F.to_json(F.struct(*[c for c in events.columns if c != "ts"], F.unix_micros("ts").alias("ts")))
    keyed = events.select(F.coalesce(slot_key(), F.lit("")).alias("slot"), F.coalesce(item_key(), F.lit("")).alias("item"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), F.coalesce("ord", F.lit(0)).alias("ord"), body.alias("body"))
    changes = keyed.groupBy("slot").transformWithState(_Slots(days), "change string, body string", "Update", "None" if days is None else "ProcessingTime")
    row = F.from_json("body", SCHEMAS["queue"].replace("ts timestamp", "ts long"))
    fields = [f.split()[0] for f in SCHEMAS["queue"].replace("array<struct<ea:bigint,suggested_name:string>>", "array").split(", ")]
    return changes.select("change", row.alias("r")).select("change", *[F.timestamp_micros("r.ts").alias("ts") if f == "ts" else F.col(f"r.{f}").alias(f) for f in fields])


def cached_answers(events: DataFrame, days: int | None = 90) -> DataFrame:
    """(id, key, result) for each request among a stream of results (key, ts, result; id null) and requests (id, key, ts).

    A request gets the newest result of its key, also one of its own micro-batch, or null if there is none or it is over `days` older than
    the request. Results also leave the state when they are over `days` old by the clock. Empty results are none.
    """
    keyed = events.select("id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), "result")
    return keyed.groupBy("key").transformWithState(_Answers(days), "id long, key string, result string", "Update", "None" if days is None else "ProcessingTime")


def merged_changes(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """queue after changes of pending_slots; applying the same changes again changes nothing.

    A slot that is named loses its pending row, and gets the new one if there is one; decided rows replace rows of their number.
    """
    slots = changes.filter("change <> 'decided'").select(F.coalesce(slot_key(), F.lit("")).alias("_slot")).distinct()
    last = Window.partitionBy("ord").orderBy(F.col("ts").desc(), item_key())
    final = changes.filter("change = 'decided'").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    pending = queue.filter("status = 'pending'").withColumn("_mine", F.coalesce(slot_key(), F.lit("")))
    pending = pending.join(slots, F.col("_mine") == F.col("_slot"), "left_anti").select(*queue.columns)
    ended = changes.filter("change = 'expired'").select(F.coalesce(slot_key(), F.lit("")).alias("_slot"), F.col("ord").alias("_ord"))
    fresh = changes.filter("change = 'pending'").withColumn("_mine", F.coalesce(slot_key(), F.lit("")))
    fresh = fresh.join(ended, (F.col("_mine") == F.col("_slot")) & F.col("ord").eqNullSafe(F.col("_ord")), "left_anti")  # over age when it came
    others = queue.filter("status IS NULL OR status <> 'pending'").join(final.select(F.col("ord").alias("_ord")), F.col("ord").eqNullSafe(F.col("_ord")), "left_anti")
    return pending.unionByName(others).unionByName(fresh.select(*queue.columns)).unionByName(final.select(*queue.columns))


def follow_slots(events: DataFrame, root: str, checkpoint: str, days: int | None = None, **trigger) -> StreamingQuery:
    """Keeps the queue table under root by the changes of pending_slots; a restart goes on from the state at checkpoint."""

    def merge(batch: DataFrame, epoch: int) -> None:
        fold(batch, root, "queue", "ea", merged_changes)

    changes = pending_slots(events, days)
    return changes.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
