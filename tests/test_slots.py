import datetime as dt
import random

import pytest

from gritstone.sources import store
from gritstone.streaming import slots

QUEUE = store.SCHEMAS["queue"]
NOW = dt.datetime.now(dt.UTC).replace(tzinfo=None)
RESULTS = "id long, key string, ts timestamp, result string"


def entry(ea, name, ord, status="pending", age=0.0, kind=None):
    return (kind, ea, f"sub_{ea}", name, "v", "w", "p", 0.25, status, 1, [(5, "x")], NOW - dt.timedelta(days=age), ord)


@pytest.fixture
def session(spark):
    with slots.state_store(spark):
        yield spark


def feed(spark, root, rows, days=None):
    """A restart of the stream with new events; the rows of the queue after it."""
    spark.createDataFrame(rows, QUEUE).repartition(3).write.mode("append").parquet(f"{root}/in")
    slots.follow_slots(spark.readStream.schema(QUEUE).parquet(f"{root}/in"), root, f"{root}/ck", days).awaitTermination()
    return {(r["ea"], r["suggested_name"], r["status"]) for r in store.load(spark, root, "queue").collect()}


def test_slots_over_restarts(session, tmp_path):
    root = f"file://{tmp_path}"
    assert feed(session, root, [entry(1, "a", 1, age=1), entry(1, "b", 2), entry(2, "c", 3), entry(None, "n", 4)]) == {(1, "b", "pending"), (2, "c", "pending"), (None, "n", "pending")}
    assert feed(session, root, [entry(1, "late", 0, age=3)]) == {(1, "b", "pending"), (2, "c", "pending"), (None, "n", "pending")}
    ended = {(1, "b", "applied"), (2, "c", "pending"), (2, "other", "rejected"), (None, "n", "pending")}
    assert feed(session, root, [entry(1, "b", 9, "applied"), entry(2, "other", 8, "rejected")]) == ended
    row = store.load(session, root, "queue").filter("suggested_name = 'c'").first()
    assert row["ts"] == NOW and row["deps"][0]["suggested_name"] == "x" and row["confidence"] == 0.25 and row["kind"] is None


def by_hand(events):
    """What the queue holds after events in whatever order."""
    newest, decided = {}, []
    for e in events:
        slot, age = (e[0] or "function_rename", e[1]), (e[11], e[12])
        if e[8] != "pending":
            decided.append(e)
        elif slot not in newest or age > (newest[slot][11], newest[slot][12]):
            newest[slot] = e
    is_open = lambda p: not any((d[0] or "function_rename", d[1], d[3]) == (p[0] or "function_rename", p[1], p[3]) and (d[11], d[12]) >= (p[11], p[12]) for d in decided)
    return {(e[1], e[3], e[8]) for e in decided} | {(p[1], p[3], "pending") for p in newest.values() if is_open(p)}


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cut_gives_the_same_queue(session, tmp_path, cuts):
    r = random.Random(5)
    events = [entry(r.randrange(6), r.choice("ab"), i, r.choice(["pending", "pending", "applied", "rejected"]), r.randrange(4)) for i in range(60)]
    for part in range(cuts):
        got = feed(session, f"file://{tmp_path}", events[part::cuts])
    assert got == by_hand(events)


def test_undecided_rows_expire(session, tmp_path):
    root = f"file://{tmp_path}"
    feed(session, root, [entry(1, "old", 1, age=91), entry(2, "new", 2, age=89)], 90)
    assert feed(session, root, [entry(3, "x", 3)], 90) == {(2, "new", "pending"), (3, "x", "pending")}


def test_changes_twice_are_changes_once(spark):
    q = spark.createDataFrame([entry(1, "a", 1), entry(2, "b", 2, "applied")], QUEUE)
    changes = spark.createDataFrame([("pending", *entry(1, "c", 3)), ("decided", *entry(2, "d", 4, "rejected")), ("expired", *entry(7, "e", 5))], f"change string, {QUEUE}")
    once = slots.merged_changes(q, changes)
    assert sorted(r["ord"] for r in once.collect()) == [2, 3, 4] == sorted(r["ord"] for r in slots.merged_changes(once, changes).collect())
    assert slots.merged_changes(q, changes.filter("false")).count() == 2


def test_cached_answers(session, tmp_path):
    root = f"file://{tmp_path}"

    def step(rows):
        session.createDataFrame(rows, RESULTS).repartition(2).write.mode("append").parquet(f"{root}/in")
        out = slots.cached_answers(session.readStream.schema(RESULTS).parquet(f"{root}/in"))
        sink = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{root}/out"))
        sink.option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
        return {r["id"]: r["result"] for r in session.read.schema("id long, key string, result string").parquet(f"{root}/out").collect()}

    day = lambda n: NOW - dt.timedelta(days=n)
    assert step([(1, "k", NOW, None), (None, "k", day(2), "r1"), (None, "k", day(1), "r2"), (2, "none", NOW, None), (None, "old", day(91), "gone"), (None, "empty", NOW, ""), (3, "empty", NOW, None)]) == {1: "r2", 2: None, 3: None}
    assert step([(4, "k", NOW, None), (5, "old", NOW, None), (None, "k", day(3), "older")]) == {1: "r2", 2: None, 3: None, 4: "r2", 5: None}
    many = step([(100 + i, "k", NOW, None) for i in range(2500)])
    assert len(many) == 2505 and set(many[i] for i in range(100, 2600)) == {"r2"}


def test_calls_of_the_state_do_not_grow_with_decisions(monkeypatch):
    """Decisions of one item are gathered before the state is asked; also when they are handed over in parts."""
    from types import SimpleNamespace as Ns

    monkeypatch.setattr(slots, "SOME", 3, raising=False)
    for n_items, most in ((2, 8), (10, 34)):
        calls, state, value = [], {}, []
        called = lambda name, f: lambda *a: (calls.append(name), f(*a))[1]
        made = slots._Slots(None)
        made.kept = Ns(exists=called("exists", lambda: bool(value)), get=called("get", lambda: value[-1] if value else None), update=called("update", value.append))
        made.decided = Ns(containsKey=called("contains", state.__contains__), getValue=called("get", state.get), updateValue=called("put", state.__setitem__))
        rows = [Ns(status="applied", at=i, ord=i, item=f"i{i * 7 % 100 % n_items if n_items == 2 else i // 10}", body=str(i)) for i in range(100)]
        rows.insert(50, Ns(status="pending", at=50, ord=200, item="i1", body="p"))
        out = list(made.handleInputRows(("s",), iter(rows), None))
        newest = max(r.at for r in rows if r.item == "i1" and r.status == "applied")
        assert len(out) == 101 and out[-1].change == ("closed" if newest > 50 else "pending") and state[("i1",)] == (newest, newest) and len(state) == n_items
        assert len(calls) <= most
