"""Retries of single objects: waits, dead letters, newer events, restarts."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sheaf.plans import catalog
from sheaf.settings import OBJECT_FINALIZED
from sheaf.sources.store import Store
from sheaf.streaming import retries

COLUMNS = (
    "ce_type string, ce_subject string, ce_id string, bucket string, name string, event_time timestamp, content string"
)
QUICK = retries.RetryKnobs(attempts=4, wait_unit=0.1)


def upload(spark, path, *objects):
    rows = [
        (OBJECT_FINALIZED, "s", f"{name}-{day}", "b", name, datetime(2024, 1, day), content) for name, day, content in objects
    ]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)


def flaky(folder):
    """Fails as often as its content says, and notes when it was called."""

    def work(content, attempt):
        with open(os.path.join(folder, content), "a") as calls:
            calls.write(f"{time.time()}\n")
        if attempt <= int(content.split("-")[1]):
            raise ValueError(f"{content} at {attempt}")
        return content.upper()

    return work


def run_until(spark, query, root, n, limit=90):
    started = time.time()
    while time.time() - started < limit:
        if query.exception():
            raise AssertionError(str(query.exception()))
        try:
            rows = retries.outcomes(spark, root).collect()
        except Exception:  # nothing written yet
            rows = []
        if len(rows) >= n:
            return {r.name: r for r in rows}
        time.sleep(0.3)
    raise AssertionError("the stream did not finish")


@pytest.fixture
def places(tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(calls)


def test_an_object_that_fails_twice_and_one_that_never_works(spark, places, tmp_path):
    source, root, checkpoint, calls = places
    upload(spark, source, ("a.pdf", 1, "a-0"), ("b.pdf", 1, "b-2"), ("c.pdf", 1, "c-9"), ("d.txt", 1, "d-0"), ("a.pdf", 2, "a2-0"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(COLUMNS).parquet(source)
    query = retries.start_retrying(stream, root, checkpoint, flaky(calls), QUICK, store=store, every="200 milliseconds")
    try:
        rows = run_until(spark, query, root, 3)
    finally:
        query.stop()
    assert {name: (r.verdict, r.attempts) for name, r in rows.items()} == {
        "a.pdf": ("done", 1), "b.pdf": ("done", 3), "c.pdf": ("dead", 4),
    }
    assert rows["c.pdf"].error == "c-9 at 4" and rows["c.pdf"].content is None and rows["b.pdf"].content == "B-2"
    times = [float(line) for line in open(os.path.join(calls, "c-9"))]
    gaps = [later - earlier for earlier, later in zip(times, times[1:])]
    assert len(times) == 4 and all(gap >= wait for gap, wait in zip(gaps, (0.2, 0.4, 0.8)))
    assert not os.path.exists(os.path.join(calls, "a-0"))  # only the newest event of an object
    assert {r.filename for r in store.documents().collect()} == {"a.pdf", "b.pdf"}


def test_waits_survive_a_restart_and_newer_events_replace(spark, places):
    source, root, checkpoint, calls = places
    slow = retries.RetryKnobs(attempts=4, wait_unit=10)
    upload(spark, source, ("a.pdf", 1, "a-0"), ("b.pdf", 3, "b-1"), ("c.pdf", 3, "c-1"))
    stream = spark.readStream.schema(COLUMNS).parquet(source)
    query = retries.start_retrying(stream, root, checkpoint, flaky(calls), slow, every="200 milliseconds")
    try:
        assert set(run_until(spark, query, root, 1)) == {"a.pdf"}
    finally:
        query.stop()
    upload(spark, source, ("b.pdf", 4, "newer-0"), ("c.pdf", 2, "older-0"))
    query = retries.start_retrying(stream, root, checkpoint, flaky(calls), slow, every="200 milliseconds")
    try:
        rows = run_until(spark, query, root, 3)
    finally:
        query.stop()
    assert (rows["b.pdf"].content, rows["b.pdf"].attempts) == ("NEWER-0", 1)
    assert (rows["c.pdf"].content, rows["c.pdf"].attempts) == ("C-1", 2)
    assert not os.path.exists(os.path.join(calls, "older-0"))


class Counted(dict):
    """A map of the keyed state, and how often state or timers were called."""

    def __init__(self):
        super().__init__()
        self.timers, self.calls = set(), 0

    def getMapState(self, *_):
        return self

    def call(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self.call(len(self) > 0)

    def iterator(self):
        return self.call(iter(list(self.items())))

    def getValue(self, key):
        return self.call(self.get(key))

    def updateValue(self, key, value):
        self[key] = self.call(value)

    def removeKey(self, key):
        self.call(self.pop(key, None))

    def registerTimer(self, due):
        self.call(self.timers.add(due))

    def deleteTimer(self, due):
        self.call(self.timers.discard(due))


def group(state, work, now, *objects, bucket=(0,)):
    """The outcomes of a batch of ``(name, day, content)`` and of the timers that are due."""
    processor = retries.Retrying(work, retries.RetryKnobs(attempts=4, wait_unit=1))
    processor.init(state)
    rows = [
        Row(gcs_uri=f"gs://b/{n}", ce_type="t", ce_subject="s", ce_id=f"{n}-{day}", bucket="b", name=n,
            event_time=datetime(2024, 1, day), content=content)
        for n, day, content in objects
    ]
    out = list(processor.handleInputRows(bucket, iter(rows), TimerValues(now, 0))) if rows else []
    for due in sorted(due for due in state.timers if due <= now):
        out += processor.handleExpiredTimer(bucket, TimerValues(now, 0), ExpiredTimerInfo(due))
        state.timers.discard(due)
    return {row.name: (row.verdict, row.attempts, row.content) for row in out}


def fails(content, attempt):
    if attempt <= int(content.split("-")[1]):
        raise ValueError(content)
    return content


def test_calls_to_the_state_do_not_grow_with_the_objects():
    """F16: each object cost several calls an attempt."""
    state = Counted()
    objects = [(f"o{i}.pdf", 1, f"o{i}-{i % 3}") for i in range(600)]
    done = group(state, fails, 0, *objects)
    assert len(done) == 200 and state.timers == {2000}
    again = group(state, fails, 2000)
    assert len(again) == 200 and {attempts for _, attempts, _ in again.values()} == {2}
    last = group(state, fails, 6000)
    assert len(last) == 200 and {attempts for _, attempts, _ in last.values()} == {3}
    assert not state and not state.timers and state.calls < 20


def test_objects_of_a_group_wait_apart_and_newer_events_replace():
    state = Counted()
    first = [("a.pdf", 3, "a-1"), ("b.pdf", 3, "b-1"), ("c.pdf", 3, "c-9"), ("c.pdf", 2, "older-0")]
    assert group(state, fails, 0, *first) == {}
    found = group(state, fails, 1000, ("a.pdf", 4, "newer-1"), ("b.pdf", 2, "older-0"), ("d.pdf", 1, "d-0"))
    assert found == {"d.pdf": ("done", 1, "d-0")} and state.timers == {2000, 3000}
    assert group(state, fails, 2000) == {"b.pdf": ("done", 2, "b-1")}
    assert group(state, fails, 3000) == {"a.pdf": ("done", 2, "newer-1")}
    assert group(state, fails, 6000) == {} and group(state, fails, 14000) == {"c.pdf": ("dead", 4, None)}
    assert not state and not state.timers
    assert group(state, fails, 15000, ("c.pdf", 3, "c-1")) == {} and state.timers == {17000}
    assert group(state, fails, 16000, ("c.pdf", 4, "c-0")) == {"c.pdf": ("done", 1, "c-0")} and not state.timers


def test_retries_in_one_group_of_a_stream(spark, places, monkeypatch):
    """All objects share a list of the state, whose entries come back from it and go in again."""
    monkeypatch.setattr(retries, "BUCKETS", 1)
    source, root, checkpoint, calls = places
    upload(spark, source, *((f"{i}.pdf", 1, f"{i}-{i % 5}") for i in range(20)))
    stream = spark.readStream.schema(COLUMNS).parquet(source)
    query = retries.start_retrying(stream, root, checkpoint, flaky(calls), QUICK, every="200 milliseconds")
    try:
        rows = run_until(spark, query, root, 20)
    finally:
        query.stop()
    assert {n: (r.verdict, r.attempts) for n, r in rows.items()} == {
        f"{i}.pdf": ("dead", 4) if i % 5 == 4 else ("done", i % 5 + 1) for i in range(20)
    }
    assert {r.event_time for r in rows.values()} == {datetime(2024, 1, 1)}


def test_object_retries_ends_where_documents_repeat_or_are_no_objects(spark, tmp_path):
    """It waited for an outcome of each row, and rows of one object or of none have fewer."""
    rows = [(1, "web", "a"), (1, "web", "a"), (2, None, "b"), (3, "web", None), (4, "web", "x" * 7)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.gcs_uri: (r.verdict, r.attempts) for r in catalog.object_retries(spark, str(tmp_path)).collect()}
    assert sorted(found.values()) == [("dead", 4), ("done", 1), ("done", 1)]
