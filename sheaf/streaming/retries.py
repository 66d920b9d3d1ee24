"""Retries of single objects in a stream: keyed state and timers, and dead letters.

An object whose work fails is kept in keyed state, and a timer calls it again after a wait that
doubles each time (2, 4, 8 s by default), while all other objects go on. After the last attempt
it becomes a dead letter. A newer event of the same object takes the place of the waiting one.
State and timers are part of the checkpoint, so a restarted stream goes on with the waits it had.

Each group of the stateful operator costs calls between Python and the JVM and a batch of its own
on the way back, so objects are grouped by a hash of their URI, in ``BUCKETS`` groups. What waits
in a group lies in one list for each time that a timer is set for, and is read and written by list.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sheaf.functions import text
from sheaf.operators.events import accepted
from sheaf.plans import ingest
from sheaf.settings import EventKnobs
from sheaf.sources.store import Store
from sheaf.streaming.ingest import ingest_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# What became of an object.
DONE, DEAD = "done", "dead"

# Fixed: groups of the keyed state, so a checkpoint holds to it. A group's newest events of one batch are held at once.
BUCKETS = 4096

_EVENT = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("ce_type", "ce_subject", "ce_id", "bucket", "name")]
    + [T.StructField("event_time", T.TimestampType())]
)
_FIELDS = _EVENT.names
_DUE = T.StructType([T.StructField("due", T.LongType())])
_WAITING = T.StructType(
    [
        T.StructField("gcs_uri", T.StringType()),
        *_EVENT.fields,
        T.StructField("content", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)
_OBJECTS = T.StructType([T.StructField("objects", T.ArrayType(_WAITING))])
_OUTCOME = T.StructType(
    [
        T.StructField("gcs_uri", T.StringType()),
        *_EVENT.fields,
        T.StructField("content", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
_outcome = Row(*_OUTCOME.names)


@dataclass(frozen=True)
class RetryKnobs:
    attempts: int = 4
    wait_base: float = 2.0
    wait_unit: float = 1.0  # waits are unit * base**1, unit * base**2, ... seconds

    def wait_ms(self, failed: int) -> int:
        return max(1, int(1000 * self.wait_unit * self.wait_base**failed))


def _order(event: tuple) -> tuple:
    """Newest last: by event time, none first, and id. State gives times back without a zone."""
    time = event[5]
    return (time is not None, time and time.replace(tzinfo=None), event[2] or "")


class Retrying(StatefulProcessor):
    """``work(content, attempt)`` on the newest event of each object of a bucket, called again while it fails.

    ``waiting`` maps the time of a timer to the objects called again then; each object waits once.
    """

    def __init__(self, work: Callable[[str, int], str], knobs: RetryKnobs):
        self.work, self.knobs = work, knobs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _DUE, _OBJECTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for row in rows:
            uri, event = row["gcs_uri"], tuple(row[name] for name in (*_FIELDS, "content"))
            if uri not in newest or _order(event) > _order(newest[uri]):
                newest[uri] = event
        if self.waiting.exists():
            self._replace(newest)
        yield from self._attempts([(uri, *event, 0) for uri, event in newest.items()], timerValues)

    def _replace(self, newest: dict[str, tuple]) -> None:
        """Drop waiting objects that have a newer event, and of ``newest`` those that wait with a newer one."""
        changed = {}
        for (due,), (objects,) in self.waiting.iterator():
            kept = []
            for uri, *waiting in objects:
                if uri in newest and _order(newest[uri]) < _order(waiting):
                    del newest[uri]
                if uri not in newest:
                    kept.append((uri, *waiting))
            if len(kept) < len(objects):
                changed[due] = kept
        for due, kept in changed.items():
            if kept:
                self.waiting.updateValue((due,), (kept,))
            else:
                self.waiting.removeKey((due,))
                self.handle.deleteTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = (expiredTimerInfo.getExpiryTimeInMs(),)
        found = self.waiting.getValue(due)
        if found is not None:
            self.waiting.removeKey(due)
            yield from self._attempts(found[0], timerValues)

    def _attempts(self, objects: list[tuple], timerValues) -> Iterator[Row]:
        """The outcomes of one more attempt at each of ``objects``; those that fail wait again."""
        now, later = timerValues.getCurrentProcessingTimeInMs(), defaultdict(list)
        for uri, *event, failed in objects:
            attempt = failed + 1
            try:
                outcome = (self.work(event[6], attempt), DONE, attempt, None)
            except Exception as problem:  # whatever the work raises concerns this object only
                if attempt < self.knobs.attempts:
                    later[now + self.knobs.wait_ms(attempt)].append((uri, *event, attempt))
                    continue
                outcome = (None, DEAD, attempt, str(problem)[:500])
            yield _outcome(uri, *event[:6], *outcome)
        for due, failing in later.items():
            (others,) = self.waiting.getValue((due,)) or ((),)
            self.waiting.updateValue((due,), ([*map(tuple, others), *failing],))
            self.handle.registerTimer(due)


def with_retries(
    stream: DataFrame,
    work: Callable[[str, int], str],
    knobs: RetryKnobs = RetryKnobs(),
    event_knobs: EventKnobs = EventKnobs(),
) -> DataFrame:
    """The outcomes of a stream of object events with ``content``: one row per object that is done or dead.

    ``content`` becomes what the work returned. The session needs the RocksDB state store (``use_rocksdb``).
    """
    events = accepted(stream, event_knobs).withColumn("gcs_uri", text.object_uri(F.col("bucket"), F.col("name")))
    bucket_of_state = F.pmod(F.xxhash64("gcs_uri"), F.lit(BUCKETS)).alias("state_bucket")
    rows = events.select(bucket_of_state, "gcs_uri", *_FIELDS, F.col("content").cast("string").alias("content"))
    return rows.groupBy("state_bucket").transformWithState(
        statefulProcessor=Retrying(work, knobs),
        outputStructType=_OUTCOME,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need this state store; it holds state beyond a task's memory on disk."""
    spark.conf.set(PROVIDER, ROCKSDB)


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """``(gcs_uri, ..., verdict, attempts, error)`` of every finished object, dead letters among them."""
    schema = T.StructType([*_OUTCOME.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{root}/outcomes")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def finished(spark: SparkSession, root: str) -> int:
    """How many objects are done or dead so far."""
    return outcomes(spark, root).count()


def start_retrying(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    work: Callable[[str, int], str],
    knobs: RetryKnobs = RetryKnobs(),
    event_knobs: EventKnobs = EventKnobs(),
    store: Store | None = None,
    ingest_knobs: ingest.IngestKnobs = ingest.IngestKnobs(),
    every: str = "1 second",
) -> StreamingQuery:
    """Work on a stream of objects with retries, and keep the outcomes under ``root``.

    With a ``store``, objects that are done are ingested. A replayed batch writes its folder again
    and its commit is passed over, so nothing is counted twice.
    """
    use_rocksdb(stream.sparkSession)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{root}/outcomes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if store is not None:
            kept = spark.read.schema(_OUTCOME).parquet(path)
            done = kept.filter(F.col("verdict") == DONE).drop("verdict", "attempts", "error", "gcs_uri")
            if not done.isEmpty():
                ingest_batch(done, store, ingest_knobs, event_knobs, writer=checkpoint, batch_id=batch_id)

    return (
        with_retries(stream, work, knobs, event_knobs)
        .writeStream.outputMode("append")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
