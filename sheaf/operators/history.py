"""Versions of documents over time: validity intervals and as-of lookups.

Versions and questions are put in one order by key and time and dealt out by range, so a key with
very many versions is spread over tasks like any other. Each task scans its rows once and keeps a
single version at a time. What a task cannot know, the version that was valid where its range
begins, is one row per task and follows from those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.session import stored

_NAMES = ["part", "key", "version", "question", "carried", "last"]


def as_of(versions: DataFrame, questions: DataFrame, key: str, time: str, at: str, tie: str) -> DataFrame:
    """Each row of ``questions`` with ``version``, the newest of its ``key`` at or before ``at``.

    ``version`` is a struct of the other columns of ``versions``, null where there was none yet.
    Of versions with the same ``time`` the one with the greatest ``tie`` counts. Rows with a null
    key or time have no version and are none.
    """
    rows = _versions(versions, key, F.col(time), F.col(tie), first=True)
    asked = _questions(questions, key, F.col(at), tie_type=versions.schema[tie].dataType, first=False)
    return _scan(rows, asked, descending=False)


def intervals(versions: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """``versions`` with ``valid_from`` and ``valid_to``, the time of the next version, null for the last.

    A version replaced at the very time it was written is valid at no time.
    """
    known = versions.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = _versions(known.select(key, time, tie), key, F.col(time), F.col(tie), first=False)
    asked = _questions(known, key, F.col(time), tie=F.col(tie), first=True)
    found = _scan(rows, asked, descending=True)
    return found.select(
        *versions.columns, F.col(time).alias("valid_from"), F.col(f"version.{time}").alias("valid_to")
    )


def _versions(rows: DataFrame, key: str, time, tie, first: bool) -> DataFrame:
    others = [F.col(name) for name in rows.columns if name != key]
    known = rows.filter(F.col(key).isNotNull() & time.isNotNull())
    return known.select(
        F.col(key).alias("key"), time.alias("time"), tie.alias("tie"), F.lit(0 if first else 1).alias("turn"), F.struct(*others).alias("version")
    )


def _questions(rows: DataFrame, key: str, time, first: bool, tie=None, tie_type=None) -> DataFrame:
    tie = F.lit(None).cast(tie_type) if tie is None else tie
    return rows.select(
        F.col(key).alias("key"), time.alias("time"), tie.alias("tie"), F.lit(0 if first else 1).alias("turn"), F.struct("*").alias("question")
    )


def _scan(versions: DataFrame, questions: DataFrame, descending: bool) -> DataFrame:
    """Questions with the last version of their key before them in the order."""
    blank = questions.filter(F.col("key").isNull() | F.col("time").isNull())
    asked = questions.filter(F.col("key").isNotNull() & F.col("time").isNotNull())
    rows = versions.unionByName(asked, allowMissingColumns=True)
    if descending:
        # The next version in time is the last one before in falling order; at equal places questions come first.
        order = [F.col("key"), F.col("time").desc(), F.col("tie").desc_nulls_last(), F.col("turn")]
    else:
        # At equal times all versions come before the questions.
        order = [F.col("key"), F.col("time"), F.col("turn"), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = (
        StructType()
        .add("part", "integer").add("key", versions.schema["key"].dataType)
        .add("version", versions.schema["version"].dataType).add("question", questions.schema["question"].dataType)
        .add("carried", "boolean").add("last", "boolean")
    )
    found = stored(dealt.select("part", "key", "version", "question").mapInArrow(_last_versions, schema), "scan")
    # The version that is valid where a task's range begins, from the last rows of the tasks before.
    ends = found.filter("last").select("part", "key", "version")
    before = Window.partitionBy("key").orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.filter("carried").select("part", "key").distinct()  # at most one key per task
    carry = (
        ends.withColumn("turn", F.lit(1))
        .unionByName(starts.withColumn("turn", F.lit(0)), allowMissingColumns=True)
        .withColumn("from_before", F.last("version", ignorenulls=True).over(before))
        .filter("turn = 0")
        .select("part", "key", "from_before")
    )
    answered = found.filter("question IS NOT NULL").join(F.broadcast(carry), ["part", "key"], "left")  # one row per task
    version = F.when(F.col("carried"), F.col("from_before")).otherwise(F.col("version"))
    answered = answered.select("question.*", version.alias("version"))
    nothing = F.lit(None).cast(versions.schema["version"].dataType).alias("version")
    return answered.unionByName(blank.select("question.*", nothing))


def _last_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each question of a task with the last version of its key in the task.

    ``carried``: its key had no version in the task before it, so an earlier task may know one,
    which only the task's first key needs. At the end comes the last key with its last version.
    """
    current, version, schema, part, first_key = None, None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_pylist()
        is_version = batch.column("version").is_valid().to_pylist()
        if schema is None:
            schema, part, first_key = batch.schema, batch.column("part")[0].as_py(), keys[0]
        # Places in a table of the version held so far and this batch's versions.
        own = [version] if version is not None else []
        place, places, asked, carried = (0 if version is not None else None), [], [], []
        for i, key in enumerate(keys):
            if key != current:
                current, place = key, None
            if is_version[i]:
                place = len(own) + i
            else:
                asked.append(i)
                places.append(place)
                carried.append(place is None and key == first_key)
        column = batch.column("version")
        pool = pa.concat_arrays([*own, column])
        if asked:
            take = pa.array(asked)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part").take(take),
                    batch.column("key").take(take),
                    pool.take(pa.array(places, pa.int64())),
                    batch.column("question").take(take),
                    pa.array(carried, pa.bool_()),
                    pa.array([False] * len(asked)),
                ],
                _NAMES,
            )
        version = None if place is None else pool.slice(place, 1)
        key_array = batch.column("key").slice(len(keys) - 1, 1)
    if schema is not None:
        none = pa.nulls(1, schema.field("version").type)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                key_array,
                none if version is None else version,
                pa.nulls(1, schema.field("question").type),
                pa.array([False]),
                pa.array([True]),
            ],
            _NAMES,
        )
