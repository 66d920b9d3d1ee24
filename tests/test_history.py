"""Validity intervals and as-of lookups against plain Python, with hot keys and many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sheaf.operators import history

START = datetime(2024, 1, 1)


def moment(minutes):
    return START + timedelta(minutes=minutes)


def tables(spark, seed=3):
    rng = random.Random(seed)
    versions = [("hot", moment(rng.randrange(3000)), f"{i:04d}") for i in range(300)]
    versions += [(f"k{rng.randrange(60)}", moment(rng.randrange(3000)), f"{i:04d}") for i in range(300, 600)]
    versions += [("k1", moment(7), "a"), ("k1", moment(7), "b"), (None, moment(1), "n"), ("k2", None, "m"), ("k3", moment(9), None)]
    questions = [(i, rng.choice(["hot", f"k{rng.randrange(70)}"]), moment(rng.randrange(-10, 3100))) for i in range(500)]
    questions += [(900, "k1", moment(7)), (901, None, moment(5)), (902, "hot", None), (903, "k3", moment(9)), (0, "hot", moment(1))]
    return versions, questions


def frames(spark, versions, questions):
    v = spark.createDataFrame(versions, "uri string, written timestamp, id string").withColumn("size", F.length("id"))
    return v.repartition(5), spark.createDataFrame(questions, "q long, uri string, at timestamp").repartition(4)


def order(version):
    return (version[1], version[2] is not None, version[2] or "")


@pytest.mark.parametrize("parts", ["2", "17"])
def test_as_of_against_plain_python(spark, parts):
    versions, questions = tables(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v, q = frames(spark, versions, questions)
        got = history.as_of(v, q, "uri", "written", "at", "id").collect()
        spans = history.intervals(v, "uri", "written", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = [x for x in versions if x[0] is not None and x[1] is not None]
    want = []
    for number, uri, at in questions:
        found = [x for x in known if x[0] == uri and at is not None and x[1] <= at]
        best = max(found, key=order) if found else None
        want.append((number, uri, at, best and (best[1], best[2], best[2] and len(best[2]))))
    assert sorted(((r.q, r.uri, r.at, r.version and tuple(r.version)) for r in got), key=repr) == sorted(want, key=repr)
    later = lambda x: min((y for y in known if y[0] == x[0] and order(y) > order(x)), key=order, default=None)
    want = sorted(((*x, x[1], (later(x) or (0, None))[1]) for x in known), key=repr)
    assert sorted(((r.uri, r.written, r.id, r.valid_from, r.valid_to) for r in spans), key=repr) == want


def test_each_question_lies_in_one_interval(spark):
    versions, questions = tables(spark, 8)
    v, q = frames(spark, versions, questions)
    found = history.as_of(v, q, "uri", "written", "at", "id").filter("version IS NOT NULL")
    spans = history.intervals(v, "uri", "written", "id")
    inside = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    both = found.join(spans.drop("size"), "uri").filter(inside & F.col("version.id").eqNullSafe(F.col("id")))
    assert both.count() == found.count() > 300


def test_empty_tables(spark):
    v, q = frames(spark, *tables(spark))
    assert history.as_of(v, q.limit(0), "uri", "written", "at", "id").collect() == []
    assert {r.version for r in history.as_of(v.limit(0), q, "uri", "written", "at", "id").collect()} == {None}
    assert history.intervals(v.limit(0), "uri", "written", "id").collect() == []
