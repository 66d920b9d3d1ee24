import os
from datetime import datetime

from pyspark.sql import functions as F

from sheaf import schemas
from sheaf.functions import terms, text, vectors
from sheaf.operators import events
from sheaf.settings import OBJECT_FINALIZED, EventKnobs

NAMES = [
    "a/b/report.pdf", "b..pdf", ".bashrc", "d.e/f", "x", "a/.hidden.pdf", "a/b.", "...", "UP.PDF",
    "dir.v2/name", "a/b/c.tar.gz",
]


def test_strip_matches_python(spark):
    values = ["  a b ", "\t\n x　", "\x1c\x1dy ", "", " \n ", "no", "a "]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.s for r in rows.select("v", text.strip_all("v").alias("s")).collect()]
    assert got == [v.strip() for v in values]


def test_names_match_python(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    found = rows.select(
        "n", text.file_name(F.col("n")).alias("f"), text.text_name(F.col("n")).alias("t")
    ).collect()
    for row in found:
        assert row.f == os.path.basename(row.n)
        assert row.t == os.path.splitext(row.n)[0] + ".txt"


def test_uri_parts(spark):
    uris = ["gs://b/a/c.pdf", "gs://b/", "gs:///x", "gs://nobucket", "http://b/x", None]
    rows = spark.createDataFrame([(u,) for u in uris], "u string")
    got = [
        tuple(r)
        for r in rows.select(
            text.uri_bucket(F.col("u")), text.uri_name(F.col("u")), text.uri_problem("u")
        ).collect()
    ]
    assert got[0] == ("b", "a/c.pdf", None)
    assert got[1] == ("b", "", None)
    assert got[2] == ("", "x", None)
    assert got[3][2] == "missing object name"
    assert got[4][2] == got[5][2] == "not a gs:// uri"


def test_stem_agrees_with_python(spark):
    values = ["flies", "eies", "movies", "aies", "boxes", "trees", "goes", "taes", "glass", "bus",
              "cats", "s", "es", "ies", "as", "été", "häuser", "us"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.s for r in rows.select("v", terms.stem(F.col("v")).alias("s")).collect()}
    assert got == {v: terms.stem_word(v) for v in values}
    assert got["flies"] == "fly" and got["boxes"] == "boxe" and got["glass"] == "glass"


def test_vector_expressions(spark):
    row = spark.range(1).select(
        F.size(vectors.constant_vector(0.1, 5)).alias("n"),
        vectors.has_width(vectors.constant_vector(0.1, 5), 5).alias("ok"),
        vectors.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("d"),
        vectors.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("none"),
    ).first()
    assert (row.n, row.ok, row.d, row.none) == (5, True, 1.0, None)


def events_frame(spark, *rows):
    return spark.createDataFrame(
        [(t, "s", i, b, n, datetime(2024, 1, d)) for t, i, b, n, d in rows], schemas.OBJECT_EVENTS
    )


def test_triage_order_and_edges(spark):
    frame = events_frame(
        spark,
        (None, "1", "raw", "a.pdf", 1),
        ("", "2", "raw", "A.PDF", 1),
        ("other.type", "3", None, None, 1),
        (OBJECT_FINALIZED, "4", "", "a.pdf", 1),
        (OBJECT_FINALIZED, "5", "else", "a.txt", 1),
        (OBJECT_FINALIZED, "6", "raw", "a.txt", 1),
    )
    rows = {r.ce_id: (r.verdict, r.reason) for r in events.triage(frame, EventKnobs("raw")).collect()}
    assert rows["1"] == rows["2"] == ("accepted", None)
    assert rows["3"] == ("skipped", "unsupported ce-type other.type")
    assert rows["4"] == ("malformed", "missing bucket or name")
    assert rows["5"] == ("skipped", "wrong bucket")
    assert rows["6"] == ("skipped", "not a pdf")
    anywhere = {r.ce_id: r.reason for r in events.triage(frame).collect()}
    assert anywhere["5"] == "not a pdf"


def test_latest_event_wins(spark):
    frame = events_frame(
        spark, ("", "1", "b", "a.pdf", 2), ("", "2", "b", "a.pdf", 3), ("", "3", "b", "a.pdf", 3),
        ("", "4", "b", "c.pdf", 1),
    )
    rows = {r.gcs_uri: r.ce_id for r in events.latest_per_uri(events.accepted(frame)).collect()}
    assert rows == {"gs://b/a.pdf": "3", "gs://b/c.pdf": "4"}
