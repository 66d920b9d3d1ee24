"""Ingest by difference: states of chunks, reused vectors, model calls, postings."""

import os

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import keywords
from sheaf.plans import difference
from sheaf.plans.ingest import IngestKnobs
from sheaf.settings import EmbedKnobs

COLUMNS = "document_id string, chunk_index int, page_number int, content string"


def chunk_frame(spark, documents):
    rows = [(doc, i, 1, content) for doc, contents in documents.items() for i, content in enumerate(contents)]
    return spark.createDataFrame(rows, COLUMNS)


def counting_model(path):
    def model(texts):
        with open(path, "a") as calls:
            calls.writelines(f"{content}\n" for content in texts)
        return [[float(len(content)), 1.0] for content in texts]

    return model


BEFORE = {"d1": ["alpha", "beta", "gamma"], "d2": ["delta", "delta"], "d3": ["only here"], "d4": ["same"], "d5": ["gone soon"]}
AGAIN = {"d1": ["new first", "alpha", "gamma"], "d2": ["delta"], "d4": ["same"], "d5": [], "d6": ["beta", "fresh", "fresh"]}


@pytest.fixture
def stored_chunks(spark):
    rows = chunk_frame(spark, BEFORE)
    vector = F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))
    return rows.withColumn("id", text.chunk_key("document_id", F.col("chunk_index"))).withColumn("embedding", vector)


def test_states_and_counts(spark, stored_chunks):
    documents = spark.createDataFrame([(doc,) for doc in [*AGAIN, "d1"]], "document_id string")
    changed = difference.changes(stored_chunks, documents, chunk_frame(spark, AGAIN)).cache()
    got = sorted((r.document_id, r.chunk_index, r.state) for r in changed.collect())
    assert got == [
        ("d1", 0, "new"), ("d1", 1, "gone"), ("d1", 1, "moved"), ("d1", 2, "kept"), ("d2", 0, "kept"),
        ("d4", 0, "kept"), ("d5", 0, "gone"), ("d6", 0, "new"), ("d6", 1, "new"), ("d6", 2, "new"),
    ]
    counts = {r.document_id: tuple(r)[1:] for r in difference.counts(changed).collect()}
    assert counts["d1"] == (1, 1, 1, 1) and counts["d5"] == (0, 0, 0, 1) and "d3" not in counts


def test_only_unknown_contents_reach_the_model(spark, stored_chunks, tmp_path):
    calls = str(tmp_path / "calls")
    knobs = IngestKnobs(embed=EmbedKnobs(dim=2), model=counting_model(calls))
    documents = spark.createDataFrame([(doc,) for doc in AGAIN], "document_id string")
    rows, posts = difference.reingest(stored_chunks, documents, chunk_frame(spark, AGAIN), knobs)
    got = {(r.document_id, r.chunk_index): (r.state, r.embedding[0]) for r in rows.collect()}
    assert got[("d1", 1)] == ("moved", 5.0) and got[("d6", 2)] == ("new", 5.0) and got[("d6", 0)] == ("new", 4.0)
    assert len(got) == 8 and rows.count() == 8 and posts.count() > 0
    # One call each for contents that no stored chunk has, however often they stand and the result is read.
    assert sorted(open(calls).read().split("\n")[:-1]) == ["fresh", "new first"]
    posted = {r.chunk_id for r in posts.select("chunk_id").distinct().collect()}
    assert posted == {r.id for r in rows.filter("state <> 'kept'").collect()}
    assert {r.term for r in posts.filter("document_id = 'd6'").collect()} == {
        r.term for r in keywords.postings(chunk_frame(spark, {"d6": AGAIN["d6"]}).withColumn("chunk_id", F.lit("x"))).collect()
    }


def test_unchanged_documents_cost_nothing(spark, stored_chunks, tmp_path):
    calls = str(tmp_path / "calls")
    knobs = IngestKnobs(embed=EmbedKnobs(dim=2), model=counting_model(calls))
    documents = spark.createDataFrame([(doc,) for doc in BEFORE], "document_id string")
    rows, posts = difference.reingest(stored_chunks, documents, chunk_frame(spark, BEFORE), knobs)
    assert {r.state for r in rows.collect()} == {"kept"} and posts.count() == 0 and not os.path.exists(calls)


def test_empty_tables(spark, stored_chunks):
    documents = spark.createDataFrame([("d1",)], "document_id string")
    fresh = chunk_frame(spark, {"d1": ["alpha"]})
    assert difference.changes(stored_chunks, documents.limit(0), fresh.limit(0)).collect() == []
    assert [r.state for r in difference.changes(stored_chunks.limit(0), documents, fresh).collect()] == ["new"]
