import json
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sheaf import schemas, session
from sheaf.functions import text
from sheaf.operators import quality, tables
from sheaf.plans import ingest
from sheaf.settings import OBJECT_FINALIZED, ChunkKnobs, EmbedKnobs
from sheaf.sources import objects
from sheaf.operators.keywords import query_clauses
from sheaf.sources.store import Store, full_id, short_id
from sheaf.streaming.ingest import ingest_batch, start_ingest

KNOBS = ingest.IngestKnobs(chunk=ChunkKnobs(20, 5), embed=EmbedKnobs(dim=8))


def at(day):
    return F.lit(datetime(2024, 1, day)).cast("timestamp")


def upload(spark, *names):
    rows = [(f"gs://b/{n}", n, f"hash-{n}-{v}", v, "{}") for n, v in names]
    return spark.createDataFrame(
        rows, "gcs_uri string, filename string, content_hash string, num_pages int, metadata string"
    )


def test_upsert_twice_equals_once_and_keeps_history(spark):
    empty = spark.createDataFrame([], schemas.DOCUMENTS)
    first = tables.upsert_documents(empty, upload(spark, ("a.pdf", 1), ("b.pdf", 1)), at(1))
    ids = {r.gcs_uri: r.id for r in first.collect()}
    done = tables.apply_outcomes(
        first.withColumn("size_bytes", F.lit(7).cast("long")),
        spark.createDataFrame([(ids["gs://b/a.pdf"], None), (ids["gs://b/b.pdf"], "bad")], "document_id string, error string"),
        at(2),
    )
    states = {r.filename: (r.status, r.error, r.processed_at.day) for r in done.collect()}
    assert states == {"a.pdf": ("completed", None, 2), "b.pdf": ("failed", "bad", 2)}

    batch = upload(spark, ("b.pdf", 3), ("c.pdf", 1))
    once = tables.upsert_documents(done, batch, at(5))
    twice = tables.upsert_documents(once, batch, at(5))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    rows = {r.filename: r for r in once.collect()}
    assert rows["a.pdf"].status == "completed" and rows["a.pdf"].uploaded_at.day == 1
    b = rows["b.pdf"]
    assert (b.status, b.error, b.processed_at, b.num_pages) == ("processing", None, None, 3)
    assert (b.id, b.uploaded_at.day, b.size_bytes) == (ids["gs://b/b.pdf"], 1, 7)
    assert rows["c.pdf"].uploaded_at.day == 5


def test_zip_vectors_marks_incomplete_documents(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "document_id string, chunk_index int")
    vectors = spark.createDataFrame(
        [("a", 0, [1.0]), ("b", 0, [1.0]), ("c", 0, [1.0])],
        "document_id string, chunk_index int, embedding array<float>",
    )
    rows = {(r.document_id, r.chunk_index): r.complete for r in tables.zip_vectors(chunks, vectors).collect()}
    assert rows == {("a", 0): False, ("a", 1): False, ("b", 0): True, ("c", 0): False}


def test_quality_checks(spark):
    docs = spark.createDataFrame([("1", "completed"), ("2", "odd"), ("3", None)], "id string, status string")
    assert {r.id for r in quality.bad_status(docs).collect()} == {"2", "3"}
    rows = spark.createDataFrame([("1",), ("9",), (None,)], "document_id string")
    assert [r.document_id for r in quality.orphans(rows, docs).collect()] == ["9"]
    vecs = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    assert quality.bad_vectors(vecs, 2).count() == 2
    hashed = spark.createDataFrame([("1", "x"), ("0", "x"), ("2", None)], "id string, content_hash string")
    assert [(r.id, r.n_copies) for r in quality.dedupe_by_hash(hashed).collect()] == [("0", 2)]


def event(name, day, content, ce_id=None, bucket="b", ce_type=OBJECT_FINALIZED):
    moment = datetime(2024, 1, day)
    body = None if content is None else content.encode()
    return (ce_type, name, ce_id or f"{name}-{day}", bucket, name, moment, body)


def event_frame(spark, *rows):
    schema = schemas.OBJECT_EVENTS.simpleString()[7:-1].replace(":", " ") + ", content binary"
    return spark.createDataFrame(list(rows), schema)


def state(store):
    docs = {r.filename: r for r in store.documents().collect()}
    chunks = {}
    for r in store.chunks().orderBy("chunk_index").collect():
        chunks.setdefault(r.document_id, []).append(r.content)
    return docs, {n: chunks.get(d.id, []) for n, d in docs.items()}


def test_batches_replays_failures_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.documents().count() == store.chunks().count() == store.events().count() == 0

    first = event_frame(
        spark,
        event("x/a.pdf", 1, "first text of a"),
        event("x/a.pdf", 2, "second text of a"),
        event("b.PDF", 1, "only b\fpage two"),
        event("blank.pdf", 1, " \f "),
        event("empty.pdf", 1, ""),
        event("note.txt", 1, "no"),
        event("", 1, "no"),
    )
    results = ingest_batch(first, store, KNOBS, batch_id=0)
    outcome = {r.gcs_uri: (r.num_pages, r.num_chunks, r.skipped, r.reason) for r in results.collect()}
    assert outcome == {
        "gs://b/x/a.pdf": (1, 1, False, ""),
        "gs://b/b.PDF": (2, 2, False, ""),
        "gs://b/blank.pdf": (0, 0, False, ingest.NO_TEXT),
        "gs://b/empty.pdf": (0, 0, False, ingest.EMPTY_OBJECT),
        "gs://b/note.txt": (None, None, True, "not a pdf"),
        "gs://b/": (None, None, True, "missing bucket or name"),
    }
    docs, chunks = state(store)
    assert set(docs) == {"a.pdf", "b.PDF", "blank.pdf"}
    assert chunks["a.pdf"] == ["second text of a"] and chunks["b.PDF"] == ["only b", "page two"]
    assert (docs["blank.pdf"].status, docs["blank.pdf"].error) == ("failed", ingest.NO_TEXT)
    assert docs["b.PDF"].num_pages == 2 and docs["a.pdf"].status == "completed"
    assert docs["a.pdf"].metadata == '{"raw_bucket":"b","raw_object":"x/a.pdf"}'
    assert {r.reason for r in store.rows("rejected").collect()} == {"not a pdf", "missing bucket or name"}
    log = [(r.event_type, r.message, r.document_id is None) for r in store.events().collect()]
    assert sorted(log, key=str) == sorted(
        [("started", None, False)] * 3
        + [("completed", None, False)] * 2
        + [("failed", ingest.NO_TEXT, False), ("failed", ingest.EMPTY_OBJECT, True)],
        key=str,
    )
    assert {r.target_name: r.text for r in store.texts().collect()} == {
        "x/a.txt": "[page 1]\nsecond text of a",
        "b.txt": "[page 1]\nonly b\n\n[page 2]\npage two",
    }
    uploaded = docs["a.pdf"].uploaded_at

    # a failed re-ingest hides the document but keeps its chunks; stale events are ignored
    second = event_frame(
        spark, event("b.PDF", 3, "\f"), event("x/a.pdf", 1, "stale"), event("new.pdf", 3, "new")
    )
    for _ in range(2):  # the second run is a replay of the same batch
        ingest_batch(second, store, KNOBS, batch_id=1)
        docs, chunks = state(store)
        assert docs["b.PDF"].status == "failed" and chunks["b.PDF"] == ["only b", "page two"]
        assert chunks["a.pdf"] == ["second text of a"] and docs["a.pdf"].uploaded_at == uploaded
        assert chunks["new.pdf"] == ["new"] and len(docs) == 4
        assert store.events().count() == 7 + 4

    third = event_frame(spark, event("b.PDF", 4, "b is back"))
    ingest_batch(third, store, KNOBS, batch_id=2)
    docs, chunks = state(store)
    assert chunks["b.PDF"] == ["b is back"] and docs["b.PDF"].status == "completed"

    # a replay of an old batch changes nothing
    assert ingest_batch(first, store, KNOBS, batch_id=0) is None
    before = state(store)
    version = store.compact()
    assert store.published() == version
    after = state(store)
    assert after[1] == before[1] and {n: d.status for n, d in after[0].items()} == {
        n: d.status for n, d in before[0].items()
    }
    assert store.rows("chunks").select("version").distinct().count() == 1

    gone = store.documents().filter("filename = 'a.pdf'").select("id")
    n_events = store.events().count()
    removed = store.events().join(gone.withColumnRenamed("id", "document_id"), "document_id").count()
    store.delete_documents(gone)
    docs, chunks = state(store)
    assert "a.pdf" not in docs and store.events().count() == n_events - removed
    assert store.chunks().select("document_id").distinct().count() == 2
    assert quality.orphans(store.chunks(), store.documents()).count() == 0
    assert {r.target_name for r in store.texts().collect()} == {"b.txt", "new.txt"}
    assert quality.duplicate_keys(store.documents(), "gcs_uri").count() == 0
    assert quality.duplicate_keys(store.chunks(), "document_id", "chunk_index").count() == 0

    # uploading a deleted object again makes a new document
    ingest_batch(event_frame(spark, event("x/a.pdf", 9, "a again")), store, KNOBS, batch_id=3)
    docs, chunks = state(store)
    assert chunks["a.pdf"] == ["a again"] and docs["a.pdf"].uploaded_at > uploaded
    listed = [r.table for r in store.tables().select("table").distinct().orderBy("table").collect()]
    assert listed == ["chunks", "documents", "events", "postings", "rejected", "texts"]
    assert Store(spark, str(tmp_path / "none")).tables().collect() == []


def test_uncommitted_versions_stay_unseen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ingest_batch(event_frame(spark, event("a.pdf", 1, "one")), store, KNOBS)
    attempt = store.new_attempt()
    store.write("documents", attempt, store.documents().withColumn("status", F.lit("failed")))
    assert store.documents().first().status == "completed"
    store.commit(attempt)
    assert store.documents().first().status == "failed"
    with pytest.raises(AnalysisException):  # what is written is never written again
        store.write("documents", attempt, store.documents())


def test_streams_of_their_own_keep_each_other_s_rows(spark, tmp_path):
    """Two checkpoints, one of them new, into one store."""
    store = Store(spark, str(tmp_path / "store"))
    for name, events in (("one", ["a.pdf", "b.pdf"]), ("two", ["c.pdf"]), ("one", ["d.pdf"])):
        uploads = str(tmp_path / f"uploads-{name}")
        frame = event_frame(spark, *(event(e, 1, f"text of {e}") for e in events))
        frame.coalesce(1).write.mode("append").parquet(uploads)
        stream = spark.readStream.schema(frame.schema).parquet(uploads)
        start_ingest(stream, store, str(tmp_path / f"checkpoint-{name}"), KNOBS).awaitTermination()
    docs, chunks = state(store)
    assert set(docs) == {"a.pdf", "b.pdf", "c.pdf", "d.pdf"} and chunks["c.pdf"] == ["text of c.pdf"]
    assert store.published() == 3


def test_writers_that_commit_at_once_get_versions_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: store.commit(f"attempt-{i}", f"writer-{i}", 0), range(6)))
        # The same batch, committed by several: one of them counts.
        same = list(pool.map(lambda i: store.commit(f"again-{i}", "stream", 7), range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert sorted(x is None for x in same) == [False] + [True] * 5 and 7 in same
    commits = store.commits().collect()
    assert sorted(r.version for r in commits) == list(range(1, 8)) and store.published() == 7
    assert not [name for name in os.listdir(tmp_path / "commits") if not name.endswith((".json",))]


def test_two_batches_at_once_keep_every_row(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = [[f"{i}-{j}.pdf" for j in range(3)] + ["shared.pdf"] for i in range(2)]

    def run(i):
        batch = event_frame(spark, *(event(name, i + 1, f"text of {name} by {i}") for name in names[i]))
        return ingest_batch(batch, store, KNOBS, writer=f"w{i}", batch_id=0)

    with ThreadPoolExecutor(2) as pool:
        assert all(found is not None for found in pool.map(run, range(2)))
    docs, chunks = state(store)
    assert set(docs) == {name for some in names for name in some} == set(chunks)
    assert store.published() == 2 and store.documents().count() == 7


def test_publish_through_the_hadoop_file_system(spark, tmp_path):
    """Another scheme than file, as on a cluster."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.t.link./data", f"file://{tmp_path}/data")
    os.makedirs(tmp_path / "data")
    assert session.publish(spark, "viewfs://t/data/1", "one") is True
    assert session.publish(spark, "viewfs://t/data/1", "two") is False
    assert open(tmp_path / "data" / "1").read() == "one"
    assert [name for name in os.listdir(tmp_path / "data") if not name.endswith(".crc")] == ["1"]


def test_deletes_and_compactions_next_to_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ingest_batch(event_frame(spark, event("a.pdf", 1, "one"), event("b.pdf", 1, "bee")), store, KNOBS, batch_id=0)
    store.delete_documents(store.documents().filter("filename = 'a.pdf'").select("id"))
    ingest_batch(event_frame(spark, event("c.pdf", 1, "see")), store, KNOBS, batch_id=1)
    assert set(state(store)[0]) == {"b.pdf", "c.pdf"}

    # a batch that commits while a compaction runs stays beside it
    commit = store.commit

    def late(attempt, *more, **named):
        store.commit = commit
        ingest_batch(event_frame(spark, event("d.pdf", 1, "dee"), event("b.pdf", 2, "bee two")), store, KNOBS, batch_id=2)
        return commit(attempt, *more, **named)

    store.commit = late
    store.compact()
    docs, chunks = state(store)
    assert set(docs) == {"b.pdf", "c.pdf", "d.pdf"}
    assert chunks == {"b.pdf": ["bee two"], "c.pdf": ["see"], "d.pdf": ["dee"]}
    store.compact()
    assert state(store)[1] == chunks
    store.delete_documents(store.documents().filter("filename = 'c.pdf'").select("id"))
    assert set(state(store)[0]) == {"b.pdf", "d.pdf"}


def test_store_when_nothing_may_be_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    store = Store(spark, str(tmp_path))
    batch = event_frame(spark, event("a.pdf", 1, "one"), event("a.pdf", 1, "one"), event("b.pdf", 1, "bee"))
    ingest_batch(batch, store, KNOBS)
    ingest_batch(event_frame(spark, event("a.pdf", 2, "two")), store, KNOBS)
    store.delete_documents(store.documents().filter("filename = 'b.pdf'").select("id"))
    assert state(store)[1] == {"a.pdf": ["two"]}
    durations = [json.loads(r.payload).get("duration_ms") for r in store.events().filter("event_type = 'completed'").collect()]
    assert len(durations) == 2 and all(d >= 0 for d in durations)


def test_model_failure_fails_the_document_only(spark, tmp_path):
    def model(texts):
        if any("poison" in t for t in texts):
            raise ValueError("no")
        return [[1.0] * 8 for _ in texts]

    knobs = ingest.IngestKnobs(
        chunk=ChunkKnobs(20, 5), embed=EmbedKnobs(dim=8, attempts=1), model=model
    )
    store = Store(spark, str(tmp_path))
    batch = event_frame(spark, event("a.pdf", 1, "fine"), event("b.pdf", 1, "ok\fpoison"))
    ingest_batch(batch, store, knobs)
    docs, chunks = state(store)
    assert docs["a.pdf"].status == "completed" and chunks["a.pdf"] == ["fine"]
    assert (docs["b.pdf"].status, docs["b.pdf"].error) == ("failed", ingest.NO_VECTORS)
    assert chunks["b.pdf"] == []


def test_events_are_best_effort(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    write = store.write

    def failing(table, version, rows):
        if table == "events":
            raise IOError("log is down")
        write(table, version, rows)

    monkeypatch.setattr(store, "write", failing)
    ingest_batch(event_frame(spark, event("a.pdf", 1, "one")), store, KNOBS, batch_id=0)
    assert store.documents().first().status == "completed"


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    uploads, store = str(tmp_path / "uploads"), Store(spark, str(tmp_path / "store"))
    for wave in ([event("a.pdf", 1, "one")], [event("a.pdf", 2, "two"), event("c.pdf", 2, "see")]):
        frame = event_frame(spark, *wave)
        frame.coalesce(1).write.mode("append").parquet(uploads)
        stream = spark.readStream.schema(frame.schema).parquet(uploads)
        start_ingest(stream, store, str(tmp_path / "checkpoint"), KNOBS).awaitTermination()
    docs, chunks = state(store)
    assert chunks == {"a.pdf": ["two"], "c.pdf": ["see"]}
    assert store.published() == 2


def test_binary_files_as_objects(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "sub" / "raw").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"hello")
    (root / "sub" / "raw" / "b.pdf").write_bytes(b"")
    (root / "sub" / "raw" / "c.pdf").write_bytes(b"see")
    rows = objects.read_objects(spark, str(root), "*.pdf")
    found = {r.name: (r.bucket, r.size) for r in rows.collect()}
    assert found == {"a.pdf": ("raw", 5), "sub/raw/c.pdf": ("raw", 3)}

    odd = ["x{1}.pdf", "report[1].pdf", "a*b ?.pdf", "sp ace.pdf"]
    for name in odd:
        (root / name).write_bytes(name.encode())
    (root / "report1.pdf").write_bytes(b"another")
    missing = ["sub/raw/b.pdf", "gone.pdf", "../raw/a.pdf"]
    frame = event_frame(spark, *(event(n, 1, None, bucket="raw") for n in ["a.pdf", *odd, *missing])).drop("content")
    for held in (1, 1 << 20):
        filled = objects.contents_under(str(root), held)(frame)
        contents = {r.name: r.content and bytes(r.content) for r in filled.collect()}
        assert contents == {"a.pdf": b"hello"} | {n: n.encode() for n in odd} | dict.fromkeys(missing)
    events = frame.filter(F.col("name").isin("a.pdf", "sub/raw/b.pdf", "gone.pdf"))
    filled = objects.contents_under(str(root))(events)
    for name in [*odd, "report1.pdf"]:
        (root / name).unlink()
    full, empty = objects.split_empty(filled)
    assert [r.name for r in full.collect()] == ["a.pdf"] and empty.count() == 2
    by_event = Store(spark, str(tmp_path / "by_event"))
    ingest_batch(events, by_event, KNOBS, contents=objects.contents_under(str(root)))
    assert [r.gcs_uri for r in by_event.documents().collect()] == ["gs://raw/a.pdf"]
    assert by_event.events().filter(F.col("message") == ingest.EMPTY_OBJECT).count() == 2

    store = Store(spark, str(tmp_path / "store"))
    stream = objects.stream_objects(spark, str(root), "*.pdf")
    events = stream.select(
        F.lit(OBJECT_FINALIZED).alias("ce_type"), F.col("name").alias("ce_subject"),
        F.col("name").alias("ce_id"), "bucket", "name", "event_time", "content",
    )
    start_ingest(events, store, str(tmp_path / "checkpoint"), KNOBS).awaitTermination()
    uris = {r.gcs_uri for r in store.documents().collect()}
    assert uris == {"gs://raw/a.pdf", "gs://raw/sub/raw/c.pdf"}


def test_text_and_question_files(spark, tmp_path):
    texts = spark.createDataFrame([("a.txt", "body")], "target_name string, text string")
    objects.write_texts(texts, str(tmp_path / "texts"))
    objects.write_texts(texts, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 1
    questions = spark.createDataFrame([("q", "why")], schemas.QUESTIONS)
    objects.write_answers(questions, str(tmp_path / "q"))
    assert objects.read_questions(spark, str(tmp_path / "q")).collect() == questions.collect()


def test_stored_postings_share_the_ids_of_their_chunks(spark, tmp_path):
    """A posting takes fewer bytes than the two ids of 64 characters in it, footers included, and a task leaves few files."""
    store = Store(spark, str(tmp_path))
    texts = [" ".join(f"w{(7 * n + i) % 911}" for i in range(150)) for n in range(120)]
    batch = event_frame(spark, *(event(f"{n}.pdf", 1, text) for n, text in enumerate(texts)))
    ingest_batch(batch, store, KNOBS)
    files = list((tmp_path / "postings").rglob("*.parquet"))
    n_rows = store.rows("postings").count()
    assert n_rows >= 150 * 120
    assert sum(path.stat().st_size for path in files) < 64 * n_rows
    tasks = len({path.name.split("-")[1] for path in files})
    assert len(files) <= 16 * tasks


def test_postings_keep_short_ids_and_staged_rows_go(spark, tmp_path):
    """The hash of a chunk's place is not kept in every bucket, and what was staged is removed with the batch."""
    store = Store(spark, str(tmp_path))
    texts = ["\f".join(f"word{n} page{p} other{n * p}" for p in range(6)) for n in range(20)]
    for at in (1, 2):
        ingest_batch(event_frame(spark, *(event(f"{n}.pdf", at, text) for n, text in enumerate(texts[::at]))), store, KNOBS)
    store.compact()
    assert not any((tmp_path / "staged").iterdir())
    kept = spark.read.parquet(str(tmp_path / "postings"))
    assert kept.agg(F.max(F.length("chunk_id"))).first()[0] < 5
    ids = {r.id for r in store.chunks().collect()}
    asked = spark.createDataFrame([("q", "word2 OR page1")], "query_id string, question string")
    found = store.postings(query_clauses(asked)).collect()
    assert {r.chunk_id for r in store.rows("postings").collect()} == ids and len(ids) == 120
    assert {r.chunk_id for r in found} <= ids and {r.term for r in found} == {"word2", "page1"} and len(found) == 6 + 20


def test_any_chunk_id_comes_back_from_postings(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ids = ["x", "#", "#3", "##", "##7", "", None]
    rows = spark.createDataFrame([("t", chunk, n, "d") for n, chunk in enumerate(ids)], schemas.POSTINGS)
    store.write_postings("a", rows)
    store.commit("a")
    assert {r.pos: r.chunk_id for r in store.rows("postings").collect()} == dict(enumerate(ids))
    chunks = spark.createDataFrame([(chunk, "d", 3) for chunk in ids] + [(None, None, 1)], "id string, document_id string, chunk_index int")
    chunks = chunks.withColumn("key", text.chunk_key("document_id", F.col("chunk_index")))
    chunks = chunks.unionByName(chunks.withColumn("id", F.col("key")))
    short = chunks.withColumn("short", short_id("id", "document_id", "chunk_index"))
    assert short.filter("id = key AND short NOT IN ('#3', '#1')").count() == 0
    assert short.filter(~full_id("short", "document_id").eqNullSafe(F.col("id"))).count() == 0


def test_superseded_chunks_beyond_a_broadcast_shuffle_no_chunks(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    ingest_batch(event_frame(spark, event("a.pdf", 1, "one"), event("b.pdf", 1, "bee")), store, KNOBS)
    ingest_batch(event_frame(spark, event("a.pdf", 2, "two")), store, KNOBS)
    monkeypatch.setattr("sheaf.sources.store.broadcast_if_small", lambda df: df)
    shown = store.chunks()
    assert sorted(r.content for r in shown.collect()) == ["bee", "two"]
    assert "Exchange hashpartitioning(document_id" not in shown._jdf.queryExecution().executedPlan().toString()
