"""Bloom filters before semi joins, and shuffle files that go with their write."""

from pyspark.sql import functions as F

from sheaf.operators import embed, keywords, membership
from sheaf.plans import catalog
from sheaf.session import remove, stored


def test_all_members_stay_and_few_others(spark):
    keys = spark.range(0, 60_000, 2).select(F.xxhash64("id").alias("key")).union(spark.createDataFrame([(0,), (-1,)], "key long"))
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("key"))
    left = membership.likely(rows, keys, "key")
    assert left.columns == rows.columns
    assert left.filter("id % 2 = 0").count() == 30_000
    assert left.filter("id % 2 = 1").count() < 600
    assert membership.likely(rows, keys.limit(0), "key").count() == 0


def test_a_full_filter_still_keeps_all_members(spark, monkeypatch):
    monkeypatch.setattr(membership, "BROADCAST_BYTES", 512)  # one block
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    assert membership.block_filter(keys, 2000)[1] == 1
    assert membership.likely(keys, keys, "key").count() == 2000


def test_hits_elsewhere_are_dropped_before_a_shuffle(spark, monkeypatch):
    """Where candidates are too many to broadcast, what they exclude never reaches the exact join."""
    texts = ["alpha beta"] * 40 + ["beta x alpha"] * 4000
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    questions = spark.createDataFrame([("q", '"alpha beta"')], "query_id string, question string")
    rows, clauses = keywords.postings(corpus).cache(), keywords.query_clauses(questions).cache()
    monkeypatch.setattr(keywords, "broadcast_if_small", lambda df: df)
    passed, likely = [], membership.likely

    def counted(found, keys, key):
        left = likely(found, keys, key)
        passed.append((found.count(), left.count()))
        return left

    monkeypatch.setattr(membership, "likely", counted)
    assert keywords.hits(rows, clauses).count() == 80
    assert [total for total, _ in passed] == [8080] and passed[0][1] < 250


def test_candidates_shuffle_two_longs_a_hit(spark):
    corpus = spark.createDataFrame([(i, "alpha beta gamma") for i in range(50)], "chunk_id long, content string")
    questions = spark.createDataFrame([("q", '"alpha beta"')], "query_id string, question string")
    rows = keywords.postings(corpus).cache()
    anchored = keywords.with_anchors(rows, keywords.query_clauses(questions)).cache()
    plans = []
    stored_as = keywords.stored
    keywords.stored = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored_as(df, name)
    try:
        found = keywords.candidates(rows, anchored)
    finally:
        keywords.stored = stored_as
    assert found.count() == 100 and found.filter("again").count() == 0
    exchanges = [line for line in plans[-1].splitlines() if "hashpartitioning(place" in line]
    assert exchanges and all("REPARTITION" in line for line in exchanges)


def test_stored_results_leave_no_shuffle_files(spark, tmp_path):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    of_shuffles = lambda: {f.getName() for f in _listed(spark, blocks) if f.getName().startswith("shuffle_")}
    before = of_shuffles()
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = stored(grouped, "grouped")
    assert of_shuffles() <= before and kept.count() == 7
    assert kept.inputFiles()
    path = str(tmp_path / "gone")
    spark.range(3).write.parquet(path)
    remove(spark, path)
    assert not (tmp_path / "gone").exists()


def _listed(spark, blocks):
    files = blocks.getAllFiles()
    return [files.apply(i) for i in range(files.size())]


def test_cells_are_stored_without_contents(spark, monkeypatch):
    words = ["alpha beta", "gamma delta", "epsilon", "zeta eta"]
    rows = spark.createDataFrame(
        [(f"c{i:02d}", f"d{i}", 0, 1, words[i % 4] + f" w{i}") for i in range(24)],
        "chunk_id string, document_id string, chunk_index int, page_number int, content string",
    )
    rows = stored(rows.withColumn("embedding", embed.hashed_vector(F.col("content"), catalog.DIM)), "rows")
    documents = rows.select(F.col("document_id").alias("id"), F.lit("f").alias("filename"), F.lit("u").alias("gcs_uri"), F.lit("completed").alias("status"))
    questions = spark.createDataFrame([("q", '"alpha beta"'), ("r", "epsilon")], "query_id string, question string")
    monkeypatch.setattr(catalog, "corpus", lambda spark, sf: rows)
    monkeypatch.setattr(catalog, "stored_documents", lambda spark, sf: documents)
    monkeypatch.setattr(catalog, "benchmark_questions", lambda spark, sf: questions)
    columns = {}
    monkeypatch.setattr(catalog, "stored", lambda df, name: columns.setdefault(name, df.columns) and stored(df, name))
    found = sorted((r.query_id, r.chunk_id, r.rrf_score) for r in catalog.hybrid_batch_cells(spark, "").collect())
    assert columns["cells"] == ["chunk_id", "embedding", "cell"]
    assert found == sorted((r.query_id, r.chunk_id, r.rrf_score) for r in catalog.hybrid_batch(spark, "").collect())


def test_without_is_an_anti_join_that_shuffles_no_rows(spark, monkeypatch):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("d"), F.col("id") % 400)).alias("document_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("a"), F.col("id") % 3)).alias("attempt"),
        "id",
    )
    gone = rows.filter("id % 400 < 150").select("document_id", "attempt")
    gone = stored(gone.union(gone.limit(30)), "gone")
    on = ["document_id", "attempt"]
    expected = sorted(r.id for r in rows.join(gone, on, "left_anti").collect())
    for words in (64, 1):  # a block of 64 bits holds nearly every key: most rows are looked up as others
        monkeypatch.setattr(membership, "_WORDS", words)
        monkeypatch.setattr(membership, "BROADCAST_BYTES", 8 * words)
        left = membership.without(rows, gone, on)
        assert left.columns == rows.columns
        assert sorted(r.id for r in left.collect()) == expected
        plan = left._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and all("hashpartitioning(block" in line for line in dealt)  # the filter's own
