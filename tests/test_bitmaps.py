"""Boolean search by bitmaps: the rows of the postings search, and positions that are not read."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import bitmaps, keywords
from tests_support import questions_frame

QUESTIONS = [
    "w0 w1", "w0 -w1", "w0 OR w1 OR w30", "w2 -w0 OR w3 -w1", '"w0 w1" -w2', 'w0 -"w1 w2"', "w30 w0", "w31 -w0",
    "-w0", "nothere w0", "w0 w0", "w1 OR -w0",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(2, 12))) for _ in range(700)]
    texts += texts[:1] * 350 + ["", " "]  # a third are copies
    chunks = spark.createDataFrame([(f"c{i}", text) for i, text in enumerate(texts)], "chunk_id string, content string")
    rows = bitmaps.number_chunks(chunks.repartition(5)).cache()
    assert sorted(r.number for r in rows.collect()) == list(range(len(texts)))
    path = str(tmp_path_factory.mktemp("bitmaps"))
    bitmaps.write_index(keywords.postings(rows, keep=("number",)), len(texts), path)
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/bitmaps")


def test_same_rows_as_the_postings_search(spark, index, monkeypatch):
    rows, kept = index
    clauses = keywords.query_clauses(questions_frame(spark, QUESTIONS))
    want = sorted(map(tuple, keywords.match(rows.drop("number"), clauses).collect()))
    got = bitmaps.match(rows, kept, clauses).select("query_id", "chunk_id", "score").collect()
    assert sorted(map(tuple, got)) == want and len({row[0] for row in want}) >= 9


def test_only_frequent_terms_are_kept(index):
    rows, kept = index
    df = {r.term: r.n for r in rows.groupBy("term").agg(F.countDistinct("chunk_id").alias("n")).collect()}
    held = {r.term: r.n for r in kept.groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    assert held == {term: n for term, n in df.items() if n >= 0.1 * 1052} and 0 < len(held) < len(df)


def test_bitmaps_are_made_of_terms_that_can_be_frequent(spark, tmp_path, monkeypatch):
    """A bitmap takes 4 KB, however rare its term, so rare terms get none on the way."""
    rows = spark.range(400).select(
        F.col("id").alias("number"),
        F.concat(F.lit("c"), "id").alias("chunk_id"),
        F.explode(F.array(F.lit("mua"), F.concat(F.lit("rare"), "id"))).alias("term"),
        F.lit(0).alias("pos"),
    )
    seen, made = [], bitmaps.bitmaps
    monkeypatch.setattr(bitmaps, "bitmaps", lambda frame: seen.append(frame) or made(frame))
    bitmaps.write_index(rows, 400, str(tmp_path / "index"))
    assert [frame.select("term").distinct().count() for frame in seen] == [1]
    assert [r.term for r in spark.read.parquet(f"{tmp_path}/index/bitmaps").collect()] == ["mua"]


def test_positions_are_read_for_survivors_only(spark, index):
    rows, kept = index
    clauses = keywords.query_clauses(questions_frame(spark, ["w0 -w1 -w2 -w3 -w4", "w30 w0"])).cache()
    found = bitmaps.survivors(rows, kept, clauses).select("query_id", "number").distinct().cache()
    read = bitmaps.read_positions(rows, clauses, found).cache()
    asked = rows.join(clauses.select("term").distinct(), "term", "left_semi")
    assert 0 < read.count() < 0.25 * asked.count()
    assert read.select("number").distinct().count() <= found.select("number").distinct().count()


def test_several_pages(spark, tmp_path, monkeypatch):
    """Chunk numbers beyond one page."""
    n = 2 * bitmaps.PAGE + 100
    rows = spark.range(n).select(
        F.col("id").alias("number"),
        F.concat(F.lit("c"), "id").alias("chunk_id"),
        F.explode(F.array(F.lit("mua"), F.when(F.col("id") % 3 == 0, "xyz").otherwise("vtu"))).alias("term"),
        F.lit(0).alias("pos"),
    )
    bitmaps.write_index(rows, n, str(tmp_path / "index"))
    rows, kept = (spark.read.parquet(f"{tmp_path}/index/{name}") for name in ("postings", "bitmaps"))
    assert kept.filter("term = 'mua'").count() == 3
    clauses = keywords.query_clauses(questions_frame(spark, ["mua -vtu", "xyz OR vtu"]))
    found = bitmaps.survivors(rows, kept, clauses).cache()
    assert {r.number for r in found.filter("query_id = 'q0'").collect()} == set(range(0, n, 3))
    assert found.filter("query_id = 'q1'").select("number").distinct().count() == n


def test_empty_tables(spark, index):
    rows, kept = index
    clauses = keywords.query_clauses(questions_frame(spark, QUESTIONS))
    assert bitmaps.match(rows.limit(0), kept.limit(0), clauses).collect() == []
    assert bitmaps.match(rows, kept, clauses.limit(0)).collect() == []
    assert bitmaps.number_chunks(rows.select("chunk_id").limit(0)).collect() == []
