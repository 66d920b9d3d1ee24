"""Keyword top-k by bounds: the same rows as without them, and postings that are not read."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import bounded, keywords
from sheaf.session import stored
from tests_support import questions_frame

QUESTIONS = ["w0", "w1 w2", '"w0 w1" OR w7', "w0 -w3", "w5 OR w9 OR w30 w31", "-w1", "nothere", "w0 nothere", "w2 w2", "w3 OR -w1"]


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(3, 60))) for _ in range(n)]
    return texts + texts[:1] * (n // 2)  # a third are copies


def indexed(spark, texts, path, per_range=8):
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    n_ranges = bounded.count_ranges(len(texts), per_range)
    bounded.write_ranged(keywords.postings(rows), path, n_ranges)
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/summary"), n_ranges


def as_rows(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return indexed(spark, corpus(), str(tmp_path_factory.mktemp("ranged")))


@pytest.mark.parametrize("first", [1, 8])
def test_same_rows_as_without_bounds(spark, index, first):
    rows, summaries, n_ranges = index
    clauses = keywords.query_clauses(questions_frame(spark, QUESTIONS))
    for k in (3, 50):
        got = bounded.keyword_topk(rows, summaries, clauses, k, n_ranges, first)
        assert as_rows(got) == as_rows(keywords.keyword_topk(rows.drop("range"), clauses, k))


def test_bounds_hold(spark, index):
    """No chunk scores above the bound of its range, which the summary alone gives."""
    rows, summaries, n_ranges = index
    clauses = keywords.query_clauses(questions_frame(spark, QUESTIONS)).cache()
    found = keywords.match(rows.drop("range"), clauses)
    found = found.withColumn("range", bounded.range_of(F.col("chunk_id"), n_ranges))
    joined = found.join(bounded.bounds(summaries, clauses), ["query_id", "range"], "left").cache()
    assert joined.count() > 500
    assert joined.filter("bound IS NULL OR score > bound + 1e-9").count() == 0
    # A word by itself reaches its bound.
    assert joined.filter("query_id = 'q0' AND abs(score - bound) < 1e-9").count() > 0


def test_most_covers_of_one_occurrence(spark, tmp_path):
    """The worst texts for the bound: each term starts one cover of the only rare occurrence."""
    texts = ["a1 b2 c3 a1 b2", "b2 a1 c3 b2 a1 b2", "a1 a1 b2 b2 c3 c3 a1 a1 b2 b2", "c3 b2 a1 b2 c3 b2 a1"]
    rows, summaries, n_ranges = indexed(spark, texts, str(tmp_path / "worst"), 1)
    clauses = keywords.query_clauses(questions_frame(spark, ["a1 b2 c3"]))
    scores = {r.chunk_id: r.score for r in keywords.match(rows.drop("range"), clauses).collect()}
    tops = {r.range: r.bound for r in bounded.bounds(summaries, clauses).collect()}
    assert scores[0] == pytest.approx(0.3) and max(scores.values()) <= max(tops.values()) + 1e-9


def test_postings_below_the_threshold_are_not_read(spark, tmp_path):
    """A few chunks with many occurrences: of the frequent term's postings nearly all stay unread."""
    rng = random.Random(9)
    texts = [" ".join(["common"] * rng.randint(1, 3) + rng.choices("xyz", k=5)) for _ in range(3000)]
    for i in (5, 700, 1500, 2200):
        texts[i] = "common " * 40
    rows, summaries, n_ranges = indexed(spark, texts, str(tmp_path / "skewed"), 16)
    clauses = keywords.query_clauses(questions_frame(spark, ["common"])).cache()
    ranges = bounded.waves(summaries, clauses).cache()
    early = bounded.scored(rows, clauses, ranges.filter("first"), n_ranges)
    late = bounded.second_wave(ranges, early, 4)
    read = ranges.filter("first").select("query_id", "range").union(late.select("query_id", "range"))
    keys = bounded.needed(clauses, read)
    total = rows.filter("term = 'common'").count()
    assert rows.join(keys, ["term", "range"], "left_semi").count() < 0.1 * total
    got = bounded.keyword_topk(rows, summaries, clauses, 4, n_ranges)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [5, 700, 1500, 2200]


def test_the_summary_deals_postings_once(spark, index):
    """One exchange serves both counts, and the stored postings keep the order they came in."""
    rows, _, _ = index
    plan = bounded.summary(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    first = rows.select("chunk_id").limit(30).collect()
    assert len({r.chunk_id for r in first}) < 15


def test_empty_tables(spark, index):
    rows, summaries, n_ranges = index
    clauses = keywords.query_clauses(questions_frame(spark, QUESTIONS))
    assert bounded.keyword_topk(rows.limit(0), summaries.limit(0), clauses, 3, n_ranges).collect() == []
    assert bounded.keyword_topk(rows, summaries, clauses.limit(0), 3, n_ranges).collect() == []


def test_only_terms_of_groups_that_may_match_are_read(spark, tmp_path, monkeypatch):
    """A range is read for the groups whose terms are all there, with a filter as with a broadcast."""
    texts = ["alpha common"] * 20 + ["beta common other"] * 20 + ["common"] * 200 + ["gamma beta"] * 3
    rows, summaries, n_ranges = indexed(spark, texts, str(tmp_path / "groups"), 4)
    clauses = keywords.query_clauses(questions_frame(spark, ["alpha OR common beta gamma", "common other -beta"])).cache()
    whole = as_rows(keywords.keyword_topk(rows.drop("range"), clauses, 30))
    ranges = bounded.waves(summaries, clauses, 100)
    keys = bounded.needed(clauses, ranges.filter("query_id = 'q0'"))
    common = rows.join(keys, ["term", "range"], "left_semi").filter("term = 'common'").count()
    assert common < 0.3 * rows.filter("term = 'common'").count()
    assert as_rows(bounded.keyword_topk(rows, summaries, clauses, 30, n_ranges)) == whole and whole
    monkeypatch.setattr(bounded, "broadcast_if_small", lambda df: df)
    read = []
    monkeypatch.setattr(bounded, "stored", lambda df, name: read.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    assert as_rows(bounded.keyword_topk(rows, summaries, clauses, 30, n_ranges)) == whole
    plans = [plan for name, plan in read if name == "read"]
    assert len(plans) == 2 and not any("hashpartitioning(term" in plan for plan in plans)


def test_groups_of_questions_that_share_an_id_are_read_whole(spark, index, monkeypatch):
    """Their terms count together in a match, so the rows are those of reading all terms of a question."""
    rows, summaries, n_ranges = index
    questions = spark.createDataFrame([("q", "w0 OR w3 w4"), ("q", "w1 OR w5 w6 w7"), ("q", "w2 OR w8")], "query_id string, question string")
    clauses = keywords.query_clauses(questions).cache()
    got = as_rows(bounded.keyword_topk(rows, summaries, clauses, 50, n_ranges))
    needed = bounded.needed
    monkeypatch.setattr(bounded, "needed", lambda clauses, wave: needed(clauses, wave.drop("groups")))
    assert got == as_rows(bounded.keyword_topk(rows, summaries, clauses, 50, n_ranges)) and got
