"""Keyword top-k that skips ranges of chunks by bounds on their scores.

Chunks are dealt into ranges, and a summary beside the postings holds, per term and range, the
most often the term occurs in a chunk of it. A group of m different wanted terms scores at most
``0.1 m`` for each occurrence of its scarcest term: a cover adds at most 0.1, and of the covers
that hold one occurrence, every term starts at most one (behind its start, a term comes again only
after the cover's end). So the summary alone bounds what any chunk of a range can score.

The ranges with the largest bounds are answered first. The k-th best score found there is the
threshold, and of the others only ranges whose bound reaches it are read at all. The result is
that of ``keywords.keyword_topk``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import keywords, membership, vectors
from sheaf.session import broadcast_if_small, stored, without_shuffle_files

CHUNKS_PER_RANGE = 64
SUMMARY_PARTS = 4
FIRST_RANGES = 8  # answered before there is a threshold
SLACK = 10.0**-keywords.DIGITS


def range_of(chunk_id: Column, n_ranges: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(n_ranges))


def count_ranges(n_chunks: int, per_range: int = CHUNKS_PER_RANGE) -> int:
    return max(1, -(-n_chunks // per_range))


def ranged(rows: DataFrame, n_ranges: int) -> DataFrame:
    """Postings with the ``range`` of their chunk."""
    return rows.withColumn("range", range_of(F.col("chunk_id"), n_ranges))


def write_ranged(rows: DataFrame, path: str, n_ranges: int) -> None:
    """Store postings and their summary. Each task writes its own as they come, neither shuffled nor sorted,
    so that the rows of a chunk stay together and share its id and range."""
    spark = rows.sparkSession
    ranged(rows, n_ranges).write.parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    for part in range(SUMMARY_PARTS):  # so that a part of the postings is shuffled at a time
        some = written.filter(F.pmod("range", F.lit(SUMMARY_PARTS)) == part)
        with without_shuffle_files(spark):
            summary(some).write.mode("append").parquet(f"{path}/summary")


def summary(rows: DataFrame) -> DataFrame:
    """``(term, range, most, n)``: the largest count in one chunk, and all postings, of a term in a range.

    Rows are dealt by range once, which serves the counts by chunk and those by range.
    """
    # Chunks go by a hash of their ids; two that share one could only raise a bound.
    chunk = F.xxhash64("chunk_id").alias("chunk")
    dealt = rows.select("term", "range", chunk).repartition("range")
    per_chunk = dealt.groupBy("term", "range", "chunk").agg(F.count("*").alias("tf"))
    return per_chunk.groupBy("term", "range").agg(F.max("tf").alias("most"), F.sum("tf").alias("n"))


def present(summaries: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(query_id, grp, range, bound, complete)`` of the groups of a question that may match in a range.

    Groups with all their terms there are ``complete`` and have a bound. Where questions share an id, a group may
    hold the terms of several; such a group counts as present, without a bound, wherever one of its terms is.
    """
    wanted = clauses.filter(~F.col("negated")).select("query_id", "grp", "n_slots", "term").distinct()
    of_group = Window.partitionBy("query_id", "grp")
    one_size = F.min("n_slots").over(of_group) == F.max("n_slots").over(of_group)
    wanted = wanted.withColumn("mixed", (F.count("*").over(of_group) != F.col("n_slots")) | ~one_size)
    most = F.lit(keywords.TERM_WEIGHT) * F.col("n_slots") * F.col("least")
    complete = F.col("present") == F.col("n_slots")
    return (
        summaries.join(broadcast_if_small(stored(wanted, "wanted")), "term")
        .groupBy("query_id", "grp", "n_slots", "range")
        .agg(F.count("*").alias("present"), F.min("most").alias("least"), F.max("mixed").alias("mixed"))
        .filter(complete | F.col("mixed"))
        .select("query_id", "grp", "range", F.when(complete, most).alias("bound"), complete.alias("complete"))
    )


def bounds(summaries: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(query_id, range, bound, groups)`` of the ranges where ``groups`` of the question may match."""
    return (
        present(summaries, clauses)
        .groupBy("query_id", "range")
        .agg(F.sum("bound").alias("bound"), F.collect_set("grp").alias("groups"), F.max("complete").alias("complete"))
        .filter("complete")
        .drop("complete")
    )


def needed(clauses: DataFrame, wave: DataFrame) -> DataFrame:
    """``(term, range)`` of the postings that the ``wave`` (query_id, range) reads, excluded terms among them.

    With ``groups`` in the wave, only terms of these: another group lacks a term in the range.
    """
    asked = clauses.select("query_id", "grp", "term").distinct()
    if "groups" in wave.columns:
        wave = wave.select("query_id", "range", F.explode("groups").alias("grp"))
        found = asked.join(wave, ["query_id", "grp"])
    else:
        found = asked.join(wave.select("query_id", "range"), "query_id")
    return found.select("term", "range").distinct()


def scored(rows: DataFrame, clauses: DataFrame, wave: DataFrame, n_ranges: int) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the matches in the ranges of each question.

    Postings are filtered where they are read. Beyond a broadcast, some more than those needed pass, which
    changes nothing: what a question shares in other ranges is left out at the end.
    """
    keys = stored(needed(clauses, wave), "needed")
    sent = broadcast_if_small(keys)
    if sent is keys:
        place = F.xxhash64("term", "range").alias("place")
        some = membership.likely(rows.withColumn("place", place), keys.select(place), "place").drop("place")
    else:
        some = rows.join(sent, ["term", "range"], "left_semi")
    some = stored(some.drop("range"), "read")
    # A question that shares a term with another one is complete in its own ranges only.
    found = keywords.match(some, clauses).withColumn("range", range_of(F.col("chunk_id"), n_ranges))
    return found.join(wave.select("query_id", "range"), ["query_id", "range"], "left_semi").drop("range")


def waves(summaries: DataFrame, clauses: DataFrame, first: int = FIRST_RANGES) -> DataFrame:
    """The bounds of each question's ranges with ``first``: whether they are answered before there is a threshold."""
    found = stored(bounds(summaries, clauses), "bounds")
    best = vectors.topk_per_question(found, first, F.desc("bound"), F.asc("range")).select("query_id", "range", F.lit(True).alias("first"))
    return found.join(best, ["query_id", "range"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def second_wave(ranges: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ranges not answered yet whose bound reaches the k-th best score."""
    ranked = vectors.topk_per_question(found, k, F.desc("score"))
    threshold = ranked.filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    open_ = ranges.filter("NOT first").join(threshold, "query_id", "left")
    return open_.filter(F.col("threshold").isNull() | (F.col("bound") + 2 * SLACK >= F.col("threshold")))


def keyword_topk(
    rows: DataFrame, summaries: DataFrame, clauses: DataFrame, k: int, n_ranges: int, first: int = FIRST_RANGES
) -> DataFrame:
    """Best ``k`` matching chunks per question: ``(query_id, chunk_id, score, rank)``.

    ``rows`` are stored postings with their ``range`` and ``summaries`` their summary. Groups that
    only exclude are left to ``keywords.let_through``.
    """
    clauses = stored(clauses.filter("n_required > 0"), "clauses")
    ranges = stored(waves(summaries, clauses, first), "waves")
    early = stored(scored(rows, clauses, ranges.filter("first"), n_ranges), "early")
    late = stored(second_wave(ranges, early, k), "late")
    found = early.unionByName(scored(rows, clauses, late, n_ranges))
    found = found.withColumn("score", F.round("score", keywords.DIGITS))
    return vectors.topk_per_question(found, k, F.desc("score"), F.asc("chunk_id"))
