"""Full-text search: postings, web-style questions, matching and cover-density rank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import terms
from sheaf.operators import membership
from sheaf.operators.vectors import topk_per_question, write_by_size
from sheaf.session import broadcast_if_small, stored
from sheaf.settings import BROADCAST_ROWS

# Weight of a term, and the digits on which scores are compared.
TERM_WEIGHT = 0.1
DIGITS = 9

# A clause is a word or a quoted phrase (an open quote runs to the end), and a
# leading minus excludes it.
CLAUSE = r'(-?"[^"]*"?|[^\s"]+)'


def postings(corpus: DataFrame, text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(term, chunk_id, pos)``; positions count stop words, so distances stay true."""
    return (
        corpus.select("chunk_id", *keep, F.posexplode(terms.words(text_col)).alias("pos", "word"))
        .filter(~terms.is_stop_word(F.col("word")))
        .select(terms.stem(F.col("word")).alias("term"), "chunk_id", "pos", *keep)
    )


def write_postings(rows: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Store postings by ``bucket`` of the term, sorted by term within each file.

    There are about as many buckets as files of that size, and a bucket with a frequent
    term is dealt over files by chunk. The folder above the buckets keeps their number.
    """
    rows = stored(rows, "postings")
    buckets = max(1, -(-rows.count() // rows_per_file))
    rows = rows.withColumn("bucket", term_bucket(F.col("term"), buckets))
    order = ("term", "chunk_id", "pos")
    write_by_size(rows, "bucket", F.xxhash64("chunk_id"), f"{path}/buckets={buckets}", rows_per_file, *order)


def read_postings(spark: SparkSession, path: str, clauses: DataFrame) -> DataFrame:
    """Stored postings, only the buckets that the clauses' terms fall in.

    ``bucket`` is a partition column, so other directories are not read.
    """
    rows = spark.read.parquet(path)
    buckets = rows.select("buckets").first()
    if buckets is None:
        return rows.drop("bucket", "buckets")
    needed = clauses.select(term_bucket(F.col("term"), buckets[0]).alias("bucket")).distinct()
    needed = needed.filter("bucket >= 0")  # true of all; Spark prunes folders only by a filtered side
    return rows.join(F.broadcast(needed), "bucket", "left_semi").drop("bucket", "buckets")  # one row per folder


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_clauses(questions: DataFrame) -> DataFrame:
    """Web-style question texts as rows, one per searched term.

    Words are AND-ed, ``"a phrase"`` wants its terms at their distances, ``OR``
    starts the next group and ``-`` excludes. A word that holds several terms, as
    in ``re-use``, is a phrase. Clauses left without terms vanish.

    Rows are ``(query_id, grp, clause, negated, n_terms, n_group, n_required,
    n_slots, offset, term, slot)``: the terms of the clause and of the group, the
    wanted clauses and distinct wanted terms of the group, and the number of the
    term among the latter.
    """
    tokens = F.regexp_extract_all("question", F.lit(CLAUSE), 1)
    clauses = F.filter(F.transform(F.col("tokens"), _clause), lambda c: F.size(c["terms"]) > 0)
    clauses = F.filter(clauses, lambda c: ~c["is_or"])
    group = F.filter(F.col("clauses"), lambda c: c["grp"] == F.col("c.grp"))
    wanted = F.filter(group, lambda c: ~c["negated"])
    n_group = F.aggregate(group, F.lit(0), lambda n, c: n + F.size(c["terms"]))
    wanted_terms = F.array_distinct(
        F.flatten(F.transform(wanted, lambda c: F.transform(c["terms"], lambda t: t["term"])))
    )
    return (
        questions.select("query_id", tokens.alias("tokens"))
        .select("query_id", clauses.alias("clauses"))
        .select("query_id", "clauses", F.explode("clauses").alias("c"))
        .select(
            "query_id",
            "c",
            n_group.alias("n_group"),
            F.size(wanted).alias("n_required"),
            wanted_terms.alias("slots"),
        )
        .select("*", F.explode("c.terms").alias("t"))
        .select(
            "query_id",
            "c.grp",
            "c.clause",
            "c.negated",
            F.size("c.terms").alias("n_terms"),
            "n_group",
            "n_required",
            F.size("slots").alias("n_slots"),
            "t.offset",
            "t.term",
            (F.array_position("slots", F.col("t.term")).cast("int") - 1).alias("slot"),
        )
    )


def _is_or(token: Column) -> Column:
    return F.lower(token) == "or"


def _clause(token: Column, i: Column) -> Column:
    before = F.slice(F.col("tokens"), F.lit(1), i)
    numbered = F.transform(
        terms.words(token),
        lambda word, at: F.struct(at.alias("offset"), terms.stem(word).alias("term"), word.alias("word")),
    )
    kept = F.filter(numbered, lambda t: ~terms.is_stop_word(t["word"]))
    return F.struct(
        F.size(F.filter(before, _is_or)).alias("grp"),
        i.alias("clause"),
        token.startswith("-").alias("negated"),
        _is_or(token).alias("is_or"),
        F.transform(kept, lambda t: F.struct(t["offset"].alias("offset"), t["term"].alias("term"))).alias(
            "terms"
        ),
    )


def hits(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """Postings of the questions' terms that can still contribute to a match.

    A group of several terms is looked up by its rarest wanted term first, and its
    other terms count only in the chunks found that way. So a frequent term is
    neither shuffled nor compared beyond the chunks of a rare one next to it. If that
    term belongs to a phrase, the phrase is looked up by its two rarest terms at their
    distance, and its other terms count only where those two stand.
    ``clauses`` is read several times and should be stored; beyond BROADCAST_ROWS of
    them the questions are taken in blocks, one scan each, so that postings are
    never shuffled by term. Of hits elsewhere, few reach a shuffle: the chunks and places found
    are broadcast, as a Bloom filter when they are many.
    """
    total = clauses.count()
    blocks = 1 + (2 * total // max(BROADCAST_ROWS, 1) if total > BROADCAST_ROWS else 0)
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [clauses.filter(number == i) if blocks > 1 else clauses for i in range(blocks)]
    return reduce(DataFrame.unionByName, [part for block in parts for part in _block_hits(rows, block)])


def _block_hits(rows: DataFrame, clauses: DataFrame) -> list[DataFrame]:
    total, lone = clauses.agg(F.count("*"), F.count(F.when(F.col("n_group") == 1, 1))).first()
    parts = []
    if lone or not total:
        parts.append(rows.join(F.broadcast(clauses.filter("n_group = 1")), "term"))
    if lone < total:
        several = stored(with_anchors(rows, clauses.filter("n_group > 1")), "anchored")
        near = candidates(rows, several)
        keys = [F.when(F.col("by_phrase"), _phrase_key()).otherwise(_candidate_key())]
        if not near.filter("again").isEmpty():
            keys.append(F.when(F.col("by_phrase"), _again_key()))
        found = rows.join(F.broadcast(several), "term")
        found = found.withColumn("candidate", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))
        near = near.select("candidate")
        sent = broadcast_if_small(near)
        if sent is near:
            found = membership.likely(found, near, "candidate")
        parts.append(found.join(sent, "candidate", "left_semi").drop("candidate", "by_phrase", "anchor"))
    return parts


def _candidate_key() -> Column:
    """One long per question, group and chunk: a small and fast join key.

    Two that collide only let a hit through that the match then turns down.
    """
    return F.xxhash64("query_id", "grp", "chunk_id")


def _phrase_key() -> Column:
    """One long per phrase and place where it would start."""
    return F.xxhash64("query_id", "grp", "clause", "chunk_id", F.col("pos") - F.col("offset"))


def _again_key() -> Column:
    """One long per question, group and chunk whose postings are there more than once."""
    return F.xxhash64(_candidate_key(), F.lit("again"))


def with_anchors(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """``clauses`` with what their group is looked up by.

    ``anchor`` is 1 for the rarest wanted term of a group, 2 for the next rarest of the same phrase,
    and null for all others; ``by_phrase`` is true for the terms of the phrase that holds the anchors.
    Where questions share an id, a clause may hold the terms of several and counts as words.
    """
    wanted = clauses.filter(~F.col("negated"))
    frequency = (
        rows.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    group, clause = Window.partitionBy("query_id", "grp"), Window.partitionBy("query_id", "grp", "clause")
    order = ("negated", "n", "term", "clause", "offset")
    of_one = (
        (F.count("*").over(clause) == F.min("n_terms").over(clause))
        & (F.size(F.collect_set("offset").over(clause)) == F.max("n_terms").over(clause))
        & ~F.max("negated").over(clause)
    )
    place = F.row_number().over(group.orderBy(F.desc("is_first"), *order))
    last = F.when(F.col("by_phrase"), 2).otherwise(1)
    return (
        clauses.join(F.broadcast(frequency), "term", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("is_first", (F.col("clause") == F.first("clause").over(group.orderBy(*order))) & ~F.col("negated"))
        .withColumn("by_phrase", F.col("is_first") & (F.col("n_terms") > 1) & of_one)
        .withColumn("anchor", place)
        .withColumn("anchor", F.when(F.col("is_first") & (F.col("anchor") <= last), F.col("anchor")))
        .drop("n", "is_first")
    )


def candidates(rows: DataFrame, anchored: DataFrame) -> DataFrame:
    """Keys of the chunks that hold a group's anchors, and of the places of a phrase that holds them.

    Where a chunk's postings repeat, all places of the phrase are left to ``complete``, under the key
    marked ``again``. A hit is shuffled as the long of its place, and that of its chunk if it is one of the
    rarest term: a place has both anchors if it has hits with and without the chunk.
    """
    found = rows.join(F.broadcast(anchored.filter("anchor IS NOT NULL")), "term")
    words = found.filter("NOT by_phrase").select(_candidate_key().alias("candidate"), F.lit(False).alias("again"))
    of_first = F.when(F.col("anchor") == 1, _candidate_key())
    places = (
        found.filter("by_phrase")
        .select(_phrase_key().alias("place"), of_first.alias("chunk"))
        .repartition("place")
        .groupBy("place")
        .agg(F.count("*").alias("n"), F.count("chunk").alias("n_first"), F.max("chunk").alias("chunk"))
        .filter("n_first > 1 OR n_first = 1 AND n > 1")
        .groupBy("chunk")
        .agg(F.max(F.col("n_first") > 1).alias("again"), F.collect_set("place").alias("places"))
    )
    chunks = places.select(F.col("chunk").alias("candidate"), F.lit(False).alias("again"))
    again_key = F.xxhash64("chunk", F.lit("again"))
    looked_up = F.when(F.col("again"), F.array(again_key)).otherwise(F.col("places"))
    looked_up = places.select(F.explode(looked_up).alias("candidate"), "again")
    return stored(words.unionByName(chunks).unionByName(looked_up).distinct(), "candidates")


def occurrences(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """Hits that complete a word or phrase of a question.

    Hits are spread by question and chunk once, whatever the frequency of a term,
    and every later step keeps that partitioning.
    """
    return complete(hits(rows, clauses))


def complete(found: DataFrame) -> DataFrame:
    """The hits of words, and of phrases that are there in full."""
    occurrence = Window.partitionBy("query_id", "chunk_id", "grp", "clause", "start")
    return (
        found.withColumn("start", F.col("pos") - F.col("offset"))
        .drop("term", "offset", "n_group")
        .repartition("query_id", "chunk_id")
        .withColumn("n_found", F.count("*").over(occurrence))
        .filter(F.col("n_found") == F.col("n_terms"))
        .drop("n_found", "n_terms", "start")
    )


def match(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)`` of every chunk that satisfies a question.

    A group needs all its wanted clauses and none of its excluded ones, and one
    group is enough. The score adds up the cover density of the groups that match.
    Groups that only exclude are left to ``let_through``.
    """
    excluded = F.col("negated")
    clauses = stored(clauses.filter("n_required > 0"), "clauses")
    groups = (
        occurrences(rows, clauses)
        .groupBy("query_id", "chunk_id", "grp")
        .agg(
            F.size(F.collect_set(F.when(~excluded, F.col("clause")))).alias("n_clauses"),
            F.max("negated").alias("is_excluded"),
            F.first("n_required").alias("n_required"),
            F.first("n_slots").alias("n_slots"),
            F.sort_array(F.collect_set(F.when(~excluded, F.struct("pos", "slot")))).alias("hits"),
        )
        .filter(
            (F.col("n_clauses") == F.col("n_required")) & (F.col("n_clauses") > 0) & ~F.col("is_excluded")
        )
    )
    return (
        groups.withColumn("cover", cover_density(F.col("hits"), F.col("n_slots")))
        .groupBy("query_id", "chunk_id")
        .agg(F.sum("cover").alias("score"))
    )


def cover_density(hits: Column, n_slots: Column) -> Column:
    """Sum of ``0.1 / (1 + noise)`` over the shortest spans that hold every slot.

    ``hits`` are ``(pos, slot)`` in text order. The latest position of each slot is
    carried along; their minimum starts the span that ends at the current hit,
    and a span counts when it starts later than the one before. Noise is the
    number of positions inside a span that are no hits.
    """
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("hit"))
    start = F.struct(
        F.array_repeat(nowhere, n_slots).alias("latest"),
        F.lit(0).alias("hit"),
        F.lit(-1).alias("span_start"),
        F.lit(0.0).alias("score"),
    )

    def step(acc, hit):
        here = F.struct(hit["pos"].alias("pos"), acc["hit"].alias("hit"))
        latest = F.transform(
            acc["latest"], lambda seen, slot: F.when(slot == hit["slot"], here).otherwise(seen)
        )
        return _let(latest, lambda now: _let(F.array_min(now), lambda first: advance(acc, hit, now, first)))

    def advance(acc, hit, latest, first):
        noise = (hit["pos"] - first["pos"]) - (acc["hit"] - first["hit"])
        weight = F.when(first["pos"] > acc["span_start"], F.lit(TERM_WEIGHT) / (1 + noise))
        return F.struct(
            latest.alias("latest"),
            (acc["hit"] + 1).alias("hit"),
            F.greatest(acc["span_start"], first["pos"]).alias("span_start"),
            (acc["score"] + F.coalesce(weight, F.lit(0.0))).alias("score"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["score"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside a lambda."""
    return F.transform(F.array(value), body)[0]


def let_through(rows: DataFrame, clauses: DataFrame, chunks: DataFrame, k: int, at_once: int = 1000) -> DataFrame:
    """``(query_id, chunk_id, score)``: for each group that only excludes, the ``k`` smallest
    chunk ids it lets through, with score 0.

    Each task goes through its chunks once and keeps ``k`` ids per group, so no list of all
    that pass is made or sorted. Groups are handled ``at_once`` per pass.
    """
    only = stored(clauses.filter("n_required = 0"), "only_excluding")
    groups = only.select("query_id", "grp").distinct()
    schema = only.select("query_id").schema.add(chunks.schema["chunk_id"])
    found = rows.sparkSession.createDataFrame([], schema)
    asked, part = groups.toLocalIterator(), []
    while part := [tuple(row) for row in islice(asked, at_once)]:
        number = {group: i for i, group in enumerate(part)}
        numbered = rows.sparkSession.createDataFrame(
            [(*group, i) for group, i in number.items()], groups.schema.add("number", "integer")
        )
        wanted = only.join(F.broadcast(numbered), ["query_id", "grp"])  # at most at_once groups
        gone = (
            complete(rows.join(F.broadcast(wanted), "term"))
            .groupBy("chunk_id")
            .agg(F.collect_set("number").alias("gone"))
        )
        passed = chunks.select("chunk_id").join(gone, "chunk_id", "left").mapInArrow(
            _smallest(len(part), k), chunks.select("chunk_id").schema.add("number", "integer")
        )
        found = found.unionByName(passed.join(F.broadcast(numbered), "number").select("query_id", "chunk_id"))
    return found.distinct().withColumn("score", F.lit(0.0))


def _smallest(n_groups: int, k: int):
    """The ``k`` smallest chunk ids of a task for each group, without those it excludes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(n_groups)]
        kind = None
        for batch in batches:
            kind = batch.schema.field("chunk_id").type
            ids = batch.column("chunk_id").to_pylist()
            gone = [set(found or ()) for found in batch.column("gone").to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            for number, kept in enumerate(best):
                fresh = list(islice((ids[i] for i in order if number not in gone[i]), k))
                kept[:] = sorted(kept + fresh)[:k]
        rows = [(chunk, number) for number, kept in enumerate(best) for chunk in kept]
        if rows:
            chunks, numbers = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, kind), pa.array(numbers, pa.int32())], ["chunk_id", "number"])

    return run


def keyword_topk(rows: DataFrame, clauses: DataFrame, k: int, chunks: DataFrame | None = None) -> DataFrame:
    """Best ``k`` matching chunks per question: ``(query_id, chunk_id, score, rank)``.

    With ``chunks`` (``chunk_id``), groups that only exclude words match all chunks
    without them, with score 0; a question's first ``k`` of these are by ``chunk_id``.
    """
    scored = match(rows, clauses)
    if chunks is not None:
        scored = scored.unionByName(let_through(rows, clauses, chunks, k))
        scored = scored.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    scored = scored.withColumn("score", F.round("score", DIGITS))
    return topk_per_question(scored, k, F.desc("score"), F.asc("chunk_id"))
