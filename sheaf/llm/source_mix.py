"""Mixing sources to target weights by capped water-filling (operator 10).

Every source has a weight; together the sources share ``budget_share`` of all words. A
target above ``max_epochs`` times its source's size is clamped there, and the excess is
shared by weight among the others, again and again until none is above. Each step is one
aggregation over the table of sources; the driver sees a few numbers, whatever the number of
sources or documents.

A source then takes every document whole as often as fits its target. The fraction left is
sampled: documents are ordered by a seeded hash, and those are repeated once more that come
before the fraction's share of the source's words is used up, so a source misses its target by
less than one document. For this, words are summed by slices of the hash's range; only the
slice in which the share ends is ordered row by row, so no source meets in one task.

Defined results: a null text has size 0 and is taken 0 words; a source without words has
target 0. A null source is one source, the last. Equal hashes are ordered by doc_id. Rows
that repeat an id are repeated alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import free_name, running_totals, with_row_key
from sheaf.session import stored

WEIGHTS = (5, 2, 1)
ROWS_PER_SLICE = 65_536


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Targets for ``sources`` (source_size, weight, ...): ``budget`` shared by weight, each
    at most ``max_epochs`` times its size."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        clamped, free = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        higher = max(level, (budget - clamped) / free) if free else level
        if higher == level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = higher


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """source, source_size, target for rows of (source, size); weights repeat in source order."""
    by_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").asc_nulls_last()]
    placed = running_totals(by_source, order, F.lit(1), "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stored(placed.withColumn("weight", weight), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    return fill(placed, budget_share * total, max_epochs).select("source", "source_size", "target")


def repeats(
    docs: DataFrame, seed: int = 42, slices: int | None = None, row: str | None = None, **mixture
) -> tuple[DataFrame, DataFrame]:
    """The rows of (doc_id, source, size, ``row``) with source_size, target and times, and the sources.

    ``docs`` must be a stored table; it is read several times. ``row`` names a column that
    orders rows which share their id. ``slices``, a power of two, grows with the rows, so that the
    slice which is ordered row by row does not.
    """
    slices = slices or max(4096, 1 << (docs.count() // ROWS_PER_SLICE).bit_length())
    plan = stored(targets(docs, **mixture), "targets")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    ties = ["doc_id", *([row] if row else [])]
    mixed = (
        docs.withColumn("key", key)
        .withColumn("drawn", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")))
        .withColumn("slice", F.shiftrightunsigned("drawn", 64 - slices.bit_length() + 1).cast("int"))
    )
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0).cast("long"))
    sources = plan.select(
        key.alias("key"),
        "source_size",
        "target",
        F.coalesce(F.floor(rate), F.lit(0)).alias("whole"),
        F.coalesce(F.col("target") - F.floor(rate) * F.col("source_size"), F.lit(0.0)).alias("rest"),
    )
    by_slice = mixed.groupBy("key", "slice").agg(F.sum("size").alias("in_slice"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``slices`` rows for each source.
    ends = (
        by_slice.withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
        .join(sources.select("key", "rest"), "key")
        .filter("before < rest AND before + in_slice >= rest")
        .select("key", F.col("slice").alias("end"), (F.col("rest") - F.col("before")).alias("left"))
    )
    per_source = stored(sources.join(ends, "key", "left"), "shares")
    # Sources with more than a thousandth of the words are few; the rest is split by the join.
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    large = F.broadcast(per_source.filter(F.col("source_size") * 1000 > total))
    joined = mixed.join(large, "key").unionByName(
        mixed.join(large.select("key"), "key", "left_anti").join(
            per_source.filter(F.col("source_size") * 1000 <= total), "key"
        )
    )
    joined = joined.withColumn("at_end", F.coalesce(F.col("slice") == F.col("end"), F.lit(False)))
    used = Window.partitionBy("key").orderBy("drawn", *ties).rowsBetween(Window.unboundedPreceding, -1)
    more = F.coalesce(F.sum("size").over(used), F.lit(0))
    # The document in which the share ends is taken if more than half of it is within.
    last = joined.filter("at_end").withColumn("extra", (more + F.col("size") / 2 <= F.col("left")).cast("long"))
    others = joined.filter("NOT at_end").withColumn("extra", F.coalesce(F.col("slice") < F.col("end"), F.lit(False)).cast("long"))
    out = last.unionByName(others).withColumn("times", F.col("whole") + F.col("extra"))
    return out.select(*docs.columns, "source_size", "target", "times"), plan


def mix(docs: DataFrame, **mixture) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    rows, _ = repeats(sizes, **mixture)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **mixture) -> DataFrame:
    """``docs`` (all columns), each row as often as the mixture takes it, perhaps never.

    Rows are known by a key, so that those which share an id stay apart.
    """
    row, times, copy = (free_name(docs, name) for name in ("_row", "_times", "_copy"))
    rows = with_row_key(docs, row)
    size = words(F.col("text")).alias("size")
    narrow = stored(rows.select("doc_id", "source", size, F.col(row).alias("row")), "sizes")
    taken, _ = repeats(narrow, row="row", **mixture)
    taken = taken.filter("times > 0").select(F.col("row").alias(row), F.col("times").alias(times))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    return rows.join(taken, row).select(*docs.columns, copies.alias(copy)).drop(copy)
