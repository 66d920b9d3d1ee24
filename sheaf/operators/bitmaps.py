"""Boolean keyword search by bitmaps of chunk numbers, for terms that very many chunks hold.

Chunks are numbered without gaps. A term's bitmap is a row per PAGE chunk numbers in which it
occurs: 4 KB stand for up to 32,768 postings, whatever the chunks are called. Bitmaps of frequent
terms are kept with the postings; those of the other terms a question asks for are built from
their short lists. Wanted terms of a group are joined by AND, its excluded words by AND NOT, and
pages of different questions and groups are worked on apart, so no task holds more than the
pages of one group and range. Only chunks that survive are looked up in the postings, for phrases
and scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import keywords
from sheaf.session import broadcast_if_small, stored

PAGE = 32_768  # chunk numbers of a bitmap row, as Spark's bitmap functions have it
FREQUENT = 0.1  # share of the chunks from which on a term's bitmap is kept


def number_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with a ``number`` from 0 on, without gaps; one count per task is combined."""
    placed = stored(
        chunks.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "placed"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift")
    numbered = placed.join(F.broadcast(parts.select("part", shift)), "part")  # one row per task that wrote
    return numbered.withColumn("number", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def bitmaps(rows: DataFrame) -> DataFrame:
    """``(term, page, bits)`` of postings with their chunk's ``number``."""
    page = F.floor(F.col("number") / PAGE).alias("page")
    position = F.pmod("number", F.lit(PAGE))
    return rows.groupBy("term", page).agg(F.bitmap_construct_agg(position).alias("bits"))


def write_index(rows: DataFrame, n_chunks: int, path: str, frequent: float = FREQUENT) -> None:
    """Store postings (with ``number``) as they come, and the bitmaps of terms in ``frequent`` of the chunks or more.

    A term with fewer postings than that is in fewer chunks, so bitmaps are made of the others only.
    """
    rows.write.parquet(f"{path}/postings")  # each task its own, neither shuffled nor sorted
    kept = rows.sparkSession.read.parquet(f"{path}/postings")
    often = kept.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= frequent * n_chunks)
    often = broadcast_if_small(stored(often.select("term"), "often"))
    pages = bitmaps(kept.select("term", "number").join(often, "term", "left_semi"))
    pages = stored(pages.withColumn("n", F.bitmap_count("bits")), "pages")
    held = pages.groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= frequent * n_chunks)
    held = broadcast_if_small(held.select("term"))  # at most the terms of a chunk / frequent
    pages.join(held, "term", "left_semi").drop("n").write.parquet(f"{path}/bitmaps")


def asked_bitmaps(rows: DataFrame, kept: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(term, page, bits)`` of the clauses' terms: kept ones, and others built from their postings."""
    terms = stored(clauses.select("term").distinct(), "asked")
    have = stored(kept.join(broadcast_if_small(terms), "term", "left_semi"), "kept")
    rest = terms.join(have.select("term").distinct(), "term", "left_anti")
    return have.unionByName(bitmaps(rows.join(broadcast_if_small(stored(rest, "rest")), "term", "left_semi")))


def survivors(rows: DataFrame, kept: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(query_id, grp, number)``: chunks with every wanted term of a group and none of its excluded words.

    An excluded phrase excludes nothing here, as its terms may stand apart.
    """
    clauses = clauses.filter("n_required > 0")
    roles = clauses.filter("NOT negated OR n_terms = 1")
    roles = stored(roles.select("query_id", "grp", "n_slots", "negated", "term").distinct(), "roles")
    bits = asked_bitmaps(rows, kept, roles).join(broadcast_if_small(roles), "term")
    group = ["query_id", "grp", "page"]
    wanted = (
        bits.filter("NOT negated")
        .groupBy(*group, "n_slots")
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        .filter("n = n_slots")
    )
    gone = bits.filter("negated").groupBy(*group).agg(F.bitmap_or_agg("bits").alias("gone"))
    return wanted.join(gone, group, "left").select(*group, "bits", "gone").mapInArrow(
        _numbers, wanted.select("query_id", "grp").schema.add("number", "long")
    )


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk numbers of ``bits`` AND NOT ``gone``."""
    for batch in batches:
        for i, (page, bits, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "bits", "gone")))):
            left = np.frombuffer(bits, np.uint8)
            if gone is not None:
                left = left & ~np.frombuffer(gone, np.uint8)
            found = np.flatnonzero(np.unpackbits(left, bitorder="little")) + page * PAGE
            owner = pa.array(np.full(len(found), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(owner), batch.column("grp").take(owner), pa.array(found)],
                ["query_id", "grp", "number"],
            )


def match(rows: DataFrame, kept: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)`` as ``keywords.match`` has it; positions are read for survivors only.

    ``rows`` are stored postings with ``number``, ``kept`` the bitmaps beside them.
    """
    clauses = stored(clauses, "clauses")
    found = stored(survivors(rows, kept, clauses).select("query_id", "number").distinct(), "survivors")
    some = stored(read_positions(rows, clauses, found), "positions")
    scored = keywords.match(some.select("term", "chunk_id", "pos"), clauses)
    # Questions share postings: a chunk counts for those it survived for.
    chunks = some.select("chunk_id", "number").distinct()
    return scored.join(chunks, "chunk_id").join(found, ["query_id", "number"], "left_semi").drop("number")


def read_positions(rows: DataFrame, clauses: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the questions' terms in chunks that survived for one of the questions that ask for them."""
    keys = found.join(clauses.select("query_id", "term").distinct(), "query_id").select("term", "number").distinct()
    return rows.join(broadcast_if_small(stored(keys, "keys")), ["term", "number"], "left_semi")
