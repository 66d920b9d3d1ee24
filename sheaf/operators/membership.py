"""Semi and anti joins of very many rows with keys that are too many to broadcast one by one.

The keys are broadcast as a Bloom filter of BITS bits each, in blocks: a key sets PROBES bits in the one
block that it falls in. So of the rows that have none of the keys about one in 300 is left, and only what
is left is shuffled for the exact join. The filter has at most BROADCAST_BYTES; beyond 32 million keys it
lets more rows through. An anti join shuffles only the different keys that the filter holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import broadcast_if_small, stored
from sheaf.settings import BROADCAST_BYTES

BITS, PROBES = 16, 4
_WORDS = 64  # longs in a block, at most 64: a probe is 12 bits of one hash


def block_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``(block, words)`` of the filter for the ``n`` longs that are the only column of ``keys``, and its number of blocks."""
    blocks = max(1, min(-(-n * BITS // (64 * _WORDS)), BROADCAST_BYTES // (8 * _WORDS)))
    key = F.col(keys.columns[0])
    probes = F.explode(F.array(*[_probe(key, i) for i in range(PROBES)])).alias("probe")
    words = (
        keys.select(_block(key, blocks).alias("block"), probes)
        .repartition("block")
        .groupBy("block", F.expr("probe div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(probe % 64 as int)))").alias("bits"))
    )
    found = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    table = words.groupBy("block").agg(found.alias("found")).select(
        "block",
        F.transform(
            F.sequence(F.lit(0), F.lit(_WORDS - 1)),
            lambda i: F.coalesce(F.try_element_at("found", i.cast("long")), F.lit(0).cast("long")),
        ).alias("words"),
    )
    return table, blocks


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose long ``key`` is none of ``keys``; those that have one all stay."""
    table, blocks = block_filter(keys.select(key), keys.count())
    of_row = F.col(f"r.{key}")
    held = (F.col("t.block") == _block(of_row, blocks)) & _held(of_row)
    return rows.alias("r").join(F.broadcast(table).alias("t"), held, "left_semi")  # at most BROADCAST_BYTES


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose ``on`` is in ``gone``, a stored table; none of ``rows`` is shuffled.

    The filter holds all of ``gone`` and a few others. Which of its keys are others is found once, from
    the different keys of ``rows``, and rows with these stay.
    """
    key = F.xxhash64(*on)
    table, blocks = block_filter(gone.select(key.alias("key")), gone.count())
    table = F.broadcast(table)  # at most BROADCAST_BYTES
    keyed = rows.withColumn("held_key", key)
    some = keyed.select(*on, "held_key").alias("r")
    of_row = F.col("r.held_key")
    here = (F.col("t.block") == _block(of_row, blocks)) & _held(of_row)
    some = some.join(table.alias("t"), here, "left_semi").select(*on).distinct()
    others = stored(some.join(gone, on, "left_anti"), "not_gone")
    others = broadcast_if_small(others).withColumn("stays", F.lit(True)).alias("o")
    marked = keyed.alias("r").join(table.alias("t"), here, "left")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    marked = marked.join(others, same, "left").filter(F.col("t.block").isNull() | F.col("o.stays"))
    return marked.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


def _held(of_row: Column) -> Column:
    """All bits of a key are set in the ``words`` of its block."""
    bits = []
    for i in range(PROBES):
        probe = _probe(of_row, i)
        bits.append(F.getbit(F.get("t.words", F.shiftright(probe, 6).cast("int")), probe.bitwiseAND(63).cast("int")) == 1)
    return reduce(Column.__and__, bits)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _probe(key: Column, i: int) -> Column:
    """The place of a bit in its block: 12 bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("probe")), 12 * i).bitwiseAND(64 * _WORDS - 1)
