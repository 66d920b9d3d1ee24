"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.session import stored

BLOCK_CHARS = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that tells its rows apart, the same in every read.

    Rows read from files are known by file and place, so nothing is copied; any other
    DataFrame is stored once with numbers.
    """
    try:
        file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
        return df.withColumn(name, F.struct(file.alias("file"), row.alias("row")))
    except AnalysisException:
        file, row = F.lit(0).cast("long"), F.monotonically_increasing_id()
        return stored(df.withColumn(name, F.struct(file.alias("file"), row.alias("row"))), "numbered")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches in smaller parts, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def char_blocks(
    texts: Iterable[str | None], limit: int = BLOCK_CHARS, overlap: int = 0
) -> Iterator[list[tuple[int, int, str]]]:
    """Cut texts into pieces and the pieces into lists of about ``limit`` characters.

    Yields lists of (row, offset, piece). A text longer than ``limit`` becomes several
    pieces that share ``overlap`` characters, so memory is bounded for texts of any length.
    """
    block, size = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for offset in range(0, max(len(text) - overlap, 1), limit):
            piece = text[offset : offset + limit + overlap]
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((row, offset, piece))
            size += len(piece)
    if block:
        yield block


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of unsigned integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def running_totals(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each row, as ``name``, in the given order.

    The rows are dealt out by range. Each partition sums for itself, and only one total per
    partition meets in one place, so no task holds more than its own range.
    """
    sorted_rows = stored(
        df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sorted_rows.groupBy("_part")
        .agg(F.sum("_value").alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sorted_rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(F.broadcast(totals), "_part")  # one row per partition
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_value", "_part", "_within", "_before")
    )
