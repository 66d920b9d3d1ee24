"""Token ids of a corpus in files of coded blocks (operator 4).

Documents are dealt out by ranges of doc_id and sorted, so the files hold them in ascending
order. A task gathers whole documents up to about ``chunk_ids`` ids, codes them with
``context_coder`` (adaptive order-0 to order-2 predictions, blocks reset each for itself, their
stretches checksummed) and writes one row: its place, the documents' ids and lengths, and the
coded bytes. The rows are Parquet files in the shared folder, committed by Spark's writer, so a
lost executor costs only its unfinished tasks. Reading decodes the bytes and checks every block.

Defined results: a null or empty text has the end id alone; a null doc_id comes first;
rows that repeat an id stay together, in the order of a hash of their texts; an empty table
gives no rows. Texts of any length are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import context_coder
from sheaf.llm.tokenize import WordEncoder
from sheaf.session import scratch_path

END_ID = 2
FILE_SCHEMA = "part int, before long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


_encoders: dict[str, WordEncoder] = {}


def encoder_for(tokenizer: str) -> WordEncoder:
    """A worker keeps its encoder, and the words that it knows, from task to task."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]


def slices_of_bytes(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches in parts of about ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, chunk_ids: int = 4 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path``, in ascending doc_id order."""

    def row(before, ids: list[np.ndarray], doc_ids: list, lengths: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        values = [TaskContext.get().partitionId(), before, len(flat), doc_ids, np.concatenate(lengths)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        values.append(context_coder.encode(flat))
        arrays = [pa.array([value], kind) for value, kind in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "before", "n_ids", "doc_ids", "lengths", "payload"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(tokenizer)
        before, held, ids, doc_ids, lengths = 0, 0, [], [], []
        for batch in slices_of_bytes(batches):
            found, counts = encoder.encode(batch.column("text"), end_id)
            if held and held + len(found) > chunk_ids:
                yield row(before, ids, doc_ids, lengths)
                before, held, ids, doc_ids, lengths = before + held, 0, [], [], []
            ids.append(found)
            lengths.append(counts)
            doc_ids += batch.column("doc_id").to_pylist()
            held += len(found)
        if held:
            yield row(before, ids, doc_ids, lengths)

    # Equal ids come together; a hash of the text makes their order the same in each run.
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(coded, FILE_SCHEMA).write.parquet(path)


def read_blocks(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files under ``path``.

    ``with_ids`` adds the ids themselves.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids = context_coder.decode(payload.as_py()).astype("<u4")
                counts = np.array(lengths.values, np.int64)
                ends = np.cumsum(counts)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a file holds more or fewer ids than its documents")
                begins = ends - counts
                view = memoryview(ids.tobytes())
                spans = zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)
                crcs = [zlib.crc32(view[i:j]) for i, j in spans]
                arrays = [doc_ids.values, pa.array(begins + start.as_py()), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    bounds = pa.array(np.append(begins, ends[-1:]).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return (
        files.join(F.broadcast(offsets), "part")  # one row per written partition
        .select((F.col("offset") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
        .mapInArrow(decoded, schema)
    )


def encode_corpus(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files and return what reading them back gives for each document."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_blocks(docs, path, tokenizer)
    return read_blocks(docs.sparkSession, path)
