"""Vector top-k: exact over all rows, or over the cells nearest to each question.

Every task scores its rows against a block of questions with one matrix product
per Arrow batch and keeps the best k per question, so no question-row pair ever
becomes a Spark row and only k rows per question and task are shuffled. Question
blocks are bounded by BROADCAST_BYTES; a larger set is answered block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import stored
from sheaf.settings import BROADCAST_BYTES

DIGITS = 9  # distances are compared after rounding, so that equal vectors tie
_CELLS_PER_STEP = 4_000_000  # score matrix entries held at once
_MERGE_FANIN = 256  # tasks whose winners are merged together first


@dataclass(frozen=True)
class _Block:
    ids: list
    unit: np.ndarray  # one unit vector per question
    probes: np.ndarray | None = None  # cells to search per question


def vector_topk(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Exact nearest rows: ``(query_id, chunk_id, distance, rank)``.

    ``corpus`` has ``chunk_id`` and ``embedding``, ``questions`` has ``query_id``
    and ``embedding``. Vectors without direction are neither asked nor found.
    """
    rows = corpus.select("chunk_id", "embedding")
    return _search(rows, questions, _question_blocks(questions), k)


def vector_topk_cells(
    cells: DataFrame, centroids: np.ndarray, questions: DataFrame, k: int, n_probe: int
) -> DataFrame:
    """Nearest rows among the ``n_probe`` cells closest to each question.

    ``cells`` is a corpus with a ``cell`` column (see ``assign_cells``). Stored
    partitioned by cell, the filter below prunes whole directories. A hot cell is
    read in as many splits as its size asks for.
    """
    unit_centroids = _unit(np.asarray(centroids, dtype=np.float64))[0]
    n_probe = min(n_probe, len(unit_centroids))

    def probing() -> Iterator[_Block]:
        for block in _question_blocks(questions):
            order = np.argsort(-(block.unit @ unit_centroids.T), axis=1, kind="stable")
            yield _Block(block.ids, block.unit, order[:, :n_probe])

    rows = cells.select("chunk_id", "embedding", "cell")
    return _search(rows, questions, probing(), k)


def train_cells(corpus: DataFrame, n_cells: int, max_iter: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of ``n_cells`` cells, trained on all rows; their unit vectors are stored once."""
    rows = corpus.select("embedding").filter(_length("embedding") > 0)
    scale = _length("embedding")
    unit = F.transform("embedding", lambda x: x.cast("double") / scale)
    features = stored(rows.select(array_to_vector(unit).alias("features")), "units")
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(features).clusterCenters())


def assign_cells(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the number of the closest centroid as ``cell``, in one pass.

    Centroids are scored in blocks of at most BROADCAST_BYTES, each of which hands on
    the best score so far, so there may be any number of them.
    """
    unit_centroids = _unit(np.asarray(centroids, dtype=np.float64))[0]
    per_block = max(1, BROADCAST_BYTES // (8 * unit_centroids.shape[1]))
    best = F.struct(F.lit(-np.inf).alias("score"), F.lit(-1).alias("cell"))
    for first in range(0, len(unit_centroids), per_block):
        block = corpus.sparkSession.sparkContext.broadcast(unit_centroids[first : first + per_block])
        best = _nearest(block, first)("embedding", best)
    return corpus.withColumn("cell", best["cell"])


def _nearest(shared, first: int):
    """The better of the best cell so far and the nearest of a block of centroids."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, best in batches:
            scores, cells = (np.asarray(best.field(name)) for name in ("score", "cell"))
            if len(vectors):
                unit, _ = _unit(_matrix(vectors, shared.value.shape[1]))
                product = unit @ shared.value.T
                nearest = product.argmax(axis=1)
                score = product[np.arange(len(product)), nearest]
                cells = np.where(score > scores, nearest + first, cells)
                scores = np.maximum(scores, score)
            arrays = [pa.array(scores, pa.float64()), pa.array(cells, pa.int32())]
            yield pa.StructArray.from_arrays(arrays, ["score", "cell"])

    kind = Iterator[tuple[pa.Array, pa.Array]]
    run.__annotations__ = {"batches": kind, "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "score double, cell int")


def write_cells(cells: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Store a corpus partitioned by cell, each cell spread over files by its own size."""
    write_by_size(stored(cells, "cells"), "cell", F.xxhash64("chunk_id"), path, rows_per_file)


def write_by_size(rows: DataFrame, key: str, row_hash: Column, path: str, rows_per_file: int, *order: str) -> None:
    """Write ``rows``, a stored table, partitioned by ``key``, each key's rows over files by its size."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).alias("files"))
    spread = (
        rows.join(F.broadcast(sizes), key)  # one row per folder
        .withColumn("file", F.pmod(row_hash, F.col("files")))
        .drop("files")
        .repartition(key, "file")
    )
    if order:
        spread = spread.sortWithinPartitions(key, *order)
    spread.drop("file").write.partitionBy(key).parquet(path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact rows that were found, per question."""
    hits = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return (
        exact.join(hits, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )


def topk_per_question(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Best ``k`` rows of each ``query_id`` with their 1-based ``rank``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(rows, questions, blocks: Iterator[_Block], k):
    """One scan per block; the driver holds one block at a time and hands it on."""
    schema = T.StructType(
        [
            T.StructField("query_id", questions.schema["query_id"].dataType),
            T.StructField("chunk_id", rows.schema["chunk_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    context = rows.sparkSession.sparkContext
    found = rows.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(blocks):
        source = rows
        if block.probes is not None:
            source = rows.filter(F.col("cell").isin([int(c) for c in np.unique(block.probes)]))
        scan = _scan(context.broadcast(block), k, schema)
        part = source.mapInArrow(scan, schema)
        found = found.unionByName(part) if i else part
    order = (F.asc("distance"), F.asc("chunk_id"))
    fan_in = (F.spark_partition_id() / _MERGE_FANIN).cast("int")
    first = Window.partitionBy("query_id", "fan_in").orderBy(*order)
    merged = (
        found.withColumn("fan_in", fan_in)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .drop("fan_in", "rank")
    )
    return topk_per_question(merged, k, *order)


def _question_blocks(questions: DataFrame) -> Iterator[_Block]:
    """The questions in blocks of at most BROADCAST_BYTES, usually one."""
    rows = stored(
        questions.select("query_id", "embedding").filter(_length("embedding") > 0), "questions"
    )
    first = rows.select(F.size("embedding").alias("dim")).first()
    if first is None:
        return
    dim = first["dim"]
    fits = max(1, BROADCAST_BYTES // (8 * dim))
    head = rows.limit(fits + 1).toArrow()
    if head.num_rows <= fits:
        yield _block(head, dim)
        return
    n_blocks = 2 * (rows.count() // fits + 1)
    number = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    for i in range(n_blocks):
        part = rows.filter(number == i).toArrow()
        if part.num_rows:
            yield _block(part, dim)


def _block(table: pa.Table, dim: int) -> _Block:
    column = table.column("embedding").combine_chunks()
    return _Block(table.column("query_id").to_pylist(), _unit(_matrix(column, dim))[0])


def _length(vector) -> Column:
    total = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(total)


def _matrix(vectors, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (widths != dim).any():
        raise ValueError(f"vector width mismatch: expected {dim}, got {set(widths.tolist())}")
    return flat.reshape(-1, dim)


def _unit(matrix: np.ndarray):
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None], lengths > 0


def _scan(shared, k: int, schema: T.StructType):
    """The Arrow function that keeps the best ``k`` rows per question of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = _Best(len(block.ids), k)
        step = max(1, _CELLS_PER_STEP // len(block.ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                _score(block, batch.slice(at, step), best)
        table = best.finish()
        if table is None:
            return
        asked = pa.array(block.ids, to_arrow(schema["query_id"].dataType))
        yield pa.RecordBatch.from_arrays(
            [
                asked.take(table.column("q").combine_chunks()),
                table.column("chunk_id").combine_chunks(),
                table.column("distance").combine_chunks(),
            ],
            names=["query_id", "chunk_id", "distance"],
        )

    def to_arrow(kind):
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(kind)

    return run


def _score(block: _Block, batch: pa.RecordBatch, best: _Best) -> None:
    unit, directed = _unit(_matrix(batch.column("embedding"), block.unit.shape[1]))
    ids = batch.column("chunk_id")
    if block.probes is None:
        best.offer(np.arange(len(block.ids)), np.flatnonzero(directed), block.unit, unit, ids)
        return
    cells = batch.column("cell").to_numpy(zero_copy_only=False)
    for cell in np.unique(cells):
        asking = np.flatnonzero((block.probes == cell).any(axis=1))
        inside = np.flatnonzero((cells == cell) & directed)
        if len(asking) and len(inside):
            best.offer(asking, inside, block.unit, unit, ids)


class _Best:
    """Best k candidates per question seen so far, with a bound that only tightens."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.bound = np.full(n_questions, np.inf)
        self.kept: list[pa.Table] = []
        self.pending = 0
        self.limit = max(n_questions * k, 65_536)

    def offer(self, asking, inside, questions, rows, ids) -> None:
        self.keep(asking, inside, 1.0 - questions[asking] @ rows[inside].T, ids)

    def keep(self, asking, inside, distance, ids) -> None:
        """Consider the ``distance`` of each asking question to each row ``inside`` the ids."""
        cut = self.bound[asking]
        if len(inside) > self.k:
            nearest = np.partition(distance, self.k - 1, axis=1)[:, self.k - 1]
            cut = np.minimum(cut, nearest)
        q, r = np.nonzero(distance <= cut[:, None] + 10.0**-DIGITS)
        if not len(q):
            return
        self.kept.append(
            pa.table(
                {
                    "q": asking[q],
                    "chunk_id": ids.take(pa.array(inside[r])),
                    "distance": np.round(distance[q, r], DIGITS) + 0.0,
                }
            )
        )
        self.pending += len(q)
        if self.pending > self.limit:
            self.merge()

    def merge(self) -> None:
        table = pa.concat_tables(self.kept).sort_by(
            [("q", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")]
        )
        q = table.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        table = table.filter(pa.array(place < self.k))
        q, distance = table.column("q").to_numpy(), table.column("distance").to_numpy()
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, side="left") == self.k - 1)
        self.bound[q[last]] = distance[last]
        self.kept, self.pending = [table], 0

    def finish(self) -> pa.Table | None:
        if not self.kept:
            return None
        self.merge()
        return self.kept[0]
