"""Vector top-k over residual product codes: a narrow scan of near cells, then an exact rerank.

A vector belongs to the cell of its nearest centroid, and what is left of it is cut into
sub-vectors, each replaced by the number of the nearest entry of a code book. So a row takes
one byte per sub-vector in the scan, whatever the width of the vectors. A question is compared
through tables of its inner products with all entries (the question itself is not coded). The
``depth`` best by codes are looked up in full, and their true distances decide.

Questions find their cells on the executors and meet the rows by an equi join on the cell. Large
cells are parted, and so are the questions of a cell that very many ask, so no group is beyond
``GROUP_ROWS`` rows or ``GROUP_QUESTIONS`` questions. The driver holds centroids and code books only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.vectors import cosine_distance
from sheaf.operators import vectors
from sheaf.session import broadcast_if_small, stored

GROUP_ROWS = 200_000
GROUP_QUESTIONS = 2048
_ENTRIES_PER_STEP = 4_000_000  # distances held at once


@dataclass(frozen=True)
class Codec:
    """Unit centroids (cells x width) and code books (parts x codes x sub-width)."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first."""
        near = -(unit @ self.centroids.T)
        n = min(n, near.shape[1])
        some = np.sort(np.argpartition(near, n - 1, axis=1)[:, :n], axis=1)
        return np.take_along_axis(some, np.take_along_axis(near, some, 1).argsort(axis=1, kind="stable"), 1)

    def parts(self, residual: np.ndarray) -> np.ndarray:
        return residual.reshape(len(residual), self.books.shape[0], self.books.shape[2])

    def coded(self, residual: np.ndarray) -> np.ndarray:
        """The number of the nearest entry for each sub-vector."""
        parts = self.parts(residual)
        out = np.empty(parts.shape[:2], np.uint8)
        step = max(1, _ENTRIES_PER_STEP // (self.books.shape[1] * self.books.shape[2]))
        for part, book in enumerate(self.books):
            for at in range(0, len(parts), step):
                gap = parts[at : at + step, part, None, :] - book
                out[at : at + step, part] = (gap * gap).sum(axis=2).argmin(axis=1)
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner products of each question's sub-vectors with all entries."""
        return np.einsum("qpd,pcd->qpc", self.parts(unit), self.books)


def train_codec(corpus: DataFrame, n_cells: int, parts: int, codes: int = 256, rounds: int = 8) -> Codec:
    """Cells by k-means over all rows, and the books of all sub-spaces by one k-means pass per round."""
    if not 1 <= codes <= 256:
        raise ValueError(f"{codes} codes do not fit a byte")
    centroids = vectors._unit(vectors.train_cells(corpus, n_cells))[0]
    return Codec(centroids, train_books(residuals(corpus, centroids), parts, codes, rounds))


def residuals(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """What is left of each unit vector without its cell's centroid, stored as ``residual``."""
    cells = vectors.assign_cells(corpus.select("embedding").filter(vectors._length("embedding") > 0), centroids)
    shared = cells.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = vectors._unit(vectors._matrix(batch.column("embedding"), shared.value.shape[1]))
            left = unit - shared.value[np.asarray(batch.column("cell"))]
            yield pa.RecordBatch.from_arrays([lists(left)], ["residual"])

    return stored(cells.mapInArrow(run, "residual array<double>"), "residuals")


def lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), pa.float64()))


def train_books(rows: DataFrame, parts: int, codes: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds for every sub-space at once; a task returns sums and counts per entry."""
    first = rows.select("residual").distinct().orderBy(F.xxhash64("residual")).limit(codes).collect()  # one row per code
    if not first:
        raise ValueError("there is no vector to train code books on")
    start = np.array([row["residual"] for row in first])
    if start.shape[1] % parts:
        raise ValueError(f"width {start.shape[1]} cannot be cut into {parts} parts")
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        codec = rows.sparkSession.sparkContext.broadcast(Codec(np.zeros((1, start.shape[1])), books))

        def summed(batches: Iterator[pa.RecordBatch], codec=codec) -> Iterator[pa.RecordBatch]:
            books = codec.value.books
            sums, counts = np.zeros(books.shape), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                residual = vectors._matrix(batch.column("residual"), codec.value.width)
                found = codec.value.coded(residual)
                for part, sub in enumerate(codec.value.parts(residual).transpose(1, 0, 2)):
                    np.add.at(sums[part], found[:, part], sub)
                    counts[part] += np.bincount(found[:, part], minlength=books.shape[1])
            part, code = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(counts[part, code]), lists(sums[part, code])],
                ["part", "code", "n", "total"],
            )

        found = rows.mapInArrow(summed, "part int, code int, n long, total array<double>")
        total = vector_to_array(Summarizer.sum(array_to_vector("total")))
        books = books.copy()
        for row in found.groupBy("part", "code").agg(F.sum("n").alias("n"), total.alias("total")).collect():
            books[row["part"], row["code"]] = np.array(row["total"]) / row["n"]
    return books


def encode(corpus: DataFrame, codec: Codec) -> DataFrame:
    """``corpus`` (chunk_id, embedding) with ``cell`` and ``codes``, one byte per sub-vector.

    Vectors without direction get no codes and are never found.
    """
    cells = vectors.assign_cells(corpus, codec.centroids)
    shared = cells.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for embedding, cell in batches:
            unit, directed = vectors._unit(vectors._matrix(embedding, shared.value.width))
            found = shared.value.coded(unit - shared.value.centroids[np.asarray(cell)])
            yield pa.array([row.tobytes() if ok else None for row, ok in zip(found, directed, strict=True)], pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return cells.withColumn("codes", F.arrow_udf(run, "binary")("embedding", "cell"))


def probing(questions: DataFrame, codec: Codec, n_probe: int) -> DataFrame:
    """``(query_id, embedding, cell, place)``: the cells that each question searches, nearest first."""
    asked = questions.select("query_id", "embedding").filter(vectors._length("embedding") > 0)
    schema = T.StructType([asked.schema["query_id"]])
    schema = schema.add("embedding", T.ArrayType(T.DoubleType())).add("cell", "integer").add("place", "integer")
    shared = questions.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = vectors._unit(vectors._matrix(batch.column("embedding"), shared.value.width))
            for at in range(0, len(unit), 4096):
                some = unit[at : at + 4096]
                cells = shared.value.probes(some, n_probe)
                owner = np.repeat(np.arange(len(some)), cells.shape[1])
                place = np.tile(np.arange(cells.shape[1], dtype=np.int32), len(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_id").take(pa.array(owner + at)),
                        lists(some[owner]),
                        pa.array(cells.ravel().astype(np.int32)),
                        pa.array(place),
                    ],
                    schema.names,
                )

    return asked.mapInArrow(run, schema)


def candidates(index: DataFrame, codec: Codec, questions: DataFrame, n_probe: int, depth: int) -> DataFrame:
    """``(query_id, chunk_id, cell, distance, rank)``: the ``depth`` best rows of a question by codes."""
    asked = stored(probing(questions, codec, n_probe).drop("place"), "probes")
    cells = asked.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_QUESTIONS).alias("blocks"))
    cells = stored(cells.filter("cell >= 0"), "probed")  # true of all; Spark prunes folders only by a filtered side
    rows = index.select("cell", "chunk_id", "codes").filter("codes IS NOT NULL")
    sizes = rows.join(F.broadcast(cells), "cell").groupBy("cell", "blocks").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    sizes = F.broadcast(stored(sizes, "sizes").filter("parts > 0"))  # one row per cell; the driver holds the centroids
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts")).withColumn("block", every)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    posed = asked.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", every)
    keys = ["cell", "part", "block"]
    id_type, chunk_type = asked.schema["query_id"], rows.schema["chunk_id"]
    schema = T.StructType([id_type, chunk_type]).add("cell", "integer").add("distance", "double")
    shared = index.sparkSession.sparkContext.broadcast(codec)

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        codec, cell = shared.value, r.column("cell")[0].as_py() if r.num_rows else 0
        unit = vectors._matrix(q.column("embedding"), codec.width)
        tables, to_cell = codec.tables(unit), unit @ codec.centroids[cell]
        codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint8).reshape(-1, codec.books.shape[0])
        ids, best = r.column("chunk_id").combine_chunks(), vectors._Best(len(unit), depth)
        step = max(1, _ENTRIES_PER_STEP // max(len(unit), 1))
        for at in range(0, len(codes) if len(unit) else 0, step):
            some = codes[at : at + step]
            inner = np.repeat(to_cell[:, None], len(some), axis=1)
            for part in range(some.shape[1]):
                inner += tables[:, part, :][:, some[:, part]]
            best.keep(np.arange(len(unit)), np.arange(len(some)), 1.0 - inner, ids.slice(at, len(some)))
        found = best.finish()
        if found is None:
            return pa.table({name: pa.array([], kind) for name, kind in zip(
                schema.names, (q.schema.field("query_id").type, ids.type, pa.int32(), pa.float64()), strict=True)})
        return pa.table(
            {
                "query_id": q.column("query_id").combine_chunks().take(found.column("q").combine_chunks()),
                "chunk_id": found.column("chunk_id"),
                "cell": pa.array(np.full(found.num_rows, cell, np.int32)),
                "distance": found.column("distance"),
            }
        )

    found = (
        posed.select("query_id", "embedding", *keys)
        .groupBy(*keys)
        .cogroup(dealt.select("chunk_id", "codes", *keys).groupBy(*keys))
        .applyInArrow(run, schema)
    )
    return vectors.topk_per_question(found, depth, F.asc("distance"), F.asc("chunk_id"))


def topk_quantized(
    index: DataFrame, codec: Codec, questions: DataFrame, k: int, n_probe: int, depth: int | None = None
) -> DataFrame:
    """Nearest rows of ``index`` (see ``encode``; best stored by cell): ``(query_id, chunk_id, distance, rank)``.

    Distances are exact; only rows among the ``depth`` best by codes (10 k by default) in the
    ``n_probe`` nearest cells can be found.
    """
    near = stored(candidates(index, codec, questions, n_probe, depth or 10 * k).select("query_id", "chunk_id", "cell"), "near")
    cells = near.select("cell").distinct().filter("cell >= 0")
    rows = index.select("cell", "chunk_id", "embedding").join(F.broadcast(cells), "cell", "left_semi")  # one row per cell
    full = rows.join(broadcast_if_small(near), ["cell", "chunk_id"])
    asked = questions.select("query_id", F.col("embedding").alias("asked"))
    distance = F.round(cosine_distance(F.col("embedding"), F.col("asked")), vectors.DIGITS)
    found = full.join(asked, "query_id").select("query_id", "chunk_id", distance.alias("distance"))
    return vectors.topk_per_question(found, k, F.asc("distance"), F.asc("chunk_id"))


def calibrate(
    index: DataFrame, codec: Codec, k: int, target: float, sample: int = 200, most_depth: int = 50
) -> tuple[int, int]:
    """``(n_probe, depth)``: the least that reach a recall of ``target`` on a sample of the rows as questions.

    The exact neighbours of the sample are found once. The place of a neighbour's cell among
    its question's cells tells the probes it needs, and its rank by codes the depth, so
    nothing is searched twice. The sample is bounded, the rows it is measured against are all.
    """
    share = min(1.0, sample / max(index.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("calibrate"), "chunk_id"), F.lit(1 << 30)) < int((1 << 30) * share)
    asked = index.filter(drawn).select(F.col("chunk_id").alias("query_id"), "embedding").limit(2 * sample)
    asked = stored(asked, "sample")
    exact = stored(vectors.vector_topk(index, asked, k).select("query_id", "chunk_id"), "exact")
    total = exact.count()
    if not total:
        return 1, k
    # Split what may be lost evenly between cells and codes.
    allowed = (1 - target) / 2
    cells = probing(asked, codec, len(codec.centroids)).select("query_id", "cell", F.col("place") + 1)
    owned = exact.join(index.select("chunk_id", "cell"), "chunk_id")
    needed = owned.join(cells.toDF("query_id", "cell", "need"), ["query_id", "cell"])
    n_probe = reach(needed, total, 1 - allowed)
    ranked = candidates(index, codec, asked, n_probe, most_depth * k).select("query_id", "chunk_id", F.col("rank").alias("need"))
    depth = reach(exact.join(ranked, ["query_id", "chunk_id"]), total, target)
    return n_probe, max(depth, k)


def reach(needed: DataFrame, total: int, share: float) -> int:
    """The least ``need`` that covers ``share`` of ``total`` rows, or the largest there is."""
    per = needed.groupBy("need").agg(F.count("*").alias("n"))
    running = per.withColumn("sum", F.sum("n").over(Window.orderBy("need")))  # one row per cell or rank
    enough = running.filter(F.col("sum") >= share * total - 1e-9).agg(F.min("need")).first()[0]
    return enough or running.agg(F.max("need")).first()[0] or 1
