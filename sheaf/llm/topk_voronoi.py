"""Exact top-k by inner product as a Voronoi kNN join (operator 8).

Vectors become integers, floor(256 x). With M the largest norm, x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0), the distance |q' - x'| falls exactly as the inner product rises, so the
metric bounds of a kNN join hold. Data and queries go to the cells of their nearest pivots.
Summaries of the cells (the distances of the k + 1 objects nearest to each pivot) bound the
k-th distance of every query; the largest bound in a query cell, its radius and the distances
between pivots tell how far from each pivot a useful object can be. Query cells that lie
together form groups, and an object is copied only to groups for which it may be useful; the
groups then solve their parts alone. A group with many objects is dealt over several tasks,
each with all queries of the group, and the winners of the parts are merged.

Pivots are a bounded sample (at most ``pivots`` vectors); every vector is assigned, bounded
and searched. Scores are exact integers, so the result does not depend on the pivots.

Defined results: null vectors and those with null, NaN or infinite components take no part;
shorter vectors count as padded with zeros; an empty vector has score 0 with all. A query
with fewer than k candidates returns all. Ties go to the smaller vec_id. Rows with a null
vec_id take no part; rows that repeat a vec_id are candidates each for itself, but none of
them for its own id, and of repeated queries the one with the smallest vector asks. Values of any
size are exact; a component that is no 64-bit integer after floor(256 x), or a score among the k
best beyond 64 bits, is an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.session import stored

SLACK = 1e-3  # for rounding of distances, which are at least integers' square roots


def integers(table: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of the usable vectors; an error where it is no long."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_large = F.raise_error(F.lit("a component times 256 is beyond 64 bits")).cast("long")
    whole = F.transform(value, lambda x: F.when(F.abs(x) < 2.0**55, F.floor(x * 256)).otherwise(too_large))
    return table.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as int64 rows, padded with zeros."""
    sizes = np.asarray(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def lifted(v: np.ndarray, top: float | None) -> np.ndarray:
    """Rows with their last coordinate: what is missing to the norm ``top``, or 0 for queries."""
    v = v.astype(np.float64)
    last = np.zeros(len(v)) if top is None else np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
    return np.column_stack((v, last))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows: by floating point or 64 bits where that is exact, else by Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def assigned(vectors: DataFrame, pivots: np.ndarray, width: int, top: float | None) -> DataFrame:
    """vec_id, v with the nearest pivot and the distance to it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d = distances(lifted(matrix(part.column("v"), width), top), pivots)
                cell = d.argmin(axis=1)
                far = d[np.arange(len(d)), cell]
                arrays = [part.column("vec_id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "cell", "far"])

    return vectors.mapInArrow(nearest, "vec_id long, v array<long>, cell int, far double")


def query_bounds(queries: DataFrame, pivots: np.ndarray, width: int, near: np.ndarray, k: int) -> pd.DataFrame:
    """For each query cell its number of queries, radius, and a bound on every k-th distance.

    ``near[j]``: distances of the k + 1 objects of different ids nearest to pivot j, infinite where
    there are fewer. One of these objects may have the query's own id, so the (k + 1)-th is taken.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = lifted(matrix(batch.column("v"), width), None)
            d = distances(v, pivots)
            reach = np.empty(len(v))
            for i, row in enumerate(d):
                reach[i] = np.partition((row[:, None] + near).ravel(), k)[k]
            arrays = [batch.column("cell"), batch.column("far"), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "far", "reach"])

    return (
        queries.mapInArrow(bounded, "cell int, far double, reach double")
        .groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("reach").alias("reach"))
        .toPandas()  # one row per pivot
        .sort_values("cell")
        .reset_index(drop=True)
    )


def grouped(cells: pd.DataFrame, between: np.ndarray, per_group: int) -> np.ndarray:
    """A group for each query cell: near cells together, about ``per_group`` queries in one."""
    group, left, number = np.full(len(cells), -1), set(range(len(cells))), 0
    while left:
        first = min(left)
        room = per_group
        for i in sorted(left, key=lambda i: (between[cells.cell[first], cells.cell[i]], i)):
            if i != first and cells.n[i] > room:
                break
            group[i] = number
            room -= cells.n[i]
        left = {i for i in left if group[i] < 0}
        number += 1
    return group


def solve(queries: pd.DataFrame, data: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The k best of ``data`` for each query, in blocks."""
    data = data.sort_values("vec_id", kind="stable")
    ids = data["vec_id"].to_numpy()
    v = matrix(pa.array(data["v"], pa.list_(pa.int64())), width)
    parts = []
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        scores = products(matrix(pa.array(some["v"], pa.list_(pa.int64())), width), v)
        own = some["vec_id"].to_numpy()
        for query, row in zip(own, scores, strict=True):
            place = np.flatnonzero(ids != query)
            row = row[place]
            if len(row) > k:
                # Everything at or above the k-th score, in order of score and then id.
                best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            else:
                best = np.arange(len(row))
            best = best[np.argsort(-row[best], kind="stable")][:k]
            score = np.array(row[best].tolist(), np.int64)  # an error if one is beyond 64 bits
            parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[place[best]], "score": score}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 128, per_group: int = 512, per_task: int = 20_000
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k best rows of ``data``.

    Both have vec_id and an embedding.
    """
    spark = data.sparkSession
    vectors = stored(integers(data), "vectors")
    asked = stored(integers(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top, width, asked_width = (
        vectors.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()[:] + asked.agg(F.max(F.size("v"))).first()[:]
    )
    if not n or asked_width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, asked_width)
    drawn = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * pivots / n))
    sample = vectors.filter(drawn).limit(8 * pivots).toPandas()  # a bounded sample; it may be any rows
    chosen = sample.sort_values("vec_id").head(pivots)
    centres = np.unique(lifted(matrix(pa.array(chosen["v"], pa.list_(pa.int64())), width), top), axis=0)
    if not len(centres):
        centres = np.zeros((1, width + 1))
    between = distances(centres, centres)

    cells = stored(assigned(vectors, centres, width, top), "cells")
    asking = stored(assigned(asked, centres, width, None), "asking")
    nearest = Window.partitionBy("cell").orderBy("far")
    near = np.full((len(centres), k + 1), np.inf)
    # One object per id, so that at most one of those in a summary can be a query's own.
    single = cells.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("best")).select("best.*")
    ranked = single.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k + 1)
    for row in ranked.collect():  # k + 1 numbers per pivot
        near[row["cell"], row["rank"] - 1] = row["far"]
    slack = SLACK + 1e-6 * top**0.5  # distances of large vectors are rounded more
    near += slack

    summary = query_bounds(asking, centres, width, near, k)
    if summary.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    group = grouped(summary, between, per_group)
    # How near to and how far from pivot j an object useful to a group can be.
    reach = (summary["radius"] + summary["reach"]).to_numpy()[:, None] + slack
    gap = between[summary["cell"].to_numpy()]
    groups = range(group.max() + 1)
    least = np.stack([(gap - reach)[group == g].min(axis=0) for g in groups], axis=1)
    most = np.stack([(gap + reach)[group == g].max(axis=0) for g in groups], axis=1)

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))[:, None]
            row, to = np.nonzero((far >= least[cell]) & (far <= most[cell]))
            for at in range(0, len(row), 65536):
                rows = batch.select(["vec_id", "v"]).take(pa.array(row[at : at + 65536]))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(to[at : at + 65536].astype(np.int32))], ["vec_id", "v", "group"]
                )

    copies = stored(cells.mapInArrow(useful, "vec_id long, v array<long>, group int"), "copies")
    # Enough parts of each group for the session's tasks, and no more rows in one than per_task.
    sizes = copies.groupBy("group").count().withColumn("parts", F.ceil(F.col("count") / per_task).cast("int"))
    sizes = stored(sizes, "parts")  # one row per group
    of_cell = spark.createDataFrame(list(zip(summary["cell"].tolist(), group.tolist(), strict=True)), "cell int, group int")
    dealt = copies.join(F.broadcast(sizes), "group").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    posed = (
        asking.join(F.broadcast(of_cell), "cell")
        .join(F.broadcast(sizes), "group")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))))
    )
    local = (
        posed.select("group", "part", "vec_id", "v")
        .groupBy("group", "part")
        .cogroup(dealt.select("group", "part", "vec_id", "v").groupBy("group", "part"))
        .applyInPandas(lambda q, d: solve(q, d, width, k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(spark: SparkSession, sf_dir: str, every: int = 50, k: int = 5) -> DataFrame:
    """Every vector whose id is divisible by ``every``, against all others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.filter(F.col("vec_id") % every == 0), k)
