"""Near duplicates by SimHash, paired exactly through vantage-point trees (operator 3).

A tree node holds a vantage point and a radius. Fingerprints within the radius go left,
those beyond it go right, and those beyond it by at most ``bits`` go both ways. By the
triangle inequality two fingerprints at ``bits`` or fewer apart can then be separated only
if the farther one also went left, so each such pair meets in at least one leaf. The top of
the tree is fitted on a bounded sample and deals the distinct fingerprints into shards; a
shard continues with a tree of its own down to small leaves, compares within them, and
returns at most one edge per fingerprint (to the smallest one it reaches), never all pairs.

Fingerprints that trees cannot separate (a shard beyond ``shard_limit``, or a leaf of that
kind within a shard) are linked through shared one-bit neighbours: two fingerprints are at
two bits or fewer exactly if their sets {itself, its 64 one-bit flips} meet. That costs 65
rows each, however large the group is.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and
are linked like any other; a text of one or two words is one shingle; equal texts have equal
fingerprints. Repeated rows stay, each with its component. A null doc_id is ignored in the
choice of the smallest id; a component with no other id has a null one. An empty table gives
no rows. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import free_name, with_row_key
from sheaf.llm.components import components, local_roots
from sheaf.session import stored

BITS = 2
LEAF = 256
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The text's SimHash as a signed 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    if not parts:
        return 0
    words = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str, words: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the SimHash of ``text`` as a long column ``fp``."""
    docs = docs.select(*keep, "text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py(), words) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in keep), pa.array(values, pa.int64())], [*keep, "fp"]
            )

    return docs.mapInArrow(marked, docs.select(*keep).schema.add("fp", "long"))


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int64)


@dataclasses.dataclass
class Node:
    """``left`` and ``right`` are nodes or, for leaves, their numbers."""

    vantage: np.uint64
    radius: int
    left: Node | int
    right: Node | int


def split(points: np.ndarray, rng: np.random.Generator, bits: int = BITS) -> tuple[np.uint64, int] | None:
    """The vantage point and radius with the least copying for what they separate, if any does."""
    best, chosen = np.inf, None
    sample = points if len(points) <= 4096 else rng.choice(points, 4096, replace=False)
    n = len(sample)
    for vantage in rng.choice(sample, min(4, n), replace=False):
        within = np.cumsum(np.bincount(distances(sample, vantage), minlength=65 + bits))
        left, both = within[:64], within[bits : 64 + bits]
        use = (left > 0) & (np.maximum(both, n - left) <= 0.9 * n)
        if use.any():
            share = np.clip(left / n, 1e-9, 1 - 1e-9)
            gain = -(share * np.log(share) + (1 - share) * np.log(1 - share))
            cost = np.where(use, np.log1p((both - left) / n) / gain + 1e-3 / gain, np.inf)
            if cost.min() < best:
                best, chosen = cost.min(), (vantage, int(cost.argmin()))
    return chosen


def grow(sample: np.ndarray, leaf_size: int, rng: np.random.Generator, leaves: list[int]) -> Node | int:
    """A tree over a sample; ``leaves`` collects the leaf numbers."""
    found = split(sample, rng) if len(sample) > leaf_size else None
    if found is None:
        leaves.append(len(leaves))
        return leaves[-1]
    d = distances(sample, found[0])
    left = grow(sample[d <= found[1] + BITS], leaf_size, rng, leaves)
    return Node(*found, left, grow(sample[d > found[1]], leaf_size, rng, leaves))


def route(node: Node | int, points: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places in ``points``) for every leaf that gets some."""
    if not len(where):
        return
    if isinstance(node, int):
        yield node, where
        return
    d = distances(points[where], node.vantage)
    yield from route(node.left, points, where[d <= node.radius + BITS])
    yield from route(node.right, points, where[d > node.radius])


def flips(points: np.ndarray) -> np.ndarray:
    """Each fingerprint and its 64 one-bit neighbours, in rows of 65."""
    return points[:, None] ^ np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))).astype(
        np.uint64
    )


def leaf_links(points: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) that connect all points within ``BITS`` of each other."""
    waiting = [np.arange(len(points))]
    while waiting:
        where = waiting.pop()
        here = points[where]
        found = split(here, rng) if len(here) > LEAF else None
        if found is not None:
            d = distances(here, found[0])
            waiting += [where[d <= found[1] + BITS], where[d > found[1]]]
            continue
        if len(here) <= 4 * LEAF:
            a, b = np.nonzero(np.triu(np.bitwise_count(here[:, None] ^ here) <= BITS, 1))
        else:
            keys = flips(here).ravel()
            order = np.argsort(keys, kind="stable")
            same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
            a, b = order[same] // 65, order[same + 1] // 65
        roots = local_roots(len(here), a, b)
        linked = np.flatnonzero(roots != np.arange(len(here)))
        yield where[linked], where[roots[linked]]


def shard_edges(points: np.ndarray) -> pd.DataFrame:
    """(a, b): each linked fingerprint with the smallest one it reaches within the shard."""
    points = np.unique(points)
    links = list(leaf_links(points, np.random.default_rng(len(points))))
    a, b = (np.concatenate([link[i] for link in links]) if links else np.zeros(0, np.int64) for i in (0, 1))
    roots = local_roots(len(points), a, b)
    linked = roots != np.arange(len(points))
    return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[roots[linked]].view(np.int64)})


def link(distinct: DataFrame, shard_rows: int = 20_000, shard_limit: int = 500_000, sample_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within ``BITS`` bits.

    The top tree is fitted on about ``sample_rows`` fingerprints; every one is routed.
    """
    n = distinct.count()
    spark = distinct.sparkSession
    drawn = F.pmod(F.xxhash64(F.lit("vantage sample"), "fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    sample = np.sort(np.array([row.fp for row in distinct.filter(drawn).collect()], np.int64)).view(np.uint64)
    shards = max(4 * spark.sparkContext.defaultParallelism, n // shard_rows)
    leaves: list[int] = []
    tree = grow(sample, max(16, len(sample) // shards), np.random.default_rng(42), leaves)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("fp"), np.int64).view(np.uint64)
            for leaf, where in route(tree, points, np.arange(len(points))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(where), leaf, np.int32)), pa.array(points[where].view(np.int64))],
                    ["shard", "fp"],
                )

    routed = stored(distinct.select("fp").mapInArrow(dealt, "shard int, fp long"), "shards")
    counts = routed.groupBy("shard").count().filter(F.col("count") > shard_limit).collect()
    crowded = [row["shard"] for row in counts]  # no more than there are shards
    edges = (
        routed.filter(~F.col("shard").isin(crowded))
        .groupBy("shard")
        .applyInPandas(lambda rows: shard_edges(rows["fp"].to_numpy().view(np.uint64)), "a long, b long")
    )
    if crowded:
        edges = edges.union(neighbour_edges(routed.filter(F.col("shard").isin(crowded)).select("fp").distinct()))
    return edges


def neighbour_edges(distinct: DataFrame) -> DataFrame:
    """The same edges by shared one-bit neighbours, in 65 rows per fingerprint."""
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - ((i == 63) << 64))) for i in range(64))]
    keyed = distinct.select("fp", F.explode(F.array(*near)).alias("key"))
    lowest = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    return keyed.join(lowest, "key").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def labelled(per_fp: DataFrame, edges: DataFrame) -> DataFrame:
    """``per_fp`` (fp, distinct) with a label that linked fingerprints share."""
    labels = components(edges).withColumnRenamed("node", "fp")
    return per_fp.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, hot_share: int = 1000) -> DataFrame:
    """doc_id, fingerprint, component_id of every document (doc_id, text)."""
    rows = stored(fingerprints(docs, "doc_id"), "fingerprints")
    per_fp = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    classes = stored(labelled(per_fp, link(per_fp.select("fp"))), "classes")
    ids = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = stored(classes.join(ids, "label").select("fp", "n", "component_id"), "components")
    # At most hot_share fingerprints can hold more than that share of all rows.
    total = ids.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(ids.filter(F.col("n") * hot_share > total))
    joined = rows.join(hot, "fp").unionByName(
        rows.join(hot.select("fp"), "fp", "left_anti").join(ids.filter(F.col("n") * hot_share <= total), "fp")
    )
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` (all columns) without near duplicates: of each component the smallest doc_id stays.

    One row stays even if ids repeat or are null (null counts as largest). Only ids,
    fingerprints and row keys are stored; the rows are then looked up by key.
    """
    key = free_name(docs, "_row")
    rows = with_row_key(docs, key)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    marked = stored(fingerprints(rows, "doc_id", key, words=words), "fingerprints")
    per_fp = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    kept = labelled(per_fp, link(per_fp.select("fp"))).groupBy("label").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(key)), key, "left_semi").select(*docs.columns)
