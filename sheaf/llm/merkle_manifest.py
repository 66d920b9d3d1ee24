"""Merkle manifest of a dataset as a postorder append log (operator 11).

Every row is a leaf: the SHA-256 of its fields. The leaves of a ``lang``, by ascending doc_id,
are hashed in pairs, level by level, up to a subroot (a last node without a partner is hashed
alone), and the subroots, by lang, in the same way up to the root.

Leaves are cut into aligned blocks of ``1 << bits``. A builder has one block and writes the
nodes in the order in which they are completed, children before their parent. The top nodes
of the blocks are the leaves of the next round's builders, so each round has ``1 << bits``
times fewer rows, and no task holds more than one block, however large a lang is. The order
of completion is the tree's postorder, and a node's position in it follows from the sizes of
the subtrees before it alone (``position``). Proofs are read off the log by computed
positions: a leaf's siblings inside its block, then the siblings of the block's top, which
all leaves of the block share.

The log is a folder of Parquet files, one row per builder: tree, level, block, n (leaves of
the tree) and nodes (32 bytes each, in completion order). ``entries`` lists it node by node.
All digests are joined as lowercase hex text before they are hashed.

Defined results: a null field is written ``-``, which differs from an empty text (``0:``).
A null lang is a tree of its own, the first. Null doc_ids come first in their tree; rows that
repeat a doc_id are ordered by their leaf, and each has a proof of its own. A lone leaf is its
own subroot, and a lone subroot the root. Texts of any length are hashed whole. An empty table
has no leaves, no root and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import with_row_key
from sheaf.session import scratch_path, stored

BITS = 12
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

LOG_SCHEMA = "tree string, level int, block long, n long, nodes binary"
STEPS = "array<struct<left: boolean, digest: binary>>"
ABOVE_SCHEMA = f"tree string, block long, steps {STEPS}, subroot binary, root binary"
PROOF_SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def parent(*children: bytes) -> bytes:
    return hashlib.sha256("".join(child.hex() for child in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def position(level: int, i, n: int):
    """Place in the log of node ``i`` of ``level`` in a tree of ``n`` leaves; ``i`` may be an array.

    Before its subtree come the nodes that end left of its first leaf s, which are the whole
    subtrees there: s + s/2 + s/4 + ... = 2s - (ones in s). Its own subtree has ceil(m / 2^q) nodes
    on each level q, the last of which is the node itself.
    """
    i = np.asarray(i, np.int64)
    first = i << level
    leaves = np.minimum(1 << level, n - first)
    size = sum((leaves + (1 << q) - 1) >> q for q in range(level + 1))
    return 2 * first - np.bitwise_count(first) + size - 1


def completed(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes of one aligned block in the order in which they are completed."""
    nodes: list[bytes] = []
    waiting: list[bytes] = [b""] * (levels + 1)  # the last left child of each level
    level = 0
    for i, digest in enumerate(leaves):
        nodes.append(digest)
        level = 0
        while level < levels and i >> level & 1:
            digest = parent(waiting[level], digest)
            nodes.append(digest)
            level += 1
        waiting[level] = digest
    digest, last = waiting[level], len(leaves) - 1
    for above in range(level, levels):
        digest = parent(waiting[above], digest) if last >> above & 1 else parent(digest)
        nodes.append(digest)
    return nodes


def leaf(n_chars: Column | None = None) -> Column:
    """The digest of a row; ``n_chars`` in place of its own."""
    parts = []
    for name in FIELDS:
        value = (n_chars if n_chars is not None and name == "n_chars" else F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """tree, doc_id, digest and claimed (the leaf to be verified) of each row."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # keeps the order, null first
    return docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("digest"),
        (leaf() if claimed is None else claimed).alias("claimed"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add idx, the place of a row in its ``tree``, and n, the tree's rows.

    Rows are dealt out by range and sorted, so a tree of any size is spread over tasks; per task
    and tree only a first place and a count are combined.
    """
    keys = [F.col("tree"), *map(F.col, order)]
    dealt = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id()),
        "ranked",
    )
    per_tree = Window.partitionBy("tree")
    earlier = per_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("c"))
    offsets = counts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("c").over(per_tree).alias("n"),
    )
    joined = dealt.join(offsets, ["tree", "part"])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def build(rows: DataFrame, path: str, bits: int = BITS) -> list[int]:
    """Write the log of the trees of ``rows`` (tree, idx, n, digest) under ``path``; its levels."""

    def builder(level: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            tree, n, block = (table.column(name)[0].as_py() for name in ("tree", "n", "block"))
            levels = min(bits, height(n) - level)
            nodes = b"".join(completed(table.column("digest").to_pylist(), levels))
            values = {"tree": [tree], "level": [level], "block": [block], "n": [n], "nodes": [nodes]}
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(values.items(), kinds, strict=True)})

        return run

    levels: list[int] = []
    while not levels or not rows.isEmpty():
        level = len(levels) * bits
        blocks = rows.select("tree", "idx", "n", "digest", F.shiftright("idx", bits).alias("block"))
        blocks.groupBy("tree", "block").applyInArrow(builder(level), LOG_SCHEMA).write.parquet(f"{path}/{level}")
        levels.append(level)
        log = read_log(rows.sparkSession, path, level)
        unfinished = F.col("n") > F.lit(1 << min(level + bits, 62))
        rows = log.filter(unfinished).select("tree", F.col("block").alias("idx"), "n", top().alias("digest"))
    return levels


def read_log(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/{level}")


def top() -> Column:
    """The last node of a block."""
    return F.substring("nodes", -32, 32)


def tops(spark: SparkSession, path: str, levels: list[int], bits: int = BITS) -> DataFrame:
    """tree, n, digest: the top of each tree."""
    found = None
    for level in levels:
        done = F.col("n") <= F.lit(1 << min(level + bits, 62))
        part = read_log(spark, path, level).filter(done).select("tree", "n", top().alias("digest"))
        found = part if found is None else found.unionByName(part)
    return found


def entries(spark: SparkSession, path: str, levels: list[int], bits: int = BITS) -> DataFrame:
    """tree, pos, level, idx, digest: the log node by node, at its positions in the whole tree."""

    def listed(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    first, n = row["block"] << bits, row["n"]
                    width = -(-n >> level)  # leaves of this round
                    m = min(1 << bits, width - first)
                    rounds = range(0 if not level else 1, min(bits, height(n) - level) + 1)
                    for up in rounds:
                        i = np.arange(-(-m >> up))
                        at = position(up, i, m)
                        node = (first >> up) + i
                        arrays = [
                            pa.array([row["tree"]] * len(i)),
                            pa.array(position(level + up, node, n)),
                            pa.array(np.full(len(i), level + up, np.int32)),
                            pa.array(node),
                            pa.array([row["nodes"][32 * a : 32 * a + 32] for a in at.tolist()]),
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, ["tree", "pos", "level", "idx", "digest"])

        return run

    schema = "tree string, pos long, level int, idx long, digest binary"
    found = [read_log(spark, path, level).mapInArrow(listed(level), schema) for level in levels]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def siblings(nodes: bytes, m: int, levels: int) -> list[list[bytes | None]]:
    """Per level and leaf of a block the sibling on the leaf's way up, None where there is none."""
    found = []
    for level in range(levels):
        other = (np.arange(m) >> level) ^ 1
        there = other < -(-m >> level)
        at = np.where(there, position(level, np.where(there, other, 0), m), -1)
        found.append([nodes[32 * a : 32 * a + 32] if a >= 0 else None for a in at.tolist()])
    return found


def fold(digest: bytes, steps) -> bytes:
    """Hash a node up along (left, sibling) steps; a step without a sibling hashes it alone."""
    for left, sibling in steps:
        digest = parent(digest) if sibling is None else parent(sibling, digest) if left else parent(digest, sibling)
    return digest


def below(blocks: DataFrame, above: DataFrame, level: int, bits: int) -> DataFrame:
    """The steps above each leaf of the ``blocks`` of one round, from the steps above the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("tree", pa.string()), ("block", pa.int64()),
            ("steps", pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.binary())]))),
            ("subroot", pa.binary()), ("root", pa.binary()),
        ])
        for batch in batches:
            for row in batch.to_pylist():
                first, n = row["block"] << bits, row["n"]
                m, levels = min(1 << bits, -(-n >> level) - first), min(bits, height(n) - level)
                per_level = siblings(row["nodes"], m, levels)
                for start in range(0, m, 256):
                    out = [
                        {
                            "tree": row["tree"],
                            "block": first + i,
                            "steps": [
                                {"left": bool(i >> q & 1), "digest": level_[i]} for q, level_ in enumerate(per_level)
                            ]
                            + row["steps"],
                            "subroot": row["subroot"],
                            "root": row["root"],
                        }
                        for i in range(start, min(start + 256, m))
                    ]
                    yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.join(above, ["tree", "block"]).select(*blocks.columns, "steps", "subroot", "root").mapInArrow(run, ABOVE_SCHEMA)


def steps_above(spark: SparkSession, path: str, levels: list[int], per_tree: DataFrame, bits: int, last: int) -> DataFrame:
    """The steps above each block of level ``last``, going down from ``per_tree`` (tree, steps, subroot, root)."""
    above = None
    for level in reversed([level for level in levels if level >= last]):
        blocks = read_log(spark, path, level)
        done = F.col("n") <= F.lit(1 << min(level + bits, 62))
        here = blocks.filter(done).select("tree", "block").join(per_tree, "tree")
        above = here if above is None else here.unionByName(above)
        above = stored(above.select("tree", "block", "steps", "subroot", "root"), "above")
        if level > last:
            above = below(blocks, above, level, bits)
    return above


def verify(rows: DataFrame, blocks: DataFrame, above: DataFrame, bits: int = BITS) -> DataFrame:
    """A proof for each of ``rows`` (tree, idx, n, doc_id, digest, claimed), and what its claimed leaf folds to."""

    def run(claims: pa.Table, block: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        n = row["n"]
        first = row["block"] << bits
        m, levels = min(1 << bits, n - first), min(bits, height(n))
        per_level = siblings(row["nodes"], m, levels)
        steps = [(step["left"], step["digest"]) for step in row["steps"]]
        shared = "".join(sibling.hex() for _, sibling in steps if sibling is not None)
        above_block = cache(lambda digest: fold(digest, steps))
        out = {name: [] for name in ("doc_id", "leaf", "proof_sha256", "folded_root", "verified")}
        for doc_id, idx, digest, claimed in zip(
            *(claims.column(name).to_pylist() for name in ("doc_id", "idx", "digest", "claimed")), strict=True
        ):
            i = idx - first
            own = [level[i] for level in per_level]
            text = "".join(sibling.hex() for sibling in own if sibling is not None) + shared
            folded = above_block(fold(claimed, ((i >> q & 1, sibling) for q, sibling in enumerate(own))))
            out["doc_id"].append(doc_id)
            out["leaf"].append(digest.hex())
            out["proof_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            out["folded_root"].append(folded.hex())
            out["verified"].append(folded == row["root"])
        count = len(out["leaf"])
        out["subroot"], out["root"] = [row["subroot"].hex()] * count, [row["root"].hex()] * count
        names = [field.split()[0] for field in PROOF_SCHEMA.split(", ")]
        kinds = {"doc_id": pa.int64(), "verified": pa.bool_()}
        return pa.table({name: pa.array(out[name], kinds.get(name, pa.string())) for name in names})

    claims = rows.select("tree", F.shiftright("idx", bits).alias("block"), "idx", "doc_id", "digest", "claimed")
    placed = blocks.join(above, ["tree", "block"]).select("tree", "block", "n", "nodes", "steps", "subroot", "root")
    return claims.groupBy("tree", "block").cogroup(placed.groupBy("tree", "block")).applyInArrow(run, PROOF_SCHEMA)


def manifest(docs: DataFrame, claimed: Column | None = None, path: str | None = None, bits: int = BITS) -> DataFrame:
    """Write the log of ``docs`` and return a proof of every row, verified against ``claimed``.

    ``claimed`` is the leaf that someone presents for the row, by default the row's own.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "merkle")
    rows = with_row_key(stored(leaves(docs, claimed), "leaves"), "row")
    rows = stored(numbered(rows, "doc_id", "digest", "row").drop("row"), "numbered")
    levels = build(rows, f"{path}/trees", bits)
    subroots = tops(spark, f"{path}/trees", levels, bits).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    subroots = stored(numbered(subroots, "of"), "subroots")
    root_levels = build(subroots, f"{path}/root", bits)
    root = tops(spark, f"{path}/root", root_levels, bits)
    # The way from a subroot up, one row per tree.
    none = F.array().cast(STEPS)
    start = root.select("tree", none.alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    ways = steps_above(spark, f"{path}/root", root_levels, start, bits, 0)
    ways = below(read_log(spark, f"{path}/root", 0), ways, 0, bits).select(F.col("block").alias("idx"), "steps", "root")
    per_tree = stored(
        subroots.join(ways, "idx").select(F.col("of").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"),
        "ways",
    )
    above = steps_above(spark, f"{path}/trees", levels, per_tree, bits, 0)
    return verify(rows, read_log(spark, f"{path}/trees", 0), above, bits)


def tampered_leaf() -> Column:
    """The leaf with n_chars raised by 1 where 7 divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")  # room for the largest long and 1
    return leaf(F.when(hit, n_chars + 1).otherwise(n_chars))
