"""Ranked lexical search by hybrid TAAT-DAAT evaluation (operator 12).

Indexing is one pass without a shuffle. A task gathers documents into segments; a segment has
its documents in ascending doc_id and one row per term: the places of the documents that hold
it, and how often. A last row per segment has the documents' ids and lengths. Corpus figures
(documents, terms, documents per term) are sums over those rows, so they cover every document.

A search brings the lists of the asked terms together by segment; a segment is bounded, so a
term in every document is many lists, never one. In a segment each item is answered in two
steps. Its short lists are added up term at a time into accumulators. These are then one more
iterator, with the largest accumulator of a window of documents as its bound, beside the long
lists, which have the largest score of each window as theirs. Document at a time, in ascending
order, windows whose bounds cannot reach the k-th best score are skipped, and in the others a
long list is only probed at documents that still can. The k best of each segment are merged.

Items are taken in blocks of at most ``block_terms`` term rows (a whole item at least), with one
pass over their terms' lists per block. With ``asked`` given, only lists of these terms are
written; without it the index holds every term.

Defined results: a null text has no terms and is no document of the collection; neither is a
text without terms. A null item text finds nothing. Each row of items is an item of its own, and
each row of documents a document, also when ids repeat. Null doc_ids come last among equal
scores. Empty tables give no rows. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from sheaf.llm.common import slices
from sheaf.session import scratch_path, stored
from sheaf.settings import BROADCAST_BYTES

WINDOW = 256  # documents that share a bound
STEP = 16  # neighbouring windows that are read at once
# Fixed by the contract: ASCII letters and digits and all other characters belong to terms, and A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Segment:
    """Documents gathered until they are written."""

    def __init__(self) -> None:
        self.doc_ids: list = []
        self.sizes: list[int] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.terms: list[int] = []
        self.counts: list[int] = []
        self.held: list[int] = []  # terms of each document

    def add(self, doc_id, n: int, counts: Counter) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(n)
        self.terms.extend(map(self.number.__getitem__, counts))
        self.counts.extend(counts.values())
        self.held.append(len(counts))

    def batch(self, segment: int, schema: pa.Schema) -> pa.RecordBatch:
        n = len(self.doc_ids)
        order = sorted(range(n), key=lambda i: ((x := self.doc_ids[i]) is None, x))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        docs, ids = np.repeat(place, self.held), np.array(self.terms, np.int64)
        sort = np.lexsort((docs, ids))
        df = np.bincount(ids, minlength=len(self.number))
        sizes = np.array(self.sizes, np.int64)[order]
        ends = np.concatenate((np.cumsum(df, dtype=np.int64), [len(ids) + n]))
        bounds = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        counts = np.array(self.counts, np.int64)[sort]
        rows = len(df) + 1
        doc_bounds = pa.array(np.concatenate((np.zeros(rows), [n])).astype(np.int32))
        doc_ids = pa.array([self.doc_ids[i] for i in order], schema.field("doc_ids").type.value_type)
        arrays = [
            pa.array(np.full(rows, segment, np.int64)),
            pa.array([*self.number, None], pa.binary()),
            pa.array(np.append(df, n)),
            pa.array(np.append(np.zeros(len(df), np.int64), sizes.sum())),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate((docs[sort], np.arange(n))).astype(np.int32))),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate((counts, sizes)))),
            pa.ListArray.from_arrays(doc_bounds, doc_ids),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema.names)


def build_index(
    docs: DataFrame, path: str, asked: frozenset[bytes] | None = None, postings: int = 1 << 20, documents: int = 1 << 16
) -> DataFrame:
    """Write the segments of ``docs`` (doc_id, text) under ``path`` and return their rows.

    segment, term (null in the row of the documents), n_docs, n_terms, places, counts, doc_ids.
    """
    schema = (
        StructType()
        .add("segment", "long").add("term", "binary").add("n_docs", "long").add("n_terms", "long")
        .add("places", ArrayType(IntegerType())).add("counts", ArrayType(LongType()))
        .add("doc_ids", ArrayType(docs.schema["doc_id"].dataType))
    )
    wanted = None if asked is None else docs.sparkSession.sparkContext.broadcast(asked)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written, now = TaskContext.get().partitionId(), 0, Segment()
        keep = None if wanted is None else wanted.value.__contains__
        for batch in slices(batches):
            ids = batch.column("doc_id")
            names = ["segment", "term", "n_docs", "n_terms", "places", "counts", "doc_ids"]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            out = pa.schema(list(zip(names, [*kinds, pa.list_(ids.type)], strict=True)))
            for doc_id, text in zip(ids.to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = terms(text.as_py())
                if found:
                    now.add(doc_id, len(found), Counter(found if keep is None else filter(keep, found)))
                if len(now.terms) >= postings or len(now.doc_ids) >= documents:
                    yield now.batch((part << 32) + written, out)
                    written, now = written + 1, Segment()
        if now.doc_ids:
            yield now.batch((part << 32) + written, out)

    docs.select("doc_id", "text").mapInArrow(segments, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def item_terms(items: DataFrame) -> DataFrame:
    """item, term, repeats of each row of ``items`` (item, text)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column("item"), batch.column("text").cast(pa.binary()), strict=True):
                found = Counter(terms(text.as_py()))
                arrays = [pa.array([item.as_py()] * len(found), pa.int64()), pa.array(list(found), pa.binary())]
                arrays.append(pa.array(list(found.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, ["item", "term", "repeats"])

    return items.select("item", "text").mapInArrow(listed, "item long, term binary, repeats long")


class Lists:
    """The postings of a segment's asked terms, with what a posting scores before its weight."""

    def __init__(self, table: pa.Table, total_docs: int, total_terms: int):
        is_docs = table.column("term").is_null().to_numpy()
        own = table.filter(pa.array(is_docs))
        sizes = own.column("counts").combine_chunks().flatten().to_numpy()
        self.doc_ids = own.column("doc_ids").combine_chunks().flatten()
        self.n = len(sizes)
        lists = table.filter(pa.array(~is_docs))
        places = lists.column("places").combine_chunks()
        self.places = places.flatten().to_numpy()
        tf = lists.column("counts").combine_chunks().flatten().to_numpy()
        self.starts = np.concatenate(([0], np.cumsum(places.value_lengths().to_numpy(), dtype=np.int64)))
        self.number = {term: i for i, term in enumerate(lists.column("term").to_pylist())}
        if sizes.size and int(sizes.max()) * total_docs * 75 >= 1 << 63:
            share = np.array([75 * int(n) * total_docs // total_terms for n in sizes], np.int64)
        else:
            share = 75 * sizes * total_docs // max(total_terms, 1)
        m = 100 - 75 + share
        self.base = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        self.windows = -(-self.n // WINDOW)
        self._long: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0  # postings looked at, for tests

    def size(self, i: int) -> int:
        return int(self.starts[i + 1] - self.starts[i])

    def long(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of a list starts, and its largest score."""
        if i not in self._long:
            first, last = self.starts[i], self.starts[i + 1]
            cuts = np.searchsorted(self.places[first:last], np.arange(self.windows + 1) * WINDOW)
            filled = np.flatnonzero(cuts[1:] > cuts[:-1])
            best = np.zeros(self.windows, np.int64)
            best[filled] = np.maximum.reduceat(self.base[first:last], cuts[filled])
            cuts = first + cuts
            self._long[i] = cuts, best
        return self._long[i]

    def top(self, asked: list[tuple[int, int]], k: int, short_share: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents for (list, weight) pairs."""
        short = [(i, w) for i, w in asked if self.size(i) * short_share <= self.n]
        lists = [(i, w, *self.long(i)) for i, w in asked if self.size(i) * short_share > self.n]
        sums = np.zeros(self.windows * WINDOW, np.int64)
        for i, w in short:  # term at a time
            part = slice(self.starts[i], self.starts[i + 1])
            sums[self.places[part]] += w * self.base[part]
            self.read += self.size(i)
        # One iterator over the accumulators, and the bounds of the long lists, by window.
        bounds = np.array([w * best for _, w, _, best in lists], np.int64).reshape(len(lists), self.windows)
        reach = sums.reshape(self.windows, WINDOW).max(axis=1) + bounds.sum(axis=0)
        need = max(1, self.first_threshold(sums, lists, k))
        kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while True:
            hopeful = at + np.flatnonzero(reach[at:] >= need)[:STEP]
            if not len(hopeful):
                return kept, scores
            low = int(hopeful[0])
            high = low + int((hopeful == low + np.arange(len(hopeful))).sum())  # neighbours only
            places, found = self.documents(sums, lists, bounds, low, high, need)
            kept, scores = np.concatenate((kept, places)), np.concatenate((scores, found))
            if len(kept) >= k:
                best = np.lexsort((kept, -scores))[:k]
                kept, scores = kept[best], scores[best]
                need = max(need, int(scores[-1]) + 1)  # later documents lose among equals
            at = high

    def first_threshold(self, sums: np.ndarray, lists, k: int) -> int:
        """The k-th best full score among the documents with the largest accumulators."""
        if self.n < k:
            return 0
        chosen = np.sort(np.argpartition(sums[: self.n], self.n - k)[self.n - k :])
        full = sums[chosen]
        for i, w, _, _ in lists:
            full += w * self.probe(i, chosen)
        return int(full.min())

    def probe(self, i: int, places: np.ndarray) -> np.ndarray:
        first, last = self.starts[i], self.starts[i + 1]
        at = first + np.searchsorted(self.places[first:last], places)
        there = (at < last) & (self.places[np.minimum(at, last - 1)] == places)
        self.read += len(places)
        return np.where(there, self.base[np.minimum(at, last - 1)], 0)

    def documents(self, sums, lists, bounds, low: int, high: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents of windows low to high that reach ``need``."""
        start = low * WINDOW
        scores = sums[start : high * WINDOW].copy()
        most = bounds[:, low:high].max(axis=1) if len(lists) else np.zeros(0, np.int64)
        rest, alive = int(most.sum()), None
        for j in np.argsort(-most, kind="stable").tolist():
            i, w, cuts, _ = lists[j]
            if alive is None and rest < need:  # a document that is new here cannot make it
                alive = np.flatnonzero(scores)
            if alive is None:
                part = slice(cuts[low], cuts[high])
                scores[self.places[part] - start] += w * self.base[part]
                self.read += part.stop - part.start
            else:
                alive = alive[scores[alive] + rest >= need]
                if not len(alive):
                    break
                scores[alive] += w * self.probe(i, alive + start)
            rest -= int(most[j])
        if alive is None:
            alive = np.flatnonzero(scores)
        alive = alive[scores[alive] >= need]
        return alive + start, scores[alive]


def search(index: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 20) -> DataFrame:
    """item, rank, doc_id, score: the ``k`` best documents of the index for each row of ``items`` (item, text)."""
    spark = index.sparkSession
    asked = stored(item_terms(items), "item_terms")
    own = index.filter("term IS NULL")
    total_docs, total_terms = (int(x or 0) for x in own.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"))
    ratio = F.lit(float(2 * total_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(1000 * F.log(ratio)) * F.col("repeats")
    weighted = stored(
        asked.join(df, "term").select("item", "term", weight.alias("weight")).filter("weight > 0"), "weighted"
    )
    blocks = max(1, -(-weighted.count() // block_terms))
    number = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for i in range(blocks):
        block = weighted.filter(number == i)
        part = _search_block(index, block, total_docs, total_terms, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search_block(index: DataFrame, block: DataFrame, total_docs: int, total_terms: int, k: int) -> DataFrame:
    wanted: dict[int, list] = defaultdict(list)
    for row in block.toLocalIterator():
        wanted[row["item"]].append((bytes(row["term"]), row["weight"]))
    shared = index.sparkSession.sparkContext.broadcast(dict(wanted))
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = StructType().add("item", "long").add("doc_id", id_type).add("score", "long")

    def run(table: pa.Table) -> pa.Table:
        lists = Lists(table, total_docs, total_terms)
        items, places, scores = [], [], []
        for item, pairs in shared.value.items():
            present = [(lists.number[term], w) for term, w in pairs if term in lists.number]
            if present:
                best, found = lists.top(present, k)
                items += [item] * len(best)
                places.append(best)
                scores.append(found)
        none = np.zeros(0, np.int64)
        doc_ids = lists.doc_ids.take(pa.array(np.concatenate((none, *places))))
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": doc_ids, "score": np.concatenate((none, *scores))})

    terms_ = F.broadcast(block.select("term").distinct())  # a block is bounded
    lists = index.join(terms_, "term", "left_semi").unionByName(index.filter("term IS NULL"))
    return lists.select("segment", "term", "places", "counts", "doc_ids").groupBy("segment").applyInArrow(run, schema)


def asked_terms(items: DataFrame, limit: int = BROADCAST_BYTES) -> frozenset[bytes] | None:
    """The distinct terms of ``items``, or None if they take more than ``limit`` bytes."""
    found = stored(item_terms(items).select("term").distinct(), "asked")
    size = found.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return frozenset(bytes(row["term"]) for row in found.collect()) if size <= limit else None


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, path: str | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    items = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    index = build_index(docs, path or scratch_path(spark, "lexical"), asked_terms(items))
    return search(index, items, k).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
