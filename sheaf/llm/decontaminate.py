"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 6).

A passage of m characters that occurs with at most k edits shares at least m + 1 - q - kq of
its q-grams with the text, and all of these lie on k + 1 neighbouring diagonals (place in the
text less place in the passage). So the shared q-grams of a text are counted in bands of
diagonals that overlap by k, a band is kept if its count meets that bound, and a banded
alignment finds the true number of edits. The filter loses nothing within the budget.

The budget is k = edit_share * m edits. With q = 8, or 6 for passages of fewer than ``LONG``
characters, the bound stays positive for every passage of ``min_chars`` or more. Shorter ones
would match by chance; they count where they stand exactly, between word boundaries.
Texts and passages are compared in lower case with runs of other characters than letters
and digits as one blank, so case, punctuation and line breaks don't count.

The passages' q-grams are hashed into a sorted index that goes to every task; passages are
taken in blocks of at most ``block_chars`` characters, so its size is bounded and a large
benchmark costs several passes. Documents are never shuffled.

Defined results: null and empty texts contain nothing; passages that are null or have no letter
or digit are not searched for. item_id may have any type. Of
several occurrences of a passage in a document, the one with the fewest edits and then the first is
reported. Repeated rows are reported each; repeated passages are each their own. Texts of any
length are searched whole, in pieces of normalised characters that overlap by more than a passage
with its edits. An empty table on either side gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from sheaf.llm.common import BLOCK_CHARS, code_points, scrambled, slices

Q, SMALL_Q = 8, 6
LONG = 80  # characters of a passage from which on Q is used
BITS = 22
_plain: np.ndarray | None = None


def plain() -> np.ndarray:
    """For each code point its lower-case letter or digit; a blank for all else."""
    global _plain
    if _plain is None:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x40000):
            char = chr(code)
            if char.isalnum():
                small = char.lower()
                table[code] = ord(small) if len(small) == 1 else code
        _plain = table
    return _plain


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters of a text and the place of each."""
    codes = plain()[code_points(text)]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    places = np.flatnonzero(keep)
    return codes[places], places


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for every q characters in a row, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    have = {1: codes.astype(np.uint64)}
    size = 1
    power = 0x9E3779B97F4A7C15
    out, out_size = None, 0
    rest = q
    while rest:
        if rest & 1:
            part = have[size]
            if out is None:
                out, out_size = part, size
            else:
                n = len(codes) - out_size - size + 1
                out, out_size = out[:n] * np.uint64(power) + part[out_size : out_size + n], out_size + size
        rest >>= 1
        if rest:
            n = len(codes) - 2 * size + 1
            have[2 * size] = have[size][:n] * np.uint64(power) + have[size][size : size + n]
            power = power * power % (1 << 64)
            size *= 2
    return scrambled(out)


@dataclasses.dataclass
class Passages:
    """A block of passages: their characters, budgets, bounds and a sorted q-gram index."""

    q: int
    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash, and the end of the last
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple], edit_share: float, q: int) -> Passages:
        codes = [codes for _, codes in rows]
        sizes = np.array([len(c) for c in codes], np.int64)
        edits = (edit_share * sizes + 1e-9).astype(np.int64)
        grams = [qgrams(c, q) for c in codes]
        hashes = np.concatenate(grams)
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        distinct, first = np.unique(hashes[order], return_index=True)
        seen = np.zeros(1 << BITS, bool)
        seen[(distinct >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return cls(
            q, [key for key, _ in rows], codes, edits, np.maximum(sizes + 1 - q - edits * q, 1), distinct,
            np.append(first, len(order)), item[order].astype(np.int64), place[order].astype(np.int64), seen,
        )

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of all shared q-grams."""
        at = np.flatnonzero(self.seen.take((hashes >> np.uint64(64 - BITS)).astype(np.int64)))
        found = np.searchsorted(self.hashes, hashes[at])
        same = self.hashes[np.minimum(found, len(self.hashes) - 1)] == hashes[at]
        at, found = at[same], found[same]
        counts = self.first[found + 1] - self.first[found]
        entry = np.repeat(self.first[found] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.item[entry], self.place[entry]


def bands(
    owner: np.ndarray, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray, passages: Passages
) -> np.ndarray:
    """(owner, item, lowest diagonal, highest diagonal) of the bands with enough shared q-grams."""
    if not len(owner):
        return np.zeros((0, 4), np.int64)
    edits = passages.edits[item]
    width = edits + 1
    band = diagonal // width
    lower = np.flatnonzero(diagonal - band * width < edits)  # a band reaches over edits diagonals of the next
    bias = 1 - band.min()
    span = band.max() + bias + 1
    key = (owner * len(passages.ids) + item) * span + band + bias
    key, place = np.concatenate((key, key[lower] - 1)), np.concatenate((place, place[lower]))
    found, counts = np.unique(key, return_counts=True)
    found = found[counts >= passages.bounds[found // span % len(passages.ids)]]
    # Within what is left, a place of the passage counts once.
    index = np.searchsorted(found, key)
    near = np.flatnonzero(found.take(index, mode="clip") == key) if len(found) else np.zeros(0, np.int64)
    pairs = np.unique(index[near] * (place.max() + 1) + place[near])
    counts = np.bincount(pairs // (place.max() + 1), minlength=len(found))
    owner, item, band = found // span // len(passages.ids), found // span % len(passages.ids), found % span - bias
    kept = counts >= passages.bounds[item]
    low = (band * (passages.edits[item] + 1))[kept]
    return np.stack([owner[kept], item[kept], low, low + 2 * passages.edits[item[kept]]], axis=1)


def align(text: np.ndarray, passage: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence within the diagonals, if within the budget.

    Cells are edits * 2^32 + start, so that the start comes along with the minimum.
    """
    m, width = len(passage), high - low + 1
    one, far = np.int64(1) << 32, np.int64(1) << 48
    # Places outside the text are characters that fit nothing.
    part = np.zeros(m + width, np.uint32)
    begin, end = max(low, 0), min(low + m + width, len(text))
    if begin < end:
        part[begin - low : end - low] = text[begin:end]
    cells = np.clip(low + np.arange(width), 0, len(text)).astype(np.int64)
    skipped = np.full(width, far)
    steps = np.arange(width) * one
    for i in range(m):
        skipped[:-1] = cells[1:] + one  # a character of the passage is missing in the text
        best = np.minimum(cells + (part[i : i + width] != passage[i]) * one, skipped)
        best -= steps
        cells = np.minimum.accumulate(best) + steps  # the text has characters of its own
        if i % 16 == 15 and cells.min() >> 32 > edits:
            return None
    at = int((cells >> 32).argmin())
    found, start = int(cells[at] >> 32), int(cells[at] & (one - 1))
    end = min(at + low + m, len(text))
    return (found, start, end) if found <= edits and start < end else None


@dataclasses.dataclass
class Exact:
    """Short passages, found between word boundaries as they are."""

    ids: list
    texts: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.texts))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for text in set(self.texts):
            found.add_word(f" {text} ", [i for i, other in enumerate(self.texts) if other == text])
        found.make_automaton()
        return found


def normal_blocks(texts: list[str | None], overlap: int, limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Lists of (row, characters, their places) of about ``limit`` normalised characters.

    A longer text is normalised part by part and becomes several pieces that share ``overlap``
    characters, so an occurrence lies whole in one of them whatever signs stand in between.
    """
    block, size = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        codes, places = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for offset in range(0, max(len(text), 1), limit):
            back = min(offset, 1)  # the character before tells if a blank is the first of its run
            found, at = normalized(text[offset - back : offset + limit])
            found, at = found[at >= back], at[at >= back]
            codes, places = np.concatenate((codes, found)), np.concatenate((places, at + offset - back))
            if offset + limit < len(text) and len(codes) < limit:
                continue
            if block and size + len(codes) > limit:
                yield block
                block, size = [], 0
            block.append((row, codes, places))
            size += len(codes)
            codes, places = codes[-overlap:], places[-overlap:]
    if block:
        yield block


def search_exact(texts: list[str | None], passages: Exact, automaton) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, passage, 0, start, end) of the first place of each short passage in each text."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for block in normal_blocks(texts, passages.longest + 2):
        for row, codes, places in block:
            # Pieces are cut anywhere: only the ends of a text are word boundaries by themselves.
            text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            before = " " if len(places) and not any(map(str.isalnum, texts[row][max(int(places[0]) - 1, 0) : int(places[0])])) else ""
            after = " " if len(places) and not any(map(str.isalnum, texts[row][int(places[-1]) + 1 : int(places[-1]) + 2])) else ""
            for end, which in automaton.iter(before + text + after):
                for i in which:
                    last = end - 1 - len(before)
                    first = last - len(passages.texts[i]) + 1
                    span = (int(places[first]), int(places[last]) + 1)
                    best[row, i] = min(best.get((row, i), span), span)
    for (row, which), span in best.items():
        yield (row, which, 0, *span)


def search(texts: list[str | None], passages: Passages) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, passage, edits, start, end) of the best occurrence of each passage in each text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    q = passages.q
    overlap = max(len(codes) + int(edits) for codes, edits in zip(passages.codes, passages.edits, strict=True)) + q
    for block in normal_blocks(texts, overlap):
        codes = np.concatenate([codes for _, codes, _ in block])
        ends = np.cumsum([len(codes) for _, codes, _ in block])
        begins = ends - [len(codes) for _, codes, _ in block]
        at, item, place = passages.shared(qgrams(codes, q))
        owner = np.searchsorted(ends, at, "right")
        whole = at + q <= ends[np.minimum(owner, len(ends) - 1)]
        at, item, place, owner = at[whole], item[whole], place[whole], owner[whole]
        for piece, which, low, high in bands(owner, item, place, at - begins[owner] - place, passages):
            row, here, places = block[piece]
            found = align(here, passages.codes[which], int(low), int(high), int(passages.edits[which]))
            if found:
                edits, start, end = found
                span = (edits, int(places[start]), int(places[end - 1]) + 1)
                key = (row, int(which))
                best[key] = min(best.get(key, span), span)
    for (row, which), span in best.items():
        yield (row, which, *span)


def passage_blocks(
    benchmark: DataFrame, edit_share: float = 0.1, min_chars: int = 20, block_chars: int = 1 << 21
) -> Iterator[Passages | Exact]:
    """The passages in blocks, those of a length class together; the driver holds a block of each class."""
    held: dict[int, list[tuple]] = {0: [], SMALL_Q: [], Q: []}
    sizes = dict.fromkeys(held, 0)

    def built(q: int) -> Passages | Exact:
        rows, held[q], sizes[q] = held[q], [], 0
        if q:
            return Passages.build(rows, edit_share, q)
        texts = [codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for _, codes in rows]
        return Exact([key for key, _ in rows], texts)

    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        codes, _ = normalized(row["text"])
        codes = codes[1:] if len(codes) and codes[0] == 32 else codes
        codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
        if not len(codes):
            continue
        q = 0 if len(codes) < max(min_chars, SMALL_Q) else SMALL_Q if len(codes) < LONG else Q
        if held[q] and sizes[q] + len(codes) > block_chars:
            yield built(q)
        held[q].append((row["item_id"], codes))
        sizes[q] += len(codes)
    for q in held:
        if held[q]:
            yield built(q)


def finder(passages: Passages | Exact):
    """The search of a task for a block of passages."""
    if isinstance(passages, Passages):
        return lambda texts: search(texts, passages)
    automaton = passages.automaton()
    return lambda texts: search_exact(texts, passages, automaton)


def contaminated(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", **limits) -> DataFrame:
    """``row``, item_id, edits, start, end: each passage found in each document.

    ``start`` and ``end`` are code points of the document's text. ``limits`` are those of ``passage_blocks``.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    schema = docs.select(row).schema.add("item_id", item_type)
    schema = schema.add("edits", "integer").add("start", "long").add("end", "long")
    out = spark.createDataFrame([], schema)
    for block in passage_blocks(benchmark, **limits):
        shared = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = shared.value
            find = finder(passages)
            for batch in slices(batches):
                found = list(find(batch.column("text").to_pylist()))
                rows, items, edits, starts, ends = zip(*found, strict=True) if found else ((),) * 5
                arrays = [
                    batch.column(row).take(pa.array(rows, pa.int64())),
                    pa.array([passages.ids[i] for i in items], to_arrow_type(item_type)),
                    pa.array(edits, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [row, "item_id", "edits", "start", "end"])

        out = out.union(docs.select(row, "text").mapInArrow(searched, schema))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """``docs`` (all columns) without those that contain a passage.

    Found rows are dropped in the pass that searches them, so nothing is joined or shuffled.
    """
    out = docs
    for block in passage_blocks(benchmark, **limits):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = finder(shared.value)
            for batch in slices(batches):
                found = {row for row, *_ in find(batch.column("text").to_pylist())}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(kept, docs.schema)
    return out


def find_leaks(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, start, end of all benchmark passages in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
