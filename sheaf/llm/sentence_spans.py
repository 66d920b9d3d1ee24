"""Substring dedup by sliding sentence spans (operator 7).

A text is cut into sentences, and these into parts of at most ``WINDOW`` words. From every part
on, a span runs over several consecutive parts: at least two of them and at least ``words``
words. Each span is hashed. A span that occurs in several documents belongs to the one with the
smallest doc_id; in all others its sentences are removed, part by part, and so are those of its
later occurrences within a document, which need no join.

Sentences end at line breaks and after full stops, exclamation or question marks that white
space follows. They are parted after words whose hash, with the next word's, is the smallest of
some ``WINDOW`` neighbouring ones. So cuts depend on a few words around them only, and a passage is cut
alike wherever it stands, but for at most WINDOW words at each end: a repeated passage of
``words`` + 3 WINDOW - 1 words (49) or more always holds a whole span and loses it. Up to WINDOW
words of it may stay at either end. Words are what ASCII white space parts, compared in lower case.

The spans of all documents are shuffled once, with the smallest and largest id combined on the
map side, and only those seen in two documents or more are kept. A bitmap of their hashes, of a
fixed size, goes to every task; in a second pass a task hands on the spans that it lets through,
which are joined with the kept ones. A span that a third of all documents share is one row on
its side, and adaptive execution splits the other. Lists are collected per row only.

Defined results: null texts stay null, empty texts stay; a text with fewer than ``words`` words
or two parts has no span. ``n_sentences`` counts a text's sentences, ``n_removed`` those that lose
words, in whole or in part. Rows with a null doc_id are left as they are and don't count; rows
that share an id are one document, of which none is removed for the others' sake. doc_id may have
any type that can be ordered. Equal passages go to the smallest id. Texts of any length are
handled whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.llm.common import scrambled, slices, with_row_key
from sheaf.session import stored

TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")  # a word
WORDS, WINDOW = 20, 10
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SKETCH = 1 << 27  # bits of the bitmap
PAGE = 1 << 15  # bits of a row of it
PIECE = 1 << 20  # characters hashed at once, and those up to the next white space
_SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_STOPS = np.isin(np.arange(256), list(b".!?"))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers = tuple(
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64)))) for base in (BASE, INVERSE)
        )
    return _powers


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of every ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and hash of each word, and whether a sentence ends with it. Short texts are read together."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    rows, held, size = [], [], 0

    def read() -> None:
        if rows:
            hashes, ends, first = _words_of_bytes(b"\n".join(held))
            ends[-1:] = True
            behind = np.cumsum([len(data) + 1 for data in held])
            found.append((np.array(rows)[np.searchsorted(behind, first, "right")], hashes, ends))

    for row, text in enumerate(texts):
        if not text:
            continue
        if size + len(text) > PIECE:
            read()
            rows, held, size = [], [], 0
        if len(text) > PIECE:
            hashes, ends = _words_of_long(text)
            found.append((np.full(len(hashes), row), hashes, ends))
        else:
            rows.append(row)
            held.append(encoded(text))
            size += len(text)
    read()
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


def _words_of_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece by piece, each cut at white space."""
    found, at = [], 0
    while at < len(text):
        cut = TOKEN.match(text, at + PIECE - 1) if at + PIECE < len(text) else None
        end = cut.end() if cut else min(at + PIECE, len(text))
        hashes, ends, _ = _words_of_bytes(encoded(text[at:end]))
        if len(ends):
            behind = TOKEN.search(text, end)
            ends[-1] |= behind is None or "\n" in text[end : behind.start()]
            found.append((hashes, ends))
        at = end
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, bool))


def _words_of_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, sentence end and first byte of each word.

    A hash is the word's share of the sums of powers over all bytes, moved to power 0.
    """
    flat = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACES[flat], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    up, down = powers(len(flat))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * up[: len(flat)])))
    hashes = scrambled((sums[end] - sums[first]) * down[first])
    lines = np.searchsorted(np.flatnonzero(flat == 10), np.append(first, len(flat)))
    return hashes, _STOPS[flat[end - 1]] | (lines[1:] > lines[:-1]), first


@dataclasses.dataclass
class Parts:
    """The parts of some texts, one text after the other, and the spans that begin with them."""

    row: np.ndarray  # the text of each part
    starts: np.ndarray  # its first word in its text
    ends: np.ndarray
    sentence: np.ndarray  # number of its sentence among all
    n_sentences: np.ndarray  # of each text
    spans: np.ndarray  # hash of the span from each part on
    last: np.ndarray  # the part behind the span; 0 if there is no span

    @classmethod
    def of(cls, texts: list[str | None], words: int = WORDS) -> Parts:
        owner, hashes, sentence_ends = words_of(texts)
        n = len(hashes)
        n_sentences = np.bincount(owner[sentence_ends], minlength=len(texts))
        if not n:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none, n_sentences, np.zeros(0, np.uint64), none)
        cuts = sentence_ends.copy()
        pairs = scrambled(hashes[:-1] * np.uint64(BASE) + hashes[1:])
        if len(pairs) >= WINDOW:
            least = sliding(pairs, WINDOW, np.minimum)
            least[owner[:-WINDOW] != owner[WINDOW:]] = 0  # no window reaches into another text
            edge = np.zeros(WINDOW - 1, np.uint64)
            cuts[:-1] |= sliding(np.concatenate((edge, least, edge)), WINDOW, np.maximum) == pairs
        ends = np.flatnonzero(cuts) + 1
        starts = np.concatenate(([0], ends[:-1]))
        row = owner[starts]
        last = np.maximum(np.searchsorted(ends, starts + words) + 1, np.arange(len(ends)) + 2)
        whole = last <= len(ends)
        whole[whole] = row[last[whole] - 1] == row[whole]
        last[~whole] = 0
        up, down = powers(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])))
        spans = scrambled((sums[ends[last - 1]] - sums[starts]) * down[starts])
        sentence = (np.cumsum(sentence_ends) - sentence_ends)[starts]
        before = np.searchsorted(owner, row)
        return cls(row, starts - before, ends - before, sentence, n_sentences, spans, last)

    def repeats(self) -> np.ndarray:
        """Which spans are later occurrences of one in the same text."""
        at = np.flatnonzero(self.last)
        order = at[np.lexsort((self.spans[at], self.row[at]))]  # stable: of equal ones the first stays first
        same = (self.spans[order[1:]] == self.spans[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])
        later = np.zeros(len(self.spans), bool)
        later[order[1:][same]] = True
        return later

    def among(self, row: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Which spans are among the given ones of their row."""
        key = lambda row, spans: scrambled(spans ^ row.astype(np.uint64) * np.uint64(BASE))
        return np.isin(key(self.row, self.spans), key(row, spans)) & (self.last > 0)

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """Which parts lie in a chosen span."""
        steps = np.zeros(len(self.ends) + 1, np.int64)
        at = np.flatnonzero(chosen & (self.last > 0))
        np.add.at(steps, at, 1)
        np.add.at(steps, self.last[at], -1)
        return np.cumsum(steps[:-1]) > 0


def cut(text: str, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """The text without the parts that are ``gone``, and the white space behind them."""
    begins = [match.start() for match in TOKEN.finditer(text)] + [len(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2)
    out, at = [], 0
    for first, end in edges.tolist():
        out.append(text[at : begins[starts[first]]])
        at = begins[ends[end - 1]]
    return "".join(out) + text[at:]


def span_rows(docs: DataFrame, keep: list[str], words: int, sketch=None) -> DataFrame:
    """The columns ``keep`` with each span of a row; with a ``sketch``, only those that it lets through."""
    schema = StructType([docs.schema[name] for name in keep]).add("span", "long")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            parts = Parts.of(batch.column("text").to_pylist(), words)
            chosen = parts.last > 0
            if sketch is not None:
                place = parts.spans & np.uint64(SKETCH - 1)
                bits = sketch.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
                chosen &= (bits & 1).astype(bool)
            owner = pa.array(parts.row[chosen])
            columns = [*(batch.column(name).take(owner) for name in keep), pa.array(parts.spans[chosen].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "span"])

    return docs.select(*keep, "text").mapInArrow(listed, schema)


def bitmap(shared: DataFrame) -> np.ndarray:
    """The hashes of ``shared`` (span) as bits; SKETCH / 8 bytes, whatever their number."""
    place = F.col("span").bitwiseAND(F.lit(SKETCH - 1))
    pages = shared.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(F.lit(PAGE - 1)).alias("bit"))
    out = np.zeros(SKETCH // 8, np.uint8)
    for row in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = row["page"] * PAGE // 8
        out[at : at + PAGE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def repeated(rows: DataFrame, words: int) -> DataFrame:
    """row, spans: the spans of each row (row, doc_id, text) that belong to a smaller doc_id."""
    named = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = span_rows(named, ["doc_id"], words).groupBy("span").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = stored(ids.filter("first < last").select("span", "first"), "shared")
    sketch = rows.sparkSession.sparkContext.broadcast(bitmap(shared))
    found = span_rows(named, ["row", "doc_id"], words, sketch)
    return found.join(shared, "span").filter("doc_id > first").groupBy("row").agg(F.collect_set("span").alias("spans"))


def dedupe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text without repeated spans, of every document."""
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    joined = rows.join(stored(repeated(rows, words), "repeated"), "row", "left").select("doc_id", "text", "spans")
    schema = StructType([docs.schema["doc_id"]])
    schema = schema.add("n_sentences", "integer").add("n_removed", "integer").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            ids, texts, lists = (batch.column(name) for name in ("doc_id", "text", "spans"))
            texts = texts.to_pylist()
            parts = Parts.of(texts, words)
            found = np.array(lists.flatten(), np.int64).view(np.uint64)
            owner = np.repeat(np.arange(len(texts)), np.array(lists.value_lengths().fill_null(0), np.int64))
            named = np.array(ids.is_valid())
            gone = parts.covered((parts.repeats() | parts.among(owner, found)) & named[parts.row])
            first = np.searchsorted(parts.row, np.arange(len(texts) + 1))
            removed = np.zeros(len(texts), np.int64)
            for row in np.unique(parts.row[gone]).tolist():
                own = slice(first[row], first[row + 1])
                removed[row] = len(np.unique(parts.sentence[own][gone[own]]))
                texts[row] = cut(texts[row], parts.starts[own], parts.ends[own], gone[own])
            arrays = [pa.array(parts.n_sentences, pa.int32()), pa.array(removed, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([ids, *arrays], schema.names)

    return joined.mapInArrow(run, schema)
