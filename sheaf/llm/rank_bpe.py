"""BPE encoding and decoding by contiguous rank arrays (operator 13).

A word is an array of parts and, beside it, an array with the rank of each adjacent pair. Over
and over the smallest rank is looked for (the leftmost among equals), its boundary is deleted,
both arrays close up, and only the two neighbouring ranks are looked up again, until no pair has
a rank. Words are short, so scanning a few adjacent numbers beats any queue; the new words of a
batch are rows of one matrix and take their steps together. A word above ``SHORT`` bytes would
make the scans quadratic and is merged with a queue instead, with the same result.

Each distinct word is merged once per worker as long as it is remembered. Text is split as the
tokenizer's file says: plain texts (see ``tokenize``) by blanks, and their pieces by the word
pattern; any other text is cut at special tokens, and normalised and split by the library's own
steps. Merging and decoding are done here. Decoding looks up the tokens of the ids; as the file
names no decoder, the tokens are joined by blanks.

Defined results: a null or empty text has no ids, and they decode to an empty text. Rows are
handled one by one, so ids that repeat or are null change nothing; an empty table gives no rows.
Texts and words of any length are encoded whole. Ids that name no token decode to nothing.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Tokenizer

from sheaf.llm.common import slices
from sheaf.llm.tokenize import UNUSUAL, WORDS, Known, byte_letters, gathered

SHORT = 64
NONE = np.int32(2**31 - 1)  # the rank of a pair that never merges


class Merges:
    """The merge table of a tokenizer's file, and words put together by it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inside = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + suffix] for x in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        self.tokens = {i: token.encode() for token, i in vocabulary.items()}
        self.tokens |= {i: token.encode() for token, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of parts; a part of -1 is no part."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.order[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The words (none empty) in a new order, as places in the list, all their ids in a row, and the number for each."""
        sizes = np.array([len(word) for word in words], np.int64)
        order, ids, counts, low = [], [], [], 0
        for width in (6, 10, 16, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(rows), 1 << 14):
                part = rows[at : at + (1 << 14)]
                merged = self._scan([words[row] for row in part.tolist()], sizes[part], width)
                order += part.tolist()
                ids.append(merged[merged >= 0])
                counts.append((merged >= 0).sum(axis=1))
        for row in np.flatnonzero(sizes > SHORT).tolist():
            order.append(row)
            ids.append(np.array(self.queued(words[row]), np.int32))
            counts.append([len(ids[-1])])
        return order, np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _scan(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """Words of at most ``width`` bytes: one matrix row each, a step of all in each round; -1 is no id."""
        final = np.full((len(words), width + 1), -1, np.int32)
        parts, rows = final.copy(), np.arange(len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        parts[:, :width][np.arange(width) < sizes[:, None]] = self.inside[flat]
        parts[rows, sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                final[rows[done], : parts.shape[1]] = parts[done]
                left = ~done
                rows, parts, ranks, at, best = rows[left], parts[left], ranks[left], at[left], best[left]
                if not len(rows):
                    return final
            column = at[:, None]
            parts[np.arange(len(rows)), at] = self.merged[best]
            # Delete the boundary behind the merged part, and its rank.
            parts = np.where(np.arange(parts.shape[1] - 1) > column, parts[:, 1:], parts[:, :-1])
            ranks = np.where(np.arange(ranks.shape[1] - 1) >= column, ranks[:, 1:], ranks[:, :-1])
            # Refresh the ranks on either side.
            before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            i = at[before]
            ranks[before, i - 1] = self.ranks(parts[before, i - 1], parts[before, i])
            i = at[behind]
            ranks[behind, i] = self.ranks(parts[behind, i], parts[behind, i + 1])

    def queued(self, word: bytes) -> list[int]:
        """The same for a long word, with the pairs in a queue by rank and place."""
        flat = np.frombuffer(word, np.uint8)
        parts = [*self.inside[flat[:-1]].tolist(), int(self.last[flat[-1]])]
        n, rank_of, merged = len(parts), self.rank_of, self.merged.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank_of.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j >= n or rank_of.get(parts[i] << 32 | parts[j]) != rank:
                continue  # the pair is no longer there
            parts[i], parts[j], after[i] = merged[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank_of.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(queue, (r, a))
        return [part for part in parts if part >= 0]


class RankEncoder:
    """Ids of texts; ``remember`` bounds the pieces that are known, of older ones those used again stay."""

    def __init__(self, path: str, remember: int = 1_000_000):
        self.merges = Merges(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or "(?!)")
        self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.remember = remember
        self.old, self.known = Known(), Known()

    def words(self, text: str) -> list[str | int]:
        """The words of any text, and the ids of its special tokens, as the library splits it."""
        found: list[str | int] = []
        at = 0
        for hit in chain(self.special.finditer(text), (None,)):
            part = text[at : hit.start()] if hit else text[at:]
            if part:
                for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    found.append(bytes(map(self.byte_of.__getitem__, word)).decode())
            if hit:
                found.append(self.merges.special[hit[0]])
                at = hit.end()
        return found

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = self.known
        first, last = len(known.starts) - 1, known.starts[-1]
        known.place.update(zip(keys, range(first, first + len(keys)), strict=True))
        known.ids.frombytes(ids.astype(np.int32).tobytes())
        known.starts.frombytes((last + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def carry(self, keys: list[str]) -> list[str]:
        """Keep what is known from before among ``keys``; the others are returned."""
        if not self.old.place:
            return keys
        places = np.fromiter(map(self.old.place.get, keys, repeat(-1)), np.int64, len(keys))
        again = np.flatnonzero(places >= 0).tolist()
        self.add([keys[i] for i in again], *gathered(self.old, places[again]))
        return [keys[i] for i in np.flatnonzero(places < 0).tolist()]

    def learn(self, pieces: list[str], whole: set[str]) -> None:
        """Make pieces known; their new words are merged together. Those in ``whole`` are one word."""
        place = self.known.place
        rest = self.carry(pieces)
        split = [[piece] if piece in whole or piece.isalpha() else WORDS.findall(piece) for piece in rest]
        new = self.carry(list({word for found in split for word in found if word not in place}))
        order, ids, sizes = self.merges.merge([word.encode() for word in new])
        self.add([new[i] for i in order], ids, sizes)
        several = [i for i, piece in enumerate(rest) if piece not in place]
        words = [word for i in several for word in split[i]]
        ids, sizes = gathered(self.known, np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        running = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum([len(split[i]) for i in several], dtype=np.int64)
        self.add([rest[i] for i in several], ids, np.diff(running[ends], prepend=0))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number for each text."""
        if len(self.known.place) > self.remember // 2:
            self.old, self.known = self.known, Known()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        marks: dict[int, int] = {}  # where a special token stands
        whole: set[str] = set()
        for row, text in enumerate(texts):
            before = len(pieces)
            if text and UNUSUAL.search(text):
                for word in self.words(text):
                    if isinstance(word, int):
                        marks[len(pieces)] = word
                        word = ""
                    pieces.append(word)
                    whole.add(word)
            elif text:
                pieces += text.lower().split()
            counts[row] = len(pieces) - before
        known = self.known
        places = np.fromiter(map(known.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            unknown = [pieces[i] for i in fresh.tolist()]
            self.learn(list({piece for piece in unknown if piece}), whole)
            known.place.setdefault("", known.add([]))
            places[fresh] = np.fromiter(map(known.place.__getitem__, unknown), np.int64, len(unknown))
        for i, token in marks.items():
            places[i] = known.add([token])
        ids, sizes = gathered(known, places)
        running = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(counts)
        return ids, running[ends] - running[ends - counts]

    def decode(self, ids: list[int]) -> bytes:
        """The tokens of ids, joined by blanks, in UTF-8."""
        tokens = self.merges.tokens
        try:
            return b" ".join(map(tokens.__getitem__, ids))
        except KeyError:
            return b" ".join([tokens[i] for i in ids if i in tokens])


_encoders: dict[str, RankEncoder] = {}


def encoder_for(path: str) -> RankEncoder:
    """A worker keeps its encoder, and the words that it knows, from task to task."""
    if path not in _encoders:
        _encoders[path] = RankEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of each row of ``docs`` (doc_id, text)."""
    schema = StructType([docs.schema["doc_id"]]).add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in slices(batches, 256):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(ids))], ["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of each row of ``rows`` (doc_id, ids)."""
    schema = StructType([rows.schema["doc_id"]]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in slices(batches, 256):
            texts = [encoder.decode(ids or []).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, and decoded again, in one pass."""
    schema = StructType([docs.schema["doc_id"]])
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in slices(batches, 256):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            view, found = memoryview(ids.astype("<u4").tobytes()), []
            for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                decoded = encoder.decode(ids[begin:end].tolist())
                found.append((hashlib.sha256(view[4 * begin : 4 * end]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *columns], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
