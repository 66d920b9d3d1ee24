"""Token ids of whole texts by a public tokenizer's file, with each distinct word encoded once.

The tokenizers library splits a text into words, never across blanks, and encodes each word on
its own, so the ids of a text are those of its words in a row. For plain texts (Latin letters,
ASCII signs, ordinary blanks: where lower-casing and splitting are the same in either library)
the pieces between blanks are looked up, a new piece is put together from its words, and only
new words go to the library's model, which merges them, as the bytes that its first steps would
make of them; any other text goes to the library as a whole.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# Fixed: the word pattern in the tokenizer's own file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
UNUSUAL = regex.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]|<\\|")
# Texts that are not plain, for Arrow, which lower-cases U+0130 to one letter and the library to two.
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"

ENDS = (".", ",", ";", ":", "!", "?")


def words_of(piece: str) -> list[str]:
    if piece[-1:] in ENDS and piece[:-1].isalpha():
        return [piece[:-1], piece[-1]]  # the same, sooner
    return WORDS.findall(piece)


class Known:
    """Ids by piece, in one flat array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])
        self.chars = 0  # of the pieces of ``add_all``

    def add(self, ids) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def add_all(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces with all their ids in a row, and the number for each."""
        first, last = len(self.starts) - 1, self.starts[-1]
        self.chars += sum(map(len, pieces))
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.starts.frombytes((last + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def find(self, pieces: list[str] | np.ndarray) -> np.ndarray:
        """Their places, -1 for what is not known."""
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))


def gathered(known: Known, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of known pieces in a row, and the number for each."""
    starts, ids = np.asarray(known.starts), np.asarray(known.ids)  # views, gone when the next piece is added
    begin = starts[places]
    sizes = starts[places + 1] - begin
    before = np.cumsum(sizes) - sizes
    return ids[np.repeat(begin - before, sizes) + np.arange(sizes.sum())], sizes


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordEncoder:
    """``remember`` (pieces) and ``chars`` bound what is known; of older pieces those used again are kept."""

    def __init__(self, path: str, remember: int = 1_000_000, chars: int = 32 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.remember, self.chars = remember, chars
        self.old, self.known = Known(), Known()

    def carry(self, pieces: list[str]) -> list[str]:
        """Keep what is known from before among ``pieces``; the others are returned."""
        if not self.old.place:
            return pieces
        places = self.old.find(pieces)
        again = np.flatnonzero(places >= 0)
        self.known.add_all([pieces[i] for i in again.tolist()], *gathered(self.old, places[again]))
        return [pieces[i] for i in np.flatnonzero(places < 0).tolist()]

    def learn(self, pieces: list[str]) -> None:
        """Make pieces known; words that are new are encoded."""
        known = self.known
        rest = self.carry(pieces)
        several = [piece for piece in rest if not piece.isalpha()]
        split = [words_of(piece) for piece in several]
        words = {word for found in split for word in found}.difference(rest)
        alone = [piece for piece, found in zip(several, split, strict=True) if len(found) == 1]
        new = [piece for piece in rest if piece.isalpha()] + alone
        new += self.carry([word for word in words if word not in known.place])
        ids, sizes = [], []
        for word in new:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            found = [token.id for token in self.model.tokenize(word)]
            ids += found
            sizes.append(len(found))
        known.add_all(new, np.array(ids, np.int32), np.array(sizes, np.int64))
        split = [found for found in split if len(found) != 1]
        ids, sizes = gathered(known, known.find([word for found in split for word in found]))
        running = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum([len(found) for found in split], dtype=np.int64)
        known.add_all([piece for piece in several if piece not in known.place], ids, np.diff(running[ends], prepend=0))

    def encode(self, texts: pa.Array | list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by ``end_id``, and the number for each text."""
        if len(self.known.place) > self.remember // 2 or self.known.chars > self.chars // 2:
            self.old, self.known = self.known, Known()
        known = self.known
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, NOT_PLAIN))
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(plain)))
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        places = known.find(distinct)
        fresh = np.flatnonzero(places < 0)
        self.learn(distinct[fresh].tolist())
        places[fresh] = known.find(distinct[fresh])
        ids, sizes = gathered(known, places)
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), ids).take(pieces.indices)
        ids, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        ends = bounds[np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)]
        found = iter(np.split(ids, ends))
        whole = iter(texts.filter(pc.invert(plain)).to_pylist())
        end, parts = np.array([end_id], np.int32), []
        for simple in plain.to_pylist():
            if simple:
                parts += [next(found), end]
            else:
                parts += [np.array(self.tokenizer.encode(next(whole), add_special_tokens=False).ids, np.int32), end]
        counts = np.array([len(part) + 1 for part in parts[::2]], np.int64)
        return np.concatenate([np.zeros(0, np.int32), *parts]), counts
