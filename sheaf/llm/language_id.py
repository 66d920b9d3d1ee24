"""Language identification by bit-sliced Bloom filters of character n-grams (operator 1).

Every slot of the filter holds one bit per language. A lookup of an n-gram ands the slots
of its hash positions and so returns all languages that contain it at once. A text's
n-grams are counted per language; the share that a language's filter would claim by
chance, (fill of its slice) ** hashes, is taken out of its count, and the largest corrected
share wins.

An n-gram enters the filters of those languages in which it is at least ``rival_share``
times as frequent as in the language that uses it most, and in which the sample holds it
``min_count`` times or more, so that its rate is no chance. The filter is sized by what passes.

Defined results: a null text, an empty text or one without a letter is ``und`` with score 0;
so is every text if nothing could be learned (no labelled row with a letter). A text whose
n-grams no language knows gets the language with most training rows, score 0. Equal shares
go to the language with more training rows, then to the smaller name. Texts of any length are
read whole, in pieces. Repeated rows are predicted one by one. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import char_blocks, code_points, remainder, scrambled, slices

UNKNOWN = "und"
SIZES = (3, 4)
HASHES = 3
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x40000):  # no letters are assigned above
            char = chr(code)
            if char.isalpha():
                small = char.lower()
                table[code] = ord(small) if len(small) == 1 else code
        _letters = table
    return _letters


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the pieces, the piece of each, and each piece's letter count.

    Runs of other characters count as one word boundary; a piece begins and ends with one.
    """
    codes = letters()[code_points("".join(f"\n{piece}\n" for piece in pieces))]
    owner = np.repeat(np.arange(len(pieces)), [len(piece) + 2 for piece in pieces])
    n_letters = np.bincount(owner[codes > 0], minlength=len(pieces))
    keep = codes > 0
    keep[1:] |= (codes[:-1] > 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for size in SIZES:
        if len(codes) < size:
            continue
        n = len(codes) - size + 1
        mixed = np.full(n, size, np.uint64)
        for i in range(size):
            mixed = mixed * np.uint64(0x100000001B3) + codes[i : i + n]
        whole = owner[:n] == owner[size - 1 :]
        hashes.append(scrambled(mixed[whole]))
        owners.append(owner[:n][whole])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(hashes), np.concatenate(owners), n_letters


@dataclasses.dataclass
class LanguageFilter:
    """``slots[w, i]``: bits of languages 64w to 64w+63 in slot i. ``chance``: false positives."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> LanguageFilter:
        most = max([1, *map(len, members)])
        slots = np.zeros(((len(languages) + 63) // 64, 1 << max(10, (most * 12).bit_length())), np.uint64)
        chance = np.zeros(len(languages))
        for i, hashes in enumerate(members):
            bit = np.uint64(1) << np.uint64(i % 64)
            for place in cls.places(hashes, slots.shape[1]):
                slots[i // 64, place] |= bit
            chance[i] = np.mean((slots[i // 64] & bit) > 0) ** HASHES
        return cls(languages, slots, chance)

    @staticmethod
    def places(hashes: np.ndarray, n_slots: int) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & np.uint64(n_slots - 1)).astype(np.int64) for i in range(HASHES)]

    def count(self, hashes: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
        """Per owner and language, the number of n-grams its filter contains."""
        found = np.zeros((n_owners, len(self.languages)))
        places = self.places(hashes, self.slots.shape[1])
        for w, row in enumerate(self.slots):
            bits = row[places[0]]
            for place in places[1:]:
                bits &= row[place]
            hit = np.flatnonzero(bits)
            bits, of = bits[hit], owner[hit]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                has = (bits >> np.uint64(i % 64)) & np.uint64(1)
                found[:, i] += np.bincount(of, weights=has, minlength=n_owners)
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, [0.0] * n
        found, total, n_letters = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n)
        for block in char_blocks(texts):
            rows = np.array([row for row, _, _ in block])
            hashes, owner, in_piece = grams([piece for _, _, piece in block])
            np.add.at(found, rows, self.count(hashes, owner, len(rows)))
            np.add.at(total, rows, np.bincount(owner, minlength=len(rows)))
            np.add.at(n_letters, rows, in_piece)
        share = found / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        names = [self.languages[i] if k else UNKNOWN for i, k in zip(best, n_letters, strict=True)]
        scores = np.where(n_letters > 0, share[np.arange(n), best], 0.0)
        return names, scores.tolist()


def learn(docs: DataFrame, **limits) -> LanguageFilter:
    """The filters of the n-grams that ``docs`` (doc_id, text, lang) teaches."""
    return LanguageFilter.build(*members(docs, **limits))


def members(
    docs: DataFrame, sample_per_language: int = 3000, min_count: int = 5, rival_share: float = 0.25
) -> tuple[list[str], list[np.ndarray]]:
    """The languages, those with most rows first, and the hashes of the n-grams of each.

    Learned from rows of ``docs`` with a language: a sample, chosen by a hash of the id, of about
    ``sample_per_language`` per language, read whole. What reaches the driver is bounded by it.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()  # one row per language
    sizes.sort(key=lambda row: (-row["count"], row["lang"]))
    languages = [row["lang"] for row in sizes]
    if not languages:
        return [], []
    spark = docs.sparkSession
    shares = [(row["lang"], i, sample_per_language / row["count"]) for i, row in enumerate(sizes)]
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(
        F.broadcast(spark.createDataFrame(shares, "lang string, language int, share double")), "lang"
    ).filter(drawn < F.col("share"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            language = np.array(batch.column("language"))
            for block in char_blocks(batch.column("text").to_pylist()):
                hashes, owner, _ = grams([piece for _, _, piece in block])
                of = language[np.array([row for row, _, _ in block])][owner]
                for i in np.unique(of):
                    values, counts = np.unique(hashes[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), i, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)],
                        ["language", "gram", "n"],
                    )

    counts = (
        sample.select("language", "text")
        .mapInArrow(counted, "language int, gram long, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rivals = Window.partitionBy("gram")  # a row per language at most
    size = counts.groupBy("language").agg(F.sum("n").alias("total"))
    chosen = (
        counts.join(F.broadcast(size), "language")  # one row per language
        .withColumn("rate", F.col("n") / F.col("total"))
        .withColumn("top", F.max("rate").over(rivals))
        .filter((F.col("n") >= min_count) & (F.col("rate") >= rival_share * F.col("top")))
        .select("language", "gram")
        .toPandas()
    )
    by_language = dict(tuple(chosen.groupby("language")["gram"]))
    empty = np.zeros(0, np.int64)
    return languages, [np.asarray(by_language.get(i, empty), np.int64).view(np.uint64) for i in range(len(languages))]


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score of every document; reads nothing but text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text")
    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            arrays = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(scored, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from rows not held out."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = learn(docs.filter(~held_out))
    scored = predict(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.2) -> DataFrame:
    """The documents in a language that the rows' own labels teach, with all their columns.

    Rejected are texts without a letter and those whose best corrected share is below
    ``min_score``. Learns from all labelled rows; prediction reads only text. If no row has
    a label, nothing can be told apart and the documents with a letter stay.
    """
    model = learn(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            known = [name != UNKNOWN and score >= min_score for name, score in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
