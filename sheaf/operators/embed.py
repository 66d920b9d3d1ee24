"""Texts to fixed-width vectors: hashed terms by default, or a caller's model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import terms
from sheaf.schemas import EMBEDDING
from sheaf.settings import EmbedKnobs


def hashed_vector(text_col, dim: int = EmbedKnobs.dim) -> Column:
    """Count the terms of a text in ``dim`` hash buckets, scaled to unit length.

    Words are cut in the JVM. Each Arrow batch then normalises and hashes its
    distinct words once and counts all its rows together, so the operator is a
    single pass without a shuffle. A text without terms gives a zero vector.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = _bucket_counts(batch, dim)
            lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            yield _as_lists(counts / np.where(lengths > 0, lengths, 1.0))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, EMBEDDING)(terms.words(text_col))


def bucket_of(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def _bucket_counts(word_lists: pa.Array, dim: int) -> np.ndarray:
    words = word_lists.flatten().dictionary_encode()
    rows = word_lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(rows)), rows)
    buckets = np.full(max(len(words.dictionary), 1), -1)
    stop_words = frozenset(terms.STOP_WORDS)
    for i, word in enumerate(words.dictionary.to_pylist()):
        if word not in stop_words:
            buckets[i] = bucket_of(terms.stem_word(word), dim)
    bucket = buckets[words.indices.to_numpy(zero_copy_only=False)]
    used = bucket >= 0
    flat = np.bincount(row_of[used] * dim + bucket[used], minlength=len(rows) * dim)
    return flat.reshape(len(rows), dim).astype(np.float64)


def model_vector(
    text_col,
    model: Callable[[list[str]], list],
    knobs: EmbedKnobs = EmbedKnobs(),
    strict: bool = True,
) -> Column:
    """Vectors from ``model``, called with at most ``batch_size`` texts at a time.

    A failing call is tried ``attempts`` times with growing waits. After that the
    task fails, or, if not ``strict``, each text of the batch is tried alone and
    those that still fail give null. A wrong number or width of vectors counts as
    a failure of the call.
    """

    def call(texts):
        found = np.asarray(model(texts), dtype=np.float64)
        if found.shape != (len(texts), knobs.dim):
            raise ValueError(
                f"embedding shape mismatch: got {found.shape}, expected {(len(texts), knobs.dim)}"
            )
        return list(found.astype(np.float32))

    def alone(text):
        try:
            return call([text])[0]
        except Exception:
            return None

    def vectors(texts):
        try:
            return call_with_retry(call, texts, knobs)
        except Exception:
            if strict:
                raise
            return [alone(text) for text in texts]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, found = batch.to_pylist(), []
            for i in range(0, len(texts), knobs.batch_size):
                found += vectors(texts[i : i + knobs.batch_size])
            yield pa.array(found, pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, EMBEDDING)(text_col)


def call_with_retry(model, texts, knobs: EmbedKnobs, sleep=time.sleep):
    for attempt in range(1, knobs.attempts + 1):
        try:
            return model(texts)
        except Exception:
            if attempt == knobs.attempts:
                raise
            sleep(knobs.wait_base**attempt)


def _as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))
