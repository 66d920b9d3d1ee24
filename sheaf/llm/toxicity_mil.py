"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences. Each sentence gets a probability from its words, and the
document's is their noisy-or, 1 - product(1 - p): one toxic sentence makes it toxic. Only
documents have labels; the gradient of the noisy-or passes the blame to the sentences that
explain them. A word's features are itself and its first letters. The same sentence scores then locate what is offending.

Training reads a bounded sample of labelled rows (``sample`` documents of each label, chosen
by a hash of the id, whole texts). Spark counts the documents of each label in which a word
occurs; the words and beginnings that tell the labels apart are the features: all whose
log-likelihood ratio would come about by chance in fewer than one of some ten thousand. Sentences
without such a word are only counted, and equal sentences of a document are merged, so that what
reaches the driver is bounded by the sample.

Defined results: a null or empty text has no sentence, score 0 and predicted 0. Without a
labelled row of each label nothing can be told apart, and all scores are 0. Several labels of
one id count as toxic if any is. Labels other than 0 and 1 and null labels are ignored.
Repeated rows are scored each. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import remainder, slices
from sheaf.session import stored

SENTENCE = regex.compile(r"[^.!?\n]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")


PREFIXES = (5, 7)
SIGNIFICANCE = 15.1  # twice the log-likelihood ratio; chi-squared with one degree reaches it in 1 of 10,000
REMEMBER = 300_000


def features(word: str) -> list[str]:
    """The word, and the beginnings it shares with its relatives."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclasses.dataclass
class SentenceModel:
    weights: dict[str, float]
    bias: float
    learned: bool = True
    values: dict[str, float | None] = dataclasses.field(default_factory=dict)

    def value(self, word: str) -> float | None:
        """What a word adds to a sentence; None if it has no known feature."""
        if word not in self.values:
            if len(self.values) > REMEMBER:
                self.values.clear()
            known = [self.weights[feature] for feature in features(word) if feature in self.weights]
            self.values[word] = sum(known) if known else None
        return self.values[word]

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a word."""
        for sentence in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(sentence[0].lower()))
            if words:
                total = self.bias + sum(self.value(word) or 0.0 for word in words)
                yield sentence.start(), sentence.end(), 1 / (1 + np.exp(-total))

    def score(self, text: str | None) -> float:
        if not self.learned:
            return 0.0
        clean, rest = 0, 0.0
        for sentence in SENTENCE.findall((text or "").lower()):
            words = set(WORD.findall(sentence))
            found = [value for value in map(self.value, words) if value is not None]
            if found:
                rest -= np.logaddexp(0, self.bias + sum(found))
            elif words:
                clean += 1
        return float(-np.expm1(rest - clean * np.logaddexp(0, self.bias)))


def fit(bags: list[tuple[int, int, list[list[int]]]], n_words: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, sentences without features, sentences of features).

    Maximises the likelihood of the labels, both weighing the same, less a ridge, by Adam.
    """
    label = np.array([bag[0] for bag in bags], np.float64)
    plain = np.array([bag[1] for bag in bags], np.float64)
    owner = np.repeat(np.arange(len(bags)), [len(bag[2]) for bag in bags])
    sentences = [words for bag in bags for words in bag[2]]
    row = np.repeat(np.arange(len(sentences)), [len(words) for words in sentences])
    column = np.array([word for words in sentences for word in words], np.int64)
    share = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max(len(label) - label.sum(), 1))
    theta = np.zeros(n_words + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        total = theta[-1] + np.bincount(row, theta[column], len(sentences))
        p, p0 = 1 / (1 + np.exp(-total)), 1 / (1 + np.exp(-theta[-1]))
        # log of the probability that no sentence is toxic
        none = plain * np.log1p(-p0) + np.bincount(owner, -np.logaddexp(0, total), len(bags))
        none = np.minimum(none, -1e-9)
        # d(likelihood) / d(none): -1 for clean documents' sign, exp(none) / (1 - exp(none)) for toxic ones
        pull = share * np.where(label > 0, -1 / np.expm1(-none), 1.0)
        d_total = -pull[owner] * p
        gradient = np.append(
            np.bincount(column, d_total[row], n_words), d_total.sum() - (pull * plain).sum() * p0
        ) - np.append(1e-4 * theta[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, significance: float = SIGNIFICANCE, min_docs: int = 5
) -> SentenceModel:
    """Fit on ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1."""
    spark = docs.sparkSession
    marked = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {row["toxic"]: row["count"] for row in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return SentenceModel({}, 0.0, learned=False)
    drawn = F.pmod(F.xxhash64(F.lit("toxic sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    # About ``sample`` ids for each label: bounded, whatever the number of documents.
    chosen = marked.filter(drawn < share)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    known = stored(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = sorted({feature for word in set(WORD.findall(text.lower())) for feature in features(word)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), toxic, np.int32)), pa.array(words, pa.string())], ["toxic", "word"]
                )

    totals = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return SentenceModel({}, 0.0, learned=False)
    counts = (
        known.mapInArrow(seen, "toxic int, word string")
        .groupBy("word")
        .agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
        .filter(F.col("a") + F.col("b") >= min_docs)
    )
    n1, n0 = float(totals[1]), float(totals[0])

    def part(seen_in, expected):  # of the log-likelihood ratio
        return F.when(seen_in > 0, seen_in * F.log(seen_in / expected)).otherwise(0.0)

    rate = (F.col("a") + F.col("b")) / (n1 + n0)
    ratio = (
        part(F.col("a"), rate * n1) + part(F.col("b"), rate * n0)
        + part(n1 - F.col("a"), (1 - rate) * n1) + part(n0 - F.col("b"), (1 - rate) * n0)
    )
    words = sorted(row["word"] for row in counts.filter(2 * ratio >= significance).select("word").collect())
    place = {word: i for i, word in enumerate(words)}

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            plain, bags = [], []
            for text in batch.column("text").to_pylist():
                found = [set(WORD.findall(sentence)) for sentence in SENTENCE.findall(text.lower())]
                known = [
                    tuple(sorted(place[feature] for word in words for feature in features(word) if feature in place))
                    for words in found
                    if words
                ]
                plain.append(sum(1 for words in known if not words))
                bags.append(sorted(map(list, {words for words in known if words})))
            arrays = [batch.column("toxic"), pa.array(plain, pa.int64()), pa.array(bags, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "plain", "bags"])

    rows = known.mapInArrow(bagged, "toxic int, plain long, bags array<array<int>>").collect()
    weights, bias = fit(sorted((row["toxic"], row["plain"], row["bags"]) for row in rows), len(words))
    return SentenceModel({word: float(weight) for word, weight in zip(words, weights, strict=True)}, bias)


def scored(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """doc_id, score of every document; reads nothing but text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [shared.value.score(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    ids = docs.select("doc_id", "text")
    return ids.mapInArrow(run, ids.select("doc_id").schema.add("score", "double"))


def offending(docs: DataFrame, model: SentenceModel, at_least: float = 0.5) -> DataFrame:
    """doc_id and its sentences with that probability: start and end (code points), score, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [
                [
                    {"start": i, "end": j, "score": float(p), "text": text[i:j]}
                    for i, j, p in shared.value.sentences(text)
                    if shared.value.learned and p >= at_least
                ]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    ids = docs.select("doc_id", "text")
    schema = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, "
    return ids.mapInArrow(run, schema + "spans array<struct<start: long, end: long, score: double, text: string>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are not used."""
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = learn(docs.filter(~held_out), labels.filter(~held_out))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)
