import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import terms
from sheaf.operators import embed, vectors
from sheaf.settings import EmbedKnobs

RNG = np.random.default_rng(3)


def frame(spark, matrix, name):
    rows = [(f"{i:04d}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} string, embedding array<float>")


def brute_force(corpus, asked, k):
    out = {}
    for q, question in enumerate(asked):
        scored = []
        for i, row in enumerate(corpus):
            a, b = np.float32(row).astype(float), np.float32(question).astype(float)
            scale = np.linalg.norm(a) * np.linalg.norm(b)
            if scale > 0:
                scored.append((round(1 - a @ b / scale, 9) + 0.0, f"{i:04d}"))
        out[f"{q:04d}"] = sorted(scored)[:k]
    return out


def collected(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.chunk_id))
    return out


@pytest.fixture(scope="module")
def matrices():
    corpus = RNG.normal(size=(300, 8))
    corpus[40:140] = corpus[40]  # a third of the rows are copies of one vector
    corpus[5] = 0
    asked = np.vstack([RNG.normal(size=(11, 8)), corpus[40]])
    return corpus, asked


def test_topk_matches_brute_force(spark, matrices):
    corpus, asked = matrices
    rows = frame(spark, corpus, "chunk_id").repartition(5)
    found = collected(vectors.vector_topk(rows, frame(spark, asked, "query_id"), 7))
    expected = brute_force(corpus, asked, 7)
    for q in expected:
        assert [i for _, i in found[q]] == [i for _, i in expected[q]]
        assert np.allclose([d for d, _ in found[q]], [d for d, _ in expected[q]], atol=1e-8)


def test_many_questions_take_several_passes(spark, matrices, monkeypatch):
    corpus, asked = matrices
    rows, questions = frame(spark, corpus, "chunk_id"), frame(spark, asked, "query_id")
    whole = collected(vectors.vector_topk(rows, questions, 5))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 8 * 8 * 3)
    assert collected(vectors.vector_topk(rows, questions, 5)) == whole


def test_small_score_steps_change_nothing(matrices):
    corpus, asked = matrices
    import pyarrow as pa

    unit, directed = vectors._unit(corpus)
    questions = vectors._unit(asked)[0]
    ids = pa.array([f"{i:04d}" for i in range(len(corpus))])
    tables = []
    for step in (300, 13):
        best = vectors._Best(len(asked), 4)
        best.limit = 50
        for at in range(0, len(corpus), step):
            inside = np.flatnonzero(directed[at : at + step])
            best.offer(np.arange(len(asked)), inside, questions, unit[at : at + step], ids.slice(at, step))
        tables.append(best.finish().to_pydict())
    assert tables[0]["chunk_id"] == tables[1]["chunk_id"]


def test_zero_questions_and_empty_sets(spark, matrices):
    corpus, _ = matrices
    rows = frame(spark, corpus, "chunk_id")
    assert vectors.vector_topk(rows, frame(spark, np.zeros((2, 8)), "query_id"), 3).count() == 0


def test_wrong_width_is_an_error(spark, matrices):
    rows = frame(spark, matrices[0], "chunk_id")
    with pytest.raises(Exception, match="width mismatch"):
        vectors.vector_topk(rows, frame(spark, np.ones((1, 5)), "query_id"), 3).collect()


def test_all_cells_equal_exact_search(spark, matrices, tmp_path):
    corpus, asked = matrices
    rows, questions = frame(spark, corpus, "chunk_id"), frame(spark, asked, "query_id")
    centroids = vectors.train_cells(rows, 6)
    cells = vectors.assign_cells(rows, centroids)
    vectors.write_cells(cells, str(tmp_path / "cells"), rows_per_file=20)
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 300
    exact = vectors.vector_topk(rows, questions, 5)
    every = vectors.vector_topk_cells(stored, centroids, questions, 5, 6)
    assert collected(every) == collected(exact)
    some = vectors.vector_topk_cells(stored, centroids, questions, 5, 2)
    shares = {r.query_id: r.recall for r in vectors.recall(some, exact).collect()}
    assert len(shares) == len(asked) and 0.2 < np.mean(list(shares.values())) <= 1
    few = vectors.vector_topk_cells(stored, centroids, questions.limit(1), 5, 2)
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors(spark):
    texts = ["Cats and the cat", "", "the of and", "dogs dog DOG cat", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in rows.select("i", embed.hashed_vector(F.col("t"), 16).alias("v")).collect()}
    cat, dog = embed.bucket_of("cat", 16), embed.bucket_of("dog", 16)
    assert got[0][cat] == 1.0 and sum(got[0]) == 1.0
    assert not any(got[1]) and not any(got[2]) and not any(got[4])
    if cat != dog:
        assert np.isclose(got[3][dog], 3 / np.sqrt(10)) and np.isclose(got[3][cat], 1 / np.sqrt(10))
    assert terms.stem_word("dogs") == "dog"


def test_model_batches_and_failures(spark):
    knobs = EmbedKnobs(dim=2, batch_size=3, attempts=1)

    def model(texts):
        assert len(texts) <= 3
        if "poison" in texts:
            raise ValueError("poison")
        return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(t,) for t in ["a", "bb", "poison", "dddd", "e"]], "t string").coalesce(1)
    lenient = rows.select("t", embed.model_vector(F.col("t"), model, knobs, strict=False).alias("v"))
    got = {r.t: r.v for r in lenient.collect()}
    assert got == {"a": [1, 1], "bb": [2, 1], "poison": None, "dddd": [4, 1], "e": [1, 1]}
    with pytest.raises(Exception, match="poison"):
        rows.select(embed.model_vector(F.col("t"), model, knobs)).collect()
    with pytest.raises(Exception, match="shape mismatch"):
        rows.select(embed.model_vector(F.col("t"), lambda t: [[1]] * len(t), knobs)).collect()


def test_retry_waits_grow():
    waits, calls = [], []

    def model(texts):
        calls.append(texts)
        if len(calls) < 4:
            raise IOError("busy")
        return "done"

    assert embed.call_with_retry(model, ["x"], EmbedKnobs(), waits.append) == "done"
    assert waits == [2, 4, 8]
    calls.clear()
    with pytest.raises(IOError):
        embed.call_with_retry(lambda t: (_ for _ in ()).throw(IOError()), ["x"], EmbedKnobs(), waits.append)
