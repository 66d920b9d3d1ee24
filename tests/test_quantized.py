"""Search by residual product codes: recall, calibration, narrow scans, hot cells."""

import numpy as np
import pytest

from sheaf.operators import quantized, vectors

K = 10


def clustered(n=1500, width=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, width))
    return (centres[rng.integers(0, 9, n)] + rng.normal(0, 0.4, (n, width))).astype(np.float32)


def frame(spark, data, key="chunk_id", first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = frame(spark, clustered())
    codec = quantized.train_codec(rows, 12, parts=8, codes=32, rounds=4)
    path = str(tmp_path_factory.mktemp("codes") / "index")
    vectors.write_cells(quantized.encode(rows, codec), path)
    return spark.read.parquet(path), codec


def test_calibrated_search_reaches_its_target(spark, trained):
    index, codec = trained
    n_probe, depth = quantized.calibrate(index, codec, K, 0.95, sample=60)
    assert 1 <= n_probe <= 12 and K <= depth <= 50 * K
    questions = frame(spark, clustered(60, seed=5), "query_id", 5000)
    found = quantized.topk_quantized(index, codec, questions, K, n_probe, depth).cache()
    exact = vectors.vector_topk(index, questions, K).cache()
    recall = [r.recall for r in vectors.recall(found, exact).collect()]
    assert np.mean(recall) >= 0.93 and len(recall) == 60
    # Distances of found rows are the exact ones, and ranks are theirs.
    want = {(r.query_id, r.chunk_id): r.distance for r in exact.collect()}
    for r in found.collect():
        if (r.query_id, r.chunk_id) in want:
            assert r.distance == pytest.approx(want[r.query_id, r.chunk_id], abs=2e-9)
    # A search of all cells at full depth is exact.
    whole = quantized.topk_quantized(index, codec, questions, K, 12, 1500)
    assert {r.recall for r in vectors.recall(whole, exact).collect()} == {1.0}


def test_books_are_better_than_their_start(spark, trained):
    index, codec = trained
    rows = quantized.residuals(index.select("embedding"), codec.centroids)
    left = np.array([r.residual for r in rows.collect()])

    def lost(books):
        c = quantized.Codec(codec.centroids, books)
        codes = c.coded(left)
        return sum(((c.parts(left)[:, p] - books[p][codes[:, p]]) ** 2).sum() for p in range(len(books)))

    start = quantized.train_books(rows, 8, 32, 0)
    once, more = quantized.train_books(rows, 8, 32, 1), quantized.train_books(rows, 8, 32, 4)
    assert lost(more) < lost(once) < lost(start)
    with pytest.raises(ValueError, match="cannot be cut"):
        quantized.train_books(rows, 5, 4, 1)


def test_codes_of_a_row_are_its_nearest_entries(trained):
    index, codec = trained
    for r in index.limit(50).collect():
        v = np.array(r.embedding, np.float64)
        left = v / np.linalg.norm(v) - codec.centroids[r.cell]
        want = [((codec.books[p] - left[2 * p : 2 * p + 2]) ** 2).sum(axis=1).argmin() for p in range(8)]
        assert list(r.codes) == want


def test_scan_is_narrow_and_reads_probed_cells_only(spark, trained):
    index, codec = trained
    questions = frame(spark, clustered(2, seed=6), "query_id")
    near = quantized.candidates(index, codec, questions, 2, 30)
    plan = near._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "codes" in line]
    assert scans and all("embedding" not in line.split("ReadSchema")[1] for line in scans)
    assert all("dynamicpruning" in line for line in scans if "chunk_id" in line.split("ReadSchema")[1])
    rows = near.collect()
    probed = {(r.query_id, r.cell) for r in quantized.probing(questions, codec, 2).collect()}
    assert {(r.query_id, r.cell) for r in rows} <= probed
    assert max(r["rank"] for r in rows) <= 30


def test_parted_cells_and_question_blocks_change_nothing(spark, trained, monkeypatch):
    """A cell that holds a third of all rows, and one that very many ask."""
    _, codec = trained
    data = clustered(600)
    rows = frame(spark, np.concatenate((data, np.repeat(data[:1], 300, axis=0))))
    index = quantized.encode(rows, codec).cache()
    questions = frame(spark, clustered(40, seed=7), "query_id")
    args = (index, codec, questions, 5, 4, 40)
    want = sorted(map(tuple, quantized.topk_quantized(*args).collect()))
    monkeypatch.setattr(quantized, "GROUP_ROWS", 50)
    monkeypatch.setattr(quantized, "GROUP_QUESTIONS", 7)
    assert sorted(map(tuple, quantized.topk_quantized(*args).collect())) == want
    assert len(want) == 200


def test_vectors_without_direction_and_empty_tables(spark, trained):
    _, codec = trained
    zero = np.zeros((1, 16))
    rows = frame(spark, np.concatenate((zero, clustered(20))))
    index = quantized.encode(rows, codec)
    questions = frame(spark, np.concatenate((zero, clustered(1, seed=8))), "query_id")
    found = quantized.topk_quantized(index, codec, questions, 50, 12, 50).collect()
    assert {r.query_id for r in found} == {1} and {r.chunk_id for r in found} == set(range(1, 21))
    assert quantized.topk_quantized(index.limit(0), codec, questions, 5, 2).collect() == []
    assert quantized.topk_quantized(index, codec, questions.limit(0), 5, 2).collect() == []
    assert quantized.calibrate(index.limit(0), codec, 5, 0.9) == (1, 5)
