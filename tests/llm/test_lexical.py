"""Ranked lexical search: brute force, skipping, edge cases."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from sheaf.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, collections.Counter(split(text))) for i, text in docs]
    held = [(i, counts, sum(counts.values())) for i, counts in held if counts]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(term for _, counts, _ in held for term in counts)
    out = []
    for item, text in items:
        scores = []
        for doc_id, counts, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in split(text)
                if t in counts
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(seed=12, n=900):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 9 else f"É{i}é" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((3, 20, 60))))) for i in range(n)]
    docs += [(5000 + i, docs[11][1]) for i in range(n // 2)]  # a third are copies
    docs += [(-1, None), (-2, ""), (-3, "?! .,"), (None, docs[11][1]), (None, "W1"), docs[4], docs[4], (9000, "w1-W1_w2 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)] + [(100, docs[11][1]), (101, docs[n - 7][1].lower())]
    items += [(102, None), (103, "nothere"), (None, "W1 W2"), (104, "W3 W3 W3 w390"), (104, "W3")]
    rng.shuffle(docs)
    return docs, items


def run(spark, docs, items, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS segment", "'t' AS term", "2 AS item")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "'x' AS doc_id")
    return sorted(map(tuple, ls.rank_documents(docs, items, **kw).collect()), key=repr)


def test_search_against_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == sorted(brute(docs, items, 10), key=repr)


def test_segments_blocks_and_whole_index(spark, tmp_path):
    """Many segments and blocks of items, and an index of every term, give the same rows."""
    docs, items = corpus(3, 300)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(items)], "item long, text string")
    index = ls.build_index(table, f"{tmp_path}/index", postings=500)
    assert index.select("segment").distinct().count() > 10
    got = ls.search(index, asked, 3, block_terms=40).select("item", "rank", "doc_id", "score").collect()
    want = brute(docs, [(i, text) for i, (_, text) in enumerate(items)], 3)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert ls.asked_terms(asked, limit=10) is None


def test_empty_tables(spark):
    docs, items = corpus(3, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def lists(n, postings):
    """A segment of ``n`` documents of 50 terms with the given lists."""
    rows = [(b"%d" % i, list(map(int, places)), list(map(int, counts))) for i, (places, counts) in enumerate(postings)]
    table = pa.table(
        {
            "term": pa.array([r[0] for r in rows] + [None], pa.binary()),
            "places": pa.array([r[1] for r in rows] + [list(range(n))], pa.list_(pa.int32())),
            "counts": pa.array([r[2] for r in rows] + [[50] * n], pa.list_(pa.int64())),
            "doc_ids": pa.array([[] for _ in rows] + [list(range(n))], pa.list_(pa.int64())),
        }
    )
    return ls.Lists(table, n, 50 * n)


def test_long_lists_are_skipped():
    """A rare term decides; of the long lists only a small share is looked at, and the result is exact."""
    rng = np.random.default_rng(5)
    n = 40_000
    long = [np.sort(rng.choice(n, n // 2, replace=False)) for _ in range(4)]
    rare = np.sort(rng.choice(n, 30, replace=False))
    found = lists(n, [(p, rng.integers(1, 4, len(p))) for p in long] + [(rare, np.full(30, 3))])
    asked = [(i, 100) for i in range(4)] + [(4, 9000)]
    places, scores = found.top(asked, 10)
    full = np.zeros(n, np.int64)
    for i, w in asked:
        part = slice(found.starts[i], found.starts[i + 1])
        full[found.places[part]] += w * found.base[part]
    want = np.lexsort((np.arange(n), -full))[:10]
    assert places.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert found.read < 0.1 * sum(map(len, long))


def test_only_long_lists_and_ties():
    n = 3000
    found = lists(n, [(np.arange(n), np.full(n, 2)), (np.arange(0, n, 2), np.full(n // 2, 2))])
    places, scores = found.top([(0, 1), (1, 1)], 4)
    assert places.tolist() == [0, 2, 4, 6] and len(set(scores.tolist())) == 1
    assert found.top([(0, 0)], 4)[0].tolist() == []
