import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf.functions.terms import STOP_WORDS, stem_word
from sheaf.operators import keywords


def tokens(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return [(i, stem_word(w)) for i, w in enumerate(words) if w not in STOP_WORDS]


def parse(question):
    groups = [[]]
    for token in re.findall(r'-?"[^"]*"?|[^\s"]+', question):
        if token.lower() == "or":
            groups.append([])
            continue
        terms = tokens(token)
        if terms:
            groups[-1].append((token.startswith("-"), terms))
    return groups


def found_positions(document, clause_terms):
    """Positions of every term of every occurrence of a word or phrase."""
    at = dict(document)
    hits = set()
    for pos, term in document:
        start = pos - clause_terms[0][0]
        if all(at.get(start + offset) == t for offset, t in clause_terms):
            hits |= {(start + offset, t) for offset, t in clause_terms}
    return hits


def brute_force_score(text, question):
    document, total, matched = tokens(text), 0.0, False
    for group in parse(question):
        wanted = [terms for negated, terms in group if not negated]
        hits = [found_positions(document, terms) for terms in wanted]
        if not wanted or not all(hits):
            continue
        if any(found_positions(document, terms) for negated, terms in group if negated):
            continue
        matched = True
        all_hits = sorted(set().union(*hits))
        slots = {t for terms in wanted for _, t in terms}
        spans = [
            (all_hits[i][0], all_hits[j][0], j - i)
            for i in range(len(all_hits))
            for j in range(i, len(all_hits))
            if {t for _, t in all_hits[i : j + 1]} == slots
        ]
        for a, b, n in spans:
            if not any((c, d) != (a, b) and a <= c and d <= b for c, d, _ in spans):
                total += 0.1 / (1 + (b - a) - n)
    return total if matched else None


QUESTIONS = [
    "alpha",
    "alpha beta",
    '"alpha beta"',
    '"alpha the beta" gamma',
    "alpha OR gamma",
    "alpha beta or delta -gamma",
    "alpha -\"beta gamma\"",
    "alpha-beta",
    '"beta gamma" "gamma delta"',
    '"alpha beta alpha"',
    "alpha alpha beta",
    '"alpha delta',
    "the of",
    "-alpha",
    "Alphas BETAS",
    "alpha beta gamma delta",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "filler", "Betas", "of", "alphas,"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(80)]


def test_matches_and_scores_equal_brute_force(spark, texts):
    corpus = spark.createDataFrame(
        [(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, content string"
    )
    questions = spark.createDataFrame(
        [(f"q{i:02d}", q) for i, q in enumerate(QUESTIONS)], "query_id string, question string"
    )
    rows = keywords.postings(corpus).cache()
    clauses = keywords.query_clauses(questions)
    got = {
        (r.query_id, r.chunk_id): round(r.score, 9) for r in keywords.match(rows, clauses).collect()
    }
    expected = {
        (f"q{i:02d}", f"c{j:02d}"): round(score, 9)
        for i, q in enumerate(QUESTIONS)
        for j, t in enumerate(texts)
        if (score := brute_force_score(t, q)) is not None
    }
    assert got == expected
    assert {q for q, _ in got} >= {"q00", "q01", "q02", "q05", "q06", "q07", "q09", "q15"}

    top = keywords.keyword_topk(rows, clauses, 3).orderBy("query_id", "rank").collect()
    for q in {r.query_id for r in top}:
        mine = [(r.score, r.chunk_id) for r in top if r.query_id == q]
        best = sorted((-s, c) for (query, c), s in expected.items() if query == q)[:3]
        assert mine == [(-s, c) for s, c in best]


def test_large_sets_give_the_same_without_broadcasts(spark, texts, monkeypatch):
    corpus = spark.createDataFrame(
        [(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, content string"
    )
    questions = spark.createDataFrame(
        [("a", 'alpha "beta gamma" OR delta'), ("b", "alpha"), ("c", "alpha delta")],
        "query_id string, question string",
    )
    rows, clauses = keywords.postings(corpus), keywords.query_clauses(questions)
    small = sorted(map(tuple, keywords.match(rows, clauses).collect()))
    monkeypatch.setattr(keywords, "BROADCAST_ROWS", 5)  # several blocks of clauses
    monkeypatch.setattr(keywords, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, keywords.match(rows, clauses).collect())) == small
    plan = keywords.hits(rows, clauses)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan


def test_groups_that_only_exclude(spark):
    texts = {f"c{i:02d}": "alpha beta" if i % 3 else "gamma" for i in range(30)}
    corpus = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
    questions = spark.createDataFrame(
        [("a", "-alpha"), ("b", "gamma OR -beta"), ("c", "-missing"), ("d", "-gamma OR -alpha")],
        "query_id string, question string",
    )
    rows, clauses = keywords.postings(corpus), keywords.query_clauses(questions)
    found = {}
    for r in keywords.keyword_topk(rows, clauses, 4, corpus).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    gamma = [c for c, text in texts.items() if text == "gamma"]
    assert found["a"] == [(c, 0.0) for c in gamma[:4]]
    assert [c for c, _ in found["b"]] == gamma[:4] and all(score > 0 for _, score in found["b"])
    assert found["c"] == found["d"] == [(c, 0.0) for c in sorted(texts)[:4]]
    assert not any(r.query_id in "ac" for r in keywords.keyword_topk(rows, clauses, 4).collect())


def test_positions_count_stop_words(spark):
    corpus = spark.createDataFrame([("c", "The cats, and Ähren!")], "chunk_id string, content string")
    rows = {(r.term, r.pos) for r in keywords.postings(corpus).collect()}
    assert rows == {("cat", 1), ("ähren", 3)}


def test_clause_rows(spark):
    questions = spark.createDataFrame(
        [("q", 'a1 "b c" or d1 -e1 -"f g" "x or y" OR'), ("empty", "the")], "query_id string, question string"
    )
    rows = keywords.query_clauses(questions).collect()
    assert {r.query_id for r in rows} == {"q"}
    by_clause = {}
    for r in sorted(rows, key=lambda r: (r.clause, r.offset)):
        by_clause.setdefault(r.clause, []).append((r.term, r.offset, r.grp, r.negated))
    assert list(by_clause.values()) == [
        [("a1", 0, 0, False)],
        [("b", 0, 0, False), ("c", 1, 0, False)],
        [("d1", 0, 1, False)],
        [("e1", 0, 1, True)],
        [("f", 0, 1, True), ("g", 1, 1, True)],
        [("x", 0, 1, False), ("y", 2, 1, False)],
    ]


def test_stored_postings_read_only_needed_buckets(spark, texts, tmp_path):
    corpus = spark.createDataFrame(
        [(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, content string"
    )
    rows = keywords.postings(corpus)
    path = str(tmp_path / "postings")
    keywords.write_postings(rows, path, rows_per_file=max(1, rows.count() // 8))
    questions = spark.createDataFrame([("q", "alpha -delta")], "query_id string, question string")
    clauses = keywords.query_clauses(questions)
    stored = keywords.read_postings(spark, path, clauses)
    assert spark.read.parquet(path).count() == rows.count()
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan[plan.index("PartitionFilters") :]
    assert sorted(map(tuple, keywords.match(stored, clauses).collect())) == sorted(
        map(tuple, keywords.match(rows, clauses).collect())
    )


def test_phrases_are_looked_up_where_two_of_their_terms_stand(spark):
    """Chunks that hold a phrase's terms apart give no hits, however many there are."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(200)] + ["w0 w1 w2 w3 w4 w5 w6 w7"] * 3
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    questions = ['"w0 w1 w2 w3 w4 w5 w6 w7"', '"w3 w2 w1" OR "w1 w1 w2" w5', '"w4 w5 w6" -w7', 'w3 "w9 w8" -"w1 w2"']
    rows = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string")
    posted, clauses = keywords.postings(corpus).cache(), keywords.query_clauses(rows).cache()
    got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in keywords.match(posted, clauses).collect()}
    expected = {
        (f"q{i}", j): round(score, 9)
        for i, q in enumerate(questions)
        for j, t in enumerate(texts)
        if (score := brute_force_score(t, q)) is not None
    }
    assert got == expected and {q for q, _ in got} >= {"q0", "q1", "q3"}
    of_first = clauses.filter("query_id = 'q0'")
    kept = keywords.hits(posted, of_first).count()
    asked = posted.join(of_first.select("term"), "term", "left_semi").count()
    assert 24 <= kept < 0.1 * asked


def test_questions_that_share_an_id_match_as_their_joined_clauses(spark):
    corpus = spark.createDataFrame([("c0", "alpha beta"), ("c1", "gamma delta"), ("c2", "delta")], "chunk_id string, content string")
    questions = spark.createDataFrame([("q", '"alpha beta"'), ("q", '"gamma delta"')], "query_id string, question string")
    found = keywords.match(keywords.postings(corpus), keywords.query_clauses(questions)).select("chunk_id").collect()
    assert sorted(r.chunk_id for r in found) == ["c0"]


def test_chunks_that_are_there_twice_keep_all_places(spark):
    """A phrase is complete where as many hits stand as it has terms, as it was before places were looked up."""
    corpus = spark.createDataFrame(
        [("c0", "alpha beta"), ("c1", "alpha gamma beta"), ("c1", "alpha gamma beta"), ("c2", "alpha gamma")],
        "chunk_id string, content string",
    )
    questions = spark.createDataFrame([("q", '"alpha beta"')], "query_id string, question string")
    found = keywords.match(keywords.postings(corpus), keywords.query_clauses(questions)).select("chunk_id").collect()
    assert sorted(r.chunk_id for r in found) == ["c0", "c1"]
