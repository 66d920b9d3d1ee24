"""SimHash near duplicates, their components, and sentence spans, against brute force."""

import collections
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import sentence_spans, simhash_neardup
from sheaf.llm.components import components, local_roots


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i in range(len(fps))}
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                low = min(label[i], label[j])
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] + label[j] != 2 * low:
                    label[i] = label[j] = low
                    changed = True
    return label


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é  \t\n\x0b\x1cZ.", max_size=60))
def test_fingerprint(text):
    assert simhash_neardup.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_fingerprint_of_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash_neardup.fingerprint(text)
    monkeypatch.setattr(simhash_neardup, "SHINGLES_AT_ONCE", 64)
    assert simhash_neardup.fingerprint(text) == whole == np.int64(np.uint64(brute_fingerprint(text)))


def edge_docs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=80)) for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "two words", "TWO words"]
    for text in base:
        words = text.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 1)):
                copy[rng.randrange(80)] = "q"
            texts.append(" ".join(copy))
    texts += [texts[10]] * 30
    data = [(i, text, i, "x") for i, text in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, fp long, label string"), texts


def test_near_duplicates_against_brute_force(spark):
    docs, texts = edge_docs(spark)
    got = {r.doc_id: r for r in simhash_neardup.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(text) for text in texts]
    label = brute_components(fps)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fingerprint == format(fps[i], "016x") and got[i].component_id == label[i]
    kept = simhash_neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z")], "doc_id long, text string"
    )
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash_neardup.near_duplicates(docs).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (None, None): 2}
    assert sorted((r.text, r.doc_id) for r in simhash_neardup.keep_one(docs).collect()) == [("a b c d", 1), ("x y z", None)]
    assert simhash_neardup.near_duplicates(docs.limit(0)).collect() == []
    assert simhash_neardup.keep_one(docs.limit(0)).collect() == []


def close_points(n=3000, seed=6):
    """Random fingerprints, chains, and a dense ball of several hundred."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    for i in range(0, n // 2, 3):
        points[i] = points[i + 1] ^ (np.uint64(1) << np.uint64(rng.integers(64)))
    ball = np.full(1500, points[0])
    for _ in range(3):
        ball ^= np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)
    return np.unique(np.concatenate((points, ball)))


def brute_roots(points):
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points) <= 2, 1))
    return local_roots(len(points), a, b)


def test_tree_finds_all_links_in_a_shard():
    points = close_points()
    edges = simhash_neardup.shard_edges(points)
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    a, b = edges["a"].map(place).to_numpy(), edges["b"].map(place).to_numpy()
    assert len(edges) < len(points)
    assert np.array_equal(local_roots(len(points), a, b), brute_roots(points))


def test_links_across_shards_and_crowded_shards(spark):
    points = close_points()
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    for limit in (500_000, 200):
        rows = simhash_neardup.link(table, shard_rows=200, shard_limit=limit, sample_rows=2000).collect()
        a, b = np.array([place[r.a] for r in rows]), np.array([place[r.b] for r in rows])
        assert np.array_equal(local_roots(len(points), a, b), brute_roots(points))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1
    assert got[0] != got[100] and 200 not in got


def plain_parts(text):
    """Words, their sentence numbers and the parts (first word, end) of a text, word by word."""
    words, sentence, number, lines = [], [], 0, text.lower().split("\n")
    for line in lines:
        for word in line.split():
            words.append(word)
            sentence.append(number)
            number += word[-1] in ".!?"
        number += bool(sentence) and sentence[-1] == number
    base = sentence_spans.BASE
    known = {w: sum((b + 1) * pow(base, i, 2**64) for i, b in enumerate(w.encode()[:20_000])) % 2**64 for w in set(words)}
    known = dict(zip(known, sentence_spans.scrambled(np.array(list(known.values()), np.uint64)).tolist()))
    pair = [(known[a] * base + known[b]) % 2**64 for a, b in zip(words, words[1:])]
    pair = sentence_spans.scrambled(np.array(pair, np.uint64)).tolist()
    size = sentence_spans.WINDOW
    least = {i for at in range(len(pair) - size + 1) for i in range(at, at + size) if pair[i] == min(pair[at : at + size])}
    parts, first = [], 0
    for i in range(len(words)):
        if i + 1 == len(words) or i in least or sentence[i] != sentence[i + 1]:
            parts.append((first, i + 1))
            first = i + 1
    return words, sentence, parts


def plain_spans(words, parts, least=20):
    for i, (first, _) in enumerate(parts):
        end = next((j for j in range(i + 2, len(parts) + 1) if parts[j - 1][1] - first >= least), None)
        if end:
            yield " ".join(words[first : parts[end - 1][1]]), i, end


def plain_dedupe(data):
    """doc_id, n_sentences, n_removed, text by a dictionary of spans."""
    owner = {}
    for doc_id, text in data:
        if doc_id is not None and text:
            words, _, parts = plain_parts(text)
            for span, _, _ in plain_spans(words, parts):
                owner[span] = min(owner.get(span, doc_id), doc_id)
    out = []
    for doc_id, text in data:
        words, sentence, parts = plain_parts(text or "")
        gone, seen = set(), set()
        for span, i, end in plain_spans(words, parts) if doc_id is not None else ():
            if owner[span] < doc_id or span in seen:
                gone.update(range(i, end))
            seen.add(span)
        places = [m.start() for m in re.finditer(r"\S+", text or "")] + [len(text or "")]
        kept = None if text is None else text[: places[0]] + "".join(
            text[places[a] : places[b]] for i, (a, b) in enumerate(parts) if i not in gone
        )
        lost = {sentence[w] for i in gone for w in range(*parts[i])}
        out.append((doc_id, len(set(sentence)), len(lost), kept))
    return sorted(out, key=repr)


def test_sentence_spans_against_a_dictionary(spark):
    rng = random.Random(7)
    prose = lambda: " ".join(" ".join(rng.choices("abcdefghijklmnopqrs", k=9)) + "." for _ in range(8))
    passage, twice = prose(), prose()
    texts = [prose(), f"{prose()} {passage}\n{prose()}", f"mid {passage} {prose()}", f"{prose()} {passage}", None, "",
             "Short.", f"{twice}\n{twice}", passage.upper(), prose() + " " + "long " * 60_000, " \n. \n", "same " * 200,
             f"  {passage[20:200]}", "é" * 9_000 + " " + passage]
    for _ in range(30):
        pieces = [rng.choice([passage, twice, texts[0]]).split() for _ in range(3)]
        cuts = [piece[(at := rng.randrange(40)) : at + rng.randrange(5, 60)] for piece in pieces]
        texts.append("\n".join(" ".join(cut) for cut in cuts))
    data = list(enumerate(texts)) + [(None, passage), (8, passage), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS span", "1 AS row", "2 AS spans")
    got = sorted(map(tuple, sentence_spans.dedupe(docs).collect()), key=repr)
    assert got == plain_dedupe(data)
    by_id = {row[0]: row for row in got}
    assert by_id[3][3].split()[-12:] != passage.split()[-12:] and by_id[7][3].startswith(twice)
    assert sentence_spans.dedupe(docs.limit(0)).collect() == []


def test_span_ids_of_any_type(spark):
    passage = " ".join(f"w{i * i % 89}" for i in range(60))
    docs = spark.createDataFrame([("b", passage), ("a", passage), ("c", "x")], "doc_id string, text string")
    assert sorted(map(tuple, sentence_spans.dedupe(docs).collect())) == [("a", 1, 0, passage), ("b", 1, 1, ""), ("c", 1, 0, "x")]


def test_spans_do_not_depend_on_what_surrounds():
    words = [f"w{i * i % 89}" for i in range(400)]
    inner, outer = " ".join(words[100:300]), "Else. " + " ".join(words)
    parts = sentence_spans.Parts.of([inner, None, outer, inner])
    a, b, c = (set(parts.spans[(parts.row == row) & (parts.last > 0)].tolist()) for row in (0, 2, 3))
    assert len(a & b) >= len(a) - 4 and a == c


def test_words_of_long_texts_are_the_same_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(["ab", "é", ".", " ", "\n", "\t", "c!", "\xa0", "İ"], k=4000)) + "x" * 500 + "\n \n y"
    whole = sentence_spans.words_of([text])
    assert len(whole[0]) == len(sentence_spans.TOKEN.findall(text))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(sentence_spans, "PIECE", size)
        part = sentence_spans.words_of([text])
        assert all(np.array_equal(a, b) for a, b in zip(whole, part))


def test_every_repeated_passage_of_50_words_loses_words(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijk", k=5))
    prose = lambda n, ends: " ".join(word() + ("." if rng.random() < ends else "") for _ in range(n))
    texts, passages = [], []
    for i in range(40):
        passages.append(prose(50 + i % 4, (0, 0.02, 0.05, 0.1)[i % 4]))
        texts.append(f"{prose(rng.randint(0, 70), 0.03)} {passages[-1]} {prose(rng.randint(0, 70), 0.03)}")
    once = len(texts)
    texts += [f"{prose(rng.randint(0, 70), 0.03)} {p} {prose(rng.randint(0, 70), 0.03)}" for p in passages]
    texts += [f"{passages[0]} {prose(30, 0)} {passages[0].upper()}", "same " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.dedupe(docs).collect()}
    for i, text in enumerate(texts[:once]):
        assert (got[i].n_removed, got[i].text) == (0, text)
    for i, passage in enumerate(passages):
        out, text = got[once + i], texts[once + i]
        left, right = text.split(passage)
        assert out.n_removed and out.text.startswith(left) and out.text.endswith(right)
        assert len(text.split()) - len(out.text.split()) >= 20
    assert got[once + 40].n_removed and len(got[once + 41].text.split()) < 500
