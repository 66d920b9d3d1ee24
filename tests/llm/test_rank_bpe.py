"""BPE by rank arrays against the tokenizers library, both ways."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheaf.llm import rank_bpe

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
ENCODER = rank_bpe.RankEncoder(FILE, remember=2000)  # forgets often
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>"]
TEXTS = [
    "", None, " \t\n", "Hello, World! it's I'LL 123", "a<|endoftext|>b <|startoftext|><|startoftext|>", "'s't''re '’s",
    "日本語 テキスト café café ﬁ ǅ İstanbul ΟΔΟΣ", "\x00\x0b\x0c\x1c a b c​d", "🙂🙂 ok 👩‍👩", "¼ ² ª º ß ſ ŉ ı K Å",
    "x" * 5000, "ab" * 40_000 + " é" * 50, "a" * 64 + " " + "b" * 65, "über-straße " * 30,
]


def same(texts):
    ids, counts = ENCODER.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        got = ids[at : at + n].tolist()
        at += n
        assert got == want
        assert ENCODER.decode(got).decode() == LIBRARY.decode(want, skip_special_tokens=False)
    assert at == len(ids)


def test_chosen_texts():
    same(TEXTS)
    same(TEXTS)  # now known


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(SPECIAL + TEXTS[3:10])), max_size=6))
def test_any_text(parts):
    same([" ".join(parts), "".join(parts)])


def test_words_against_a_plain_loop():
    """The matrix and the queue give what merging the lowest-ranked, leftmost pair again and again gives."""
    model = json.load(open(FILE, encoding="utf-8"))["model"]
    rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
    letters = rank_bpe.byte_letters()
    rng = random.Random(13)
    words = ["".join(rng.choices("aeinorst", k=rng.randrange(1, 90))).encode() for _ in range(300)]
    words += [bytes(rng.choices(range(256), k=rng.randrange(1, 20))) for _ in range(200)]
    merges = rank_bpe.Merges(FILE)
    order, ids, sizes = merges.merge(words)
    ends = np.cumsum(sizes)
    assert sorted(order) == list(range(len(words)))
    for place, begin, end in zip(order, (ends - sizes).tolist(), ends.tolist(), strict=True):
        parts = [letters[b] for b in words[place]]
        parts[-1] += "</w>"
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            _, i = min(pairs)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        want = [model["vocab"][part] for part in parts]
        assert ids[begin:end].tolist() == want == merges.queued(words[place])


def test_unknown_ids_decode_to_nothing():
    assert ENCODER.decode([320, 10**6, -1]).decode() == LIBRARY.decode([320, 10**6], skip_special_tokens=False)
    assert ENCODER.decode([]) == b""


def test_tables(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    ids = [LIBRARY.encode(text or "", add_special_tokens=False).ids for _, text in rows]
    back = [LIBRARY.decode(found, skip_special_tokens=False) for found in ids]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = [
        (doc_id, len(found), sha(np.array(found, "<u4").tobytes()), sha(text.encode()))
        for (doc_id, _), found, text in zip(rows, ids, back, strict=True)
    ]
    assert sorted(map(tuple, rank_bpe.digests(docs, FILE).collect()), key=repr) == sorted(want, key=repr)
    encoded = rank_bpe.encode(docs, FILE)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect() if r.doc_id is not None) == sorted(
        (doc_id, found) for (doc_id, _), found in zip(rows, ids, strict=True) if doc_id is not None
    )
    decoded = rank_bpe.decode(encoded.selectExpr("*", "'x' AS text"), FILE).collect()
    assert sorted(r.text for r in decoded) == sorted(back)
    assert rank_bpe.digests(docs.limit(0), FILE).collect() == []


def test_query_on_the_test_table(spark):
    from sheaf.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op13_rank_bpe"](spark, folder).collect():
        want = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
