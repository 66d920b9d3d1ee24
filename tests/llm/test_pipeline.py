"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write_tables(spark, folder):
    rng = random.Random(13)
    words = {lang: ["".join(rng.choices(letters, k=5)) for _ in range(40)] for lang, letters in
             (("en", "abcdefgh"), ("fr", "ijklmnop"))}
    data = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        data.append((i, " ".join(rng.choices(words[lang], k=60)), lang, f"s{i % 4}", 1))
    item = " ".join(rng.choices(words["en"], k=15))
    data += [(100, "12 34", "en", "s0", 1), (101, None, None, None, None), (102, data[4][1], "en", "s1", 1)]
    data += [(103, f"{data[7][1]} {item}", "en", "s1", 1), (None, data[8][1], None, "s2", 1), data[9]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return data


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    data = write_tables(spark, folder)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "encode"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after[name] = docs.collect()
        assert name == "encode" or docs.columns == COLUMNS
    ids = {name: [r.doc_id for r in rows] for name, rows in after.items()}
    everyone = [row[0] for row in data]
    assert collections.Counter(ids["language_id"]) == collections.Counter(i for i in everyone if i not in (100, 101))
    assert sorted(ids["near_dedup"]) == sorted({*range(90), 103})
    assert sorted(ids["decontaminate"]) == list(range(90))
    assert set(ids["mix"]) <= set(range(90)) and max(collections.Counter(ids["mix"]).values()) <= 2
    words = sum(len(r.text.split()) for r in after["mix"])
    assert abs(words - 1.5 * 90 * 60) <= 4 * 60
    whole, start = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0
    text = {r.doc_id: r.text for r in after["mix"]}
    assert collections.Counter(ids["encode"]) == collections.Counter(ids["mix"])
    for r in sorted(after["encode"], key=lambda r: r.start):
        want = whole.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += r.n_tokens
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, after["encode"]))


def test_empty_documents_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_registered_queries():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
