import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from docweir.llm import decontaminate, pii, queries, simhash
from docweir.llm.tokenizer import public_path

from .test_decontaminate import brute_score
from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in queries.op8_quality(spark, SF).collect() if r.predicted == 1}
    assert 0 < len(good) < len(docs)
    kept = brute([(i, docs[i]) for i in sorted(good)])
    assert len(kept) < len(good)
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [set(zip(x, x[1:])) for x in items]

    def leaks(text):
        w = decontaminate.words_of(text)
        g = set(zip(w, w[1:]))
        # an item that shares no pair of words cannot reach the threshold
        return any(g & own and brute_score(x, w) >= decontaminate.THRESHOLD * decontaminate.MATCH * len(x) for x, own in zip(items, grams) if len(g & own) >= 3)

    clean = [d for d in kept if not leaks(docs[d])]
    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = []
    for d in clean:
        text = docs[d]
        text = pii.masked(text, pii.find_all([text])[0][1])
        ids = tok.encode(text, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (7, "a b c d", 1), (7, "quite other words", 2), (None, "a b c d", 3), (None, None, 3), (9, None, 4), (10, "", 4), (11, "z y x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.first_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, "a b c d", 1), (7, "quite other words", 2), (None, "a b c d", 3), (None, None, 3), (9, None, 4), (11, "z y x", 5)], key=str)
    assert simhash.first_of_each_group(docs.limit(0)).count() == 0


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", None), (None, "mail a@b.cd now", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 2
