import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docweir.llm import bpe
from docweir.llm.token_counts import token_counts
from docweir.llm.tokenizer import public_path, splitter

TEXTS = [
    None, "", " ", "Hello wörld, it's 42!!\n\n  ok", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ ΟΔΟΣ İstanbul ǅ", "tab\tand\x1cfs\x0bvt\x85nel nbsp",
    "é combining", "日本語 テキスト 123", "😀 emoji 👩‍👩‍👧", "I'LL don'T we'Ve", "x" * 3000, "word " * 2000, "the same", "the same", "trail \n \n", "١٢٣ ½ ²", "\x00nul", "<|endoftext|><|endoftext|>", "ſ ß ẞ ŉ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (3, TEXTS[3], "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, bucket string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole(name):
    tok, cut = Tokenizer.from_file(public_path(name)), splitter(public_path(name))
    for t in TEXTS:
        whole = tok.encode(t or "", add_special_tokens=False).ids
        assert [i for w in cut(t or "") for i in tok.encode(w, add_special_tokens=False).ids] == whole, t


def test_encode_and_decode(spark, docs):
    path = public_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    encoded = bpe.encode(docs, path)
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
    want = sorted(((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()), key=str)
    assert got == want
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()}
    for i, t in enumerate(TEXTS):
        assert texts[i] == tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)
    for r in bpe.round_trip(docs, path).collect():
        ids = dict(want)[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_many_chunks(spark, docs, monkeypatch):
    path = public_path("word_bpe_49k.json")
    want = sorted(docs_row for docs_row in bpe.round_trip(docs.where("doc_id is not null"), path).collect())
    monkeypatch.setattr("docweir.llm.lexicon.CHUNK_WORDS", 3)
    monkeypatch.setattr("docweir.llm.lexicon.ROW_WORDS", 2)
    assert sorted(bpe.round_trip(docs.where("doc_id is not null"), path).collect()) == want
    monkeypatch.setattr("docweir.llm.lexicon.MEMO", 2)
    assert sorted(bpe.round_trip(docs.where("doc_id is not null"), path).collect()) == want


def test_each_distinct_word_is_resolved_once(spark):
    """One call for each distinct word of a task, whatever the number of chunks that hold it."""
    from docweir.llm import lexicon
    from docweir.llm.common import pack_ints, pack_strings, unpack_ints

    parts = [(chunk, 0, pack_strings(words)) for chunk, words in enumerate([["a", "b"], ["b", "c"], ["a", "c", "d"], ["d"]])]
    df = spark.createDataFrame(parts, "chunk long, bucket int, words binary").coalesce(1)

    def resolver():
        calls = iter(range(100))
        return lambda words: [next(calls) for _ in words]

    got = {r.chunk: unpack_ints(r.answers).tolist() for r in lexicon.resolve(df, resolver, lambda x: pack_ints(np.array(x, np.uint32))).collect()}
    seen = {}
    for chunk, _, _ in parts:
        for w, n in zip([["a", "b"], ["b", "c"], ["a", "c", "d"], ["d"]][chunk], got[chunk]):
            assert seen.setdefault(w, n) == n
    assert sorted(seen.values()) == [0, 1, 2, 3]


def test_counts(spark, docs):
    path = public_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, path).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)


def test_empty_table(spark, docs):
    assert token_counts(docs.limit(0), public_path("byte_bpe_50k.json")).count() == 0
    assert bpe.decode(bpe.encode(docs.limit(0), public_path("word_bpe_49k.json")), public_path("word_bpe_49k.json")).count() == 0


def test_rules_are_the_file_s_own(tmp_path):
    """A file with another split pattern is cut by it; one whose rules are others is refused, not cut wrongly."""
    import json

    from docweir.llm import tokenizer

    def changed(name, change):
        spec = json.load(open(public_path(name), encoding="utf-8"))
        change(spec)
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(spec))
        return str(path)

    def other_pattern(spec):
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"(?:[\p{L}]+)|([\p{N}])"}

    path = changed("word_bpe_49k.json", other_pattern)
    text = "Ab12, c!3 über"
    assert splitter(path)(text) == ["ab", "1", "2", "c", "3", "über"]
    lib = Tokenizer.from_file(path)
    assert [i for w in splitter(path)(text) for i in lib.encode(w, add_special_tokens=False).ids] == lib.encode(text, add_special_tokens=False).ids
    assert tokenizer.rules(public_path("byte_bpe_50k.json")) == (tokenizer.BYTE_PATTERN, False) and tokenizer.rules(public_path("word_bpe_49k.json"))[1]
    for name, change in (
        ("word_bpe_49k.json", lambda s: s.update(normalizer=None)), ("word_bpe_49k.json", lambda s: s["normalizer"]["normalizers"].pop()), ("word_bpe_49k.json", lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated")), ("word_bpe_49k.json", lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(use_regex=True)),
        ("byte_bpe_50k.json", lambda s: s["pre_tokenizer"].update(add_prefix_space=True)), ("byte_bpe_50k.json", lambda s: s.update(normalizer={"type": "Lowercase"})), ("byte_bpe_50k.json", lambda s: s.update(pre_tokenizer={"type": "Whitespace"})), ("byte_bpe_50k.json", lambda s: s.update(pre_tokenizer=None)),
    ):
        with pytest.raises(ValueError, match="not supported"):
            splitter(changed(name, change))
