"""Byte-pair encoding through a distinct-word table, and decoding through an id-to-piece join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from .common import arrow_schema, batch, pack_lists, unpack_lists
from .tokenizer import load, splitter


def piece_table(tokenizer_path: str) -> np.ndarray:
    """The id-to-piece table: the piece of each id; its size is fixed by the tokenizer's file."""
    tok = load(tokenizer_path)
    pieces = np.full(tok.get_vocab_size(with_added_tokens=True), None, object)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        pieces[i] = piece
    return pieces


def joined(pieces: np.ndarray, ids: np.ndarray) -> str:
    """The pieces that ``ids`` meet in the table, as the library's decode puts them together."""
    return " ".join(pieces[ids].tolist())


def _encoded(docs: DataFrame, tokenizer_path: str, row: Callable[[], Callable[[int | None, np.ndarray], tuple]], out: str) -> DataFrame:
    """``row()`` is called once a chunk and gives the function from a document's id and token ids to its row."""
    documents, lexicons = lexicon.split_chunks(docs, lambda: splitter(tokenizer_path), frequencies=False)

    def resolver():
        tok = load(tokenizer_path)
        return lambda words: [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    def finish(order: np.ndarray, parts: list[bytes]):
        given = [unpack_lists(x) for x in parts]
        lengths, starts, flat = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(0, np.uint32)
        if given:
            n, flat = np.concatenate([x[0] for x in given]).astype(np.int64), np.concatenate([x[1] for x in given])
            lengths[order], starts[order] = n, np.cumsum(n) - n
        make = row()

        def each(doc_id, _, words, __):
            n = lengths[words]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return make(doc_id, flat[np.repeat(starts[words], n) + inner])

        return each

    return lexicon.rejoin(documents, lexicon.resolve(lexicons, resolver, pack_lists), finish, out)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, ids)``, one row for each row of ``docs(doc_id, text, ...)``.

    Texts are cut into words, each distinct word is encoded once, and its ids
    go back to every position that holds it. A null or empty text has an empty
    array; a null ``doc_id`` and repeated rows stay as they are; other columns
    are not used and not returned.
    """
    return _encoded(docs, tokenizer_path, lambda: lambda doc_id, ids: (doc_id, ids.astype(np.int32)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids, ...)``, as the library's decode without skipping special tokens.

    The ids meet the id-to-piece table in a join on the map side: the table is
    as large as the vocabulary, whatever the data. Null ids give an empty text.
    An id that is not in the vocabulary fails.
    """
    schema = "doc_id long, text string"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        pieces = piece_table(tokenizer_path)
        for b in batches:
            yield batch(out, b.column(0), [joined(pieces, np.array(ids.as_py() or [], np.int64)) for ids in b.column(1)])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(scan, schema)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded as :func:`encode` does and decoded as :func:`decode` does.

    The hashes are those of the ids as little-endian unsigned 32-bit integers
    and of the decoded text in UTF-8. Both steps run where a chunk's ids are put
    together, so that the ids of the corpus are never shuffled.
    """

    def row():
        pieces = piece_table(tokenizer_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return lambda doc_id, ids: (doc_id, len(ids), sha(ids.astype("<u4").tobytes()), sha(joined(pieces, ids).encode()))

    return _encoded(docs, tokenizer_path, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
