"""Token counts without ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import lexicon
from .common import pack_ints, unpack_ints
from .tokenizer import load, splitter


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row for each row of ``docs(doc_id, text, ...)``.

    Pieces are counted once for each distinct pre-token, joined to the
    documents' pre-token frequencies and summed. A null or empty text has no
    bytes and no tokens; a null ``doc_id`` and repeated rows stay as they are;
    other columns are not used and not returned.
    """
    documents, lexicons = lexicon.split_chunks(docs, lambda: splitter(tokenizer_path), frequencies=True)

    def resolver():
        tok = load(tokenizer_path)
        return lambda words: [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    pieces = lexicon.resolve(lexicons, resolver, lambda counts: pack_ints(np.array(counts, np.uint32)))

    def finish(order: np.ndarray, parts: list[bytes]):
        per_word = np.zeros(len(order), np.int64)
        if parts:
            per_word[order] = np.concatenate([unpack_ints(x) for x in parts])
        return lambda doc_id, n_bytes, words, counts: (doc_id, n_bytes, int(per_word[words] @ counts.astype(np.int64)))

    return lexicon.rejoin(documents, pieces, finish, "doc_id long, n_bytes long, n_tokens long")
