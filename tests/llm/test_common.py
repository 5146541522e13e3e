import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from docweir.llm import common


@given(st.lists(st.text(max_size=20)))
def test_strings(words):
    assert common.unpack_strings(common.pack_strings(words)) == words
    assert common.unpack_strings(common.pack_strings(sorted(words))) == sorted(words)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_ints(values):
    assert common.unpack_ints(common.pack_ints(np.array(values, np.uint32))).tolist() == values


@given(st.lists(st.lists(st.integers(0, 70000), max_size=5)))
def test_lists(lists):
    lengths, flat = common.unpack_lists(common.pack_lists(lists))
    assert lengths.tolist() == list(map(len, lists)) and flat.tolist() == [x for y in lists for x in y]


def test_sieve_loses_no_id(spark):
    df = spark.range(-500, 1500).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id * 2 as word", "'x' as bits", "1 as slot").unionByName(spark.sql("select cast(null as long) doc_id, 1L word, 'x' bits, 1 slot"))
    ids = spark.range(0, 1500, 10).toDF("k").unionByName(spark.sql("select cast(null as long) k"))
    maybe, sure = common.sifted(df, "doc_id", ids)
    assert maybe.columns == sure.columns == df.columns
    a, b = [r.doc_id for r in maybe.collect()], [r.doc_id for r in sure.collect()]
    assert len(a) + len(b) == 2001 and None in b and set(range(0, 1500, 10)) <= set(a) and len(a) < 600
    old, common.SIEVE_BITS = common.SIEVE_BITS, 64
    try:
        maybe, sure = common.sifted(df, "doc_id", ids)
        assert set(range(0, 1500, 10)) <= {r.doc_id for r in maybe.collect()} and maybe.count() + sure.count() == 2001
    finally:
        common.SIEVE_BITS = old
    maybe, sure = common.sifted(df, "doc_id", ids.limit(0))
    assert maybe.count() == 0 and sure.count() == 2001
