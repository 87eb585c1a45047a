from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.llm import tokenize as T
from engramlake.llm.registry import TOKENIZER_DIR

RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
# the split of the vocabulary, to compare with
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=T.load_ranks(T.read_file(RANKS)), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'strevldmao !1\n\t ﹣中é٣👍\r", max_size=20), min_size=1, max_size=6))
def test_equals_the_pattern(texts):
    enc, ref = T.encoder(T.read_file(RANKS)), reference()
    flat, sizes, starts, per = enc.encode(texts)
    total = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(per)))]
    for k, t in enumerate(texts):
        ids = flat[total[k] : total[k + 1]].tolist()
        assert ids == ref.encode_ordinary(t)
        assert enc.decode(ids) == t


def test_scan_is_the_automaton():
    rng = np.random.default_rng(3)
    element, comp, applied = T._monoid()
    cls = rng.integers(0, 12, 5000)
    got = applied[T._prefix(element[cls], comp, 16)]
    state = T.S_START
    for c, g in zip(cls, got, strict=True):
        state = T._step(state, c)
        assert state == g


def test_pair_merging_matches_the_compiled_one():
    ranks, enc = T.load_ranks(T.read_file(RANKS)), T.encoder(T.read_file(RANKS))
    for s in ("hello", " Voxkaneis", "数据库的猫咪", "aaaaaaaaaaaaa", " ", "é👍"):
        assert tuple(T.merge_pairs(s.encode(), ranks)) == enc.merge(s)


def test_corpus_columns_nulls_and_round_trip(spark):
    rows = [(1, "It's  a test.\n\n", "x"), (2, "", "x"), (3, None, "x"), (None, "id-less", "x"), (4, "long " * 300_000, "x"), (1, "It's  a test.\n\n", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = T.encode_corpus(df, RANKS, offsets=True).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[2].ids == [] and by[3].ids == [] and len(by[None].ids) > 0
    assert sum(by[1].slice_ids) == len(by[1].ids) and by[1].slice_start == [0, 2, 4, 5, 7, 12, 13]
    back = {r.doc_id: r.text for r in T.decode_corpus(T.encode_corpus(df, RANKS), RANKS).collect()}
    assert back[1] == "It's  a test.\n\n" and back[4] == "long " * 300_000 and back[3] == ""
    assert T.encode_corpus(df.limit(0), RANKS).collect() == []


def test_both_ways_of_merging_give_the_same_corpus():
    """All documents of the middle scale: the own merging and the compiled one."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = [t or "" for t in pq.read_table(path, columns=["text"]).column("text").to_pylist()]
    data = T.read_file(RANKS)
    own, fast = T.Encoder(data, compiled=False), T.Encoder(data)
    assert own.encode(texts)[0].tolist() == fast.encode(texts)[0].tolist()
