import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorix.llm import encoding as E
from quorix.llm.tokenizers import DEFAULT_FOLDER, byte_bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(DEFAULT_FOLDER), reason="no vocabularies here")

NASTY = [
    None,
    "",
    " ",
    "\n\n\n",
    "a  b\n\n  c\r\n\td <|endoftext|> it's we'll x's",
    "数据　全角。\n\n表格 ünïcödé 👩‍🔬🎉 \u0000\x07",
    "iVBORw0KGgo" * 4000,
    "word " * 5000,
    "\n".join(f"line {i} of a table\t{i * 7.5}" for i in range(3000)),
]


def direct(texts):
    enc = byte_bpe().encoding
    return [enc.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("one_in", [1, 4, 256])
def test_exact_on_whole_texts(spark, one_in):
    rows = [(i, t, "x", 1) for i, t in enumerate(NASTY)] + [(None, "null id", "x", 1), (4, NASTY[4], "again", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, pos int").repartition(3)
    got = sorted(((r.doc_id, r.ids) for r in E.encode_corpus(df, one_in=one_in).collect()), key=str)
    want = sorted(zip([r[0] for r in rows], direct([r[1] for r in rows])), key=str)
    assert got == want


def test_hot_chunks_and_partitioning(spark):
    same = "the same notebook footer\n" * 300
    rows = [(i, f"start {i}\n" + same) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = {r.doc_id: r.ids for r in E.encode_corpus(df.repartition(5)).collect()}
    assert a == {r.doc_id: r.ids for r in E.encode_corpus(df.coalesce(1)).collect()}
    assert a == dict(zip([r[0] for r in rows], direct([r[1] for r in rows])))


def test_empty_table(spark):
    assert E.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 'sé数\n\t1.,", max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_joins_are_repaired_wherever_the_cut(text, cuts):
    bpe = byte_bpe()
    at = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    parts = [bpe.encode(text[a:b]) for a, b in zip(at, at[1:])]
    assert E.join_ids(bpe, parts).tolist() == bpe.encode(text).tolist()


def test_cuts_are_content_defined():
    rng = random.Random(0)
    block = "".join(rng.choice("abcdef \n") for _ in range(20_000)).encode()
    a = E.cut_points(np.frombuffer(block, np.uint8), 16)
    b = E.cut_points(np.frombuffer(b"x shift " + block, np.uint8), 16) - 8
    assert len(a) > 50 and set(a[2:]) <= set(b)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in E.token_counts(df.drop("n_tokens")).collect()}
    assert got == {1: len(direct(["a b c"])[0]), 2: 0, 3: 0}
    assert E.token_counts(df).columns == ["doc_id", "n_tokens"]
