import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from benthos.llm import bpe, encoding

PATH = encoding.vocabulary("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = bpe.load(PATH).encode(text)
    assert list(ids) == reference.encode_ordinary(text)
    assert bpe.load(PATH).decode(ids) == text


def test_runs_and_long_pieces(reference):
    rng = random.Random(1)
    for text in ["2222222", " 3222", "ab" * 5000, "x" * 20_000, "<|endoftext|>", "".join(rng.choice("ab1 é中\n'") for _ in range(3000))]:
        assert list(bpe.load(PATH).encode(text)) == reference.encode_ordinary(text)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS key", "array(1) AS ids")
    rows = encoding.encode(df, "doc_id", "text").collect()
    assert len(rows) == 5 and [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert sorted(r.n_tokens for r in encoding.token_counts(df, "doc_id", "text").collect())[:4] == [0, 0, 2, 2]
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {1: "a b", 2: "", 3: "", None: "x" * 100_000}
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0
