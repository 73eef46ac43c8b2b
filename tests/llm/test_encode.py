import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE_50K), reason="the vocabulary file is absent")
ODD = ["", "'", "''s", "it's we'll 'tis 's \n's a's'll 9'd !'s", " ", "  ", "\n\n x", "a" * 3000, "ab" * 500, "<|endoftext|>", "\x1c\x1d a\x85b", "½Ⅳ٣ x²", "é" * 300, "\U0001f600" * 90, " " * 5000, "　　x", "x' s"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.BYTE_BPE_50K)
    t.encode_special_tokens = True
    ours = encode.Encoder(encode.load_tables(encode.BYTE_BPE_50K))
    return ours, lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(both):
    ours, public = both
    assert ours.batch(ODD).to_pylist() == public(ODD)


def test_null_and_empty(both):
    assert both[0].batch([None, "", "a"]).to_pylist()[:2] == [[], []]
    assert both[0].batch([]).to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aest'l rvmd\n\t 09.!é 　"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_random_texts(both, texts):
    assert both[0].batch(texts).to_pylist() == both[1](texts)


def test_table_is_refilled_and_grows(both, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 10)
    monkeypatch.setattr(encode, "_KNOWN_BITS", 8)
    small = encode.Encoder(encode.load_tables(encode.BYTE_BPE_50K))
    small.forget(8)
    texts = [" ".join(f"w{i * 7919 % 1009}" for i in range(k, k + 150)) for k in range(0, 900, 150)]
    for t in texts:
        assert small.batch([t]).to_pylist() == both[1]([t])


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (1, "Hello world", 6)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, tuple(r.ids)) for r in encode.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, (15496, 995)), (1, (15496, 995)), (2, ()), (3, ())]
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_heap_equals_matrix(both):
    ours = both[0]
    rng = np.random.default_rng(5)
    for _ in range(30):
        word = bytes(rng.choice(list(b"abcdeth"), rng.integers(2, 60)))
        ids = ours.single[np.frombuffer(word, np.uint8)]
        row = ours._matrix(ids[None].astype(np.int32).copy())[0]
        assert ours._heap(ids.tolist()) == [x for x in row.tolist() if x >= 0]


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_unequal_pieces_of_equal_hash(both, n):
    texts = [thue_morse(n, 0) + " x", thue_morse(n, 1) + " x", thue_morse(n, 0)]
    assert both[0].batch(texts).to_pylist() == both[1](texts)
    assert both[0].batch(texts[::-1]).to_pylist() == both[1](texts[::-1])


def test_hashes_that_all_collide(both, monkeypatch):
    monkeypatch.setattr(encode.Hasher, "of", lambda self, start, end: np.full(len(start), 5, np.uint64))
    ours = encode.Encoder(encode.load_tables(encode.BYTE_BPE_50K))
    for texts in (["one two three one", "two 12"], ["", "three's a crowd", "one"]):
        assert ours.batch(texts).to_pylist() == both[1](texts)
