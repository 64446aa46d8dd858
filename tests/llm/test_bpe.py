import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe as M

PATH = M.vocabulary_path()
LIB = Tokenizer.from_file(PATH)
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x\n y ", "  <|endoftext|>  z", "a<|endoftext|><|endoftext|>", "don't we'll I'D", "日本語 テスト 123 ½²", "é     x \x1c y \x85 z", "\t\ttab  \t end   ", "🙂🙂 👩‍👩‍👧", "a" * 500, "=" * 300 + " " * 70 + "x", "Thhaheble, thend. Sttible"]


def same(text):
    ids = M.encode([text], PATH)[0]
    assert ids == LIB.encode(text, add_special_tokens=False).ids, text
    assert M.encoder(PATH)[0].decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sreTHEtheng0123,.|<>é日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    same(text)


def test_every_token_of_the_vocabulary():
    enc = M.encoder(PATH)[0]
    words = [b for b in enc.bytes if b.decode("utf-8", "ignore").encode() == b]
    got = enc.encode_words(words)
    for word in random.Random(1).sample(words, 4000):
        parts = LIB.model.tokenize("".join(M.byte_letters()[b] for b in word))
        assert got[word] == [p.id for p in parts]


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(a, b, "q", 2) for a, b in rows], "doc_id long, text string, n_tokens string, ids int")
    want = []
    for d, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted([tuple(r) for r in M.bpe_digests(df, PATH).collect()], key=str) == sorted(want, key=str)
    assert M.bpe_digests(df.limit(0), PATH).count() == 0


def test_the_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(M.encoder(PATH)[1], "size", 3)
    for text in ["one two three four", "four five six", "one two three four", "six"]:
        same(text)
    assert len(M.encoder(PATH)[1].young) < 10


def test_a_very_long_text_and_word(spark):
    texts = ["word né " * 300_000, "x" * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in M.encode_column(df, PATH, out_col="doc_id2").collect():
        assert r.doc_id2 == LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert [r.ids for r in M.encode_column(spark.createDataFrame([(None,), ("",)], "text string"), PATH).collect()] == [[], []]


def test_memory_does_not_go_by_the_batch():
    """numpy's and Python's part of it; a batch of 5.7 MB took 92 MB when it was encoded at once."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 500)) for _ in range(2000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    next(M.digest_batches([batch.slice(0, 1)], PATH))  # the vocabulary is read
    tracemalloc.start()
    got = next(M.digest_batches([batch], PATH))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == len(texts) and peak < 45_000_000, peak
