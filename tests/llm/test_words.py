"""Hashes of words in numpy against words found one by one."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity, words
from tidemark.llm.words import Numbers

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("aAbBéÉß_9 \n\t\x0b.,'İΣς²"), st.characters()), max_size=40)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_folded_words(texts):
    counts, (whole, four) = words.folded_hashes(texts, (4,))
    every = [words.folded(t) for t in texts]
    assert counts.tolist() == [len(w) for w in every]
    flat = [w for own in every for w in own]
    for names, hashes in ((flat, whole.tolist()), ([w[:4] for w in flat], four.tolist())):
        assert len(set(names)) == len(set(hashes)) == len(set(zip(names, hashes)))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_plain_words(texts):
    counts, hashes = words.plain_hashes(texts)
    every = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in every]
    flat = [w for own in every for w in own]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))


def test_long_texts_and_words():
    step, words.STEP = words.STEP, 16
    try:
        text = "one two " * 50 + "x" * 300 + " one"
        counts, (hashes,) = words.folded_hashes([text, "one"])
        assert counts.tolist() == [102, 1] and len({*hashes[[0, 2, 101, 102]].tolist()}) == 1 and len({*hashes.tolist()}) == 3
    finally:
        words.STEP = step


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([None if n % 7 == 0 else "x" * (n * n) for n in range(100)])], names=["id", "text"])
    parts = list(words.slices(iter([batch, batch.slice(0, 0)]), "text", 1_000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(100))
    assert all(p.num_rows == 1 or sum(len(t or "") + 64 for t in p.column(1).to_pylist()) <= 1_000 for p in parts)


def test_codes_of_texts_equal_codes_of_words():
    texts = ["Der Hund und the cat", None, "", "É scum idiots", "loweient x"]
    memo = Numbers(toxicity.pack_word)
    assert all(np.array_equal(a, toxicity.packed(t, memo)) for a, t in zip(toxicity.packed_texts(texts), texts))
    assert toxicity.packed_texts([]) == []
