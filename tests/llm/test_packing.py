import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
WORDS = WordTokens(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbß'sdrelv 0²\n\t.,!<|>éÉΣİſŉ́ ½x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_equal_whole_texts(text):
    assert WORDS.ids(text) == np.array(PLAIN.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("counts", [{}, {1: 5}, {4096: 3}, {4095: 2, 1: 1}, {100: 1000, 3000: 7}, {2049: 9}, {n: 1 + n % 3 for n in range(1, 4097, 37)}])
def test_solve_covers_exactly(counts):
    got = defaultdict(int)
    sequences = 0
    for lengths, copies in packing.solve(counts):
        assert copies > 0 and 0 < sum(lengths) <= 4096
        sequences += copies
        for n in lengths:
            got[n] += copies
    assert dict(got) == counts
    bound = max(-(-sum(n * c for n, c in counts.items()) // 4096), sum(c for n, c in counts.items() if n > 2048))
    assert sequences <= bound * 1.02 + 2


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes, values, limits = rng.integers(1, 12, 4), rng.random(4), rng.integers(1, 4, 4)
        found = packing.price(sizes, values, limits, 20)
        best = max((sum(v * t for v, t in zip(values, times)), times) for times in np.ndindex(*(limits + 1)) if sum(s * t for s, t in zip(sizes, times)) <= 20)
        assert sum(sizes[i] * t for i, t in found.items()) <= 20 and all(t <= limits[i] for i, t in found.items())
        assert abs(sum(values[i] * t for i, t in found.items()) - best[0]) < 1e-9


def test_pack(spark):
    rows = [(i, "Word " * (i * 37 % 700)) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 9_000)] + [(7, "same")] * 40 + [(None, "x")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    got = packing.pack(frame, PATH).collect()
    want = []
    for i, text in rows:
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.pack(frame.limit(0), PATH).count() == 0


@pytest.mark.parametrize("low, high, gap", [(50, 3_000, 0.002), (1_200, 1_600, 0.03)])
def test_solve_against_its_bound_and_best_fit(low, high, gap):
    lengths, counts = np.random.default_rng(1).integers(low, high, 12_000), defaultdict(int)
    for n in lengths.tolist():
        counts[n] += 1
    used = sum(c for _, c in packing.solve(counts))
    assert used <= sum(c for _, c in packing.best_fit(counts, 4096))
    sizes = np.array(sorted(counts))
    unit = 8 if high == 3_000 else 1
    classes = np.unique(sizes // unit)  # rounded down: a bound for the real lengths
    numbers = np.array([sum(counts[n] for n in sizes.tolist() if n // unit == c) for c in classes.tolist()])
    bound = packing.fractional(classes, numbers, 4096 // unit, 2_400)[1]
    assert bound <= used <= (1 + gap) * max(bound, lengths.sum() / 4096) + 1


def test_a_length_that_most_pieces_share(spark):
    rows = [(i, "word " * (5 if i % 10 else 5 + i % 97)) for i in range(2_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(r.doc_id for r in got) == list(range(2_000))
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
