import os
import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import token_counts
from tidemark.llm.tokens import ByteTokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_equal_the_tokenizer(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("word" + str(rng.randrange(99)) for _ in range(rng.randrange(300)))) for i in range(300)]
    rows += [(None, "x y"), (2**62, None), (-5, ""), (7, "again " * 50_000), (7, "again " * 50_000), (1, "<|endoftext|> é 🙂")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    plain = ByteTokens(RANKS, public_tokenizers.PATTERN)
    want = sorted(((i, len(plain.ids(t or ""))) for i, t in rows), key=str)
    for block in (64, token_counts.BLOCK):
        got = token_counts.count_tokens(frame, RANKS, public_tokenizers.PATTERN, block=block).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    assert token_counts.count_tokens(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("split_blocks", [1, 3, 1000])
@pytest.mark.parametrize("keys", [0, 2])
def test_scan_of_split_files(spark, tmp_path, split_blocks, keys):
    rng, block, want = np.random.default_rng(split_blocks), 8, []
    for n in range(3):
        ids, file = [], tmp_path / f"f{n}.bin"
        for ordinal, size in enumerate(rng.choice([0, 1, 2, 7, 8, 9, 40, 100], 60).tolist()):
            own = [*rng.integers(0, 99, keys).tolist(), *rng.integers(100, 50_000, size).tolist()]
            want.append((f"f{n}.bin", ordinal, len(ids), size, own[: max(keys, 1)]))
            ids += [*own, token_counts.SEPARATOR]
        ids += [token_counts.FILLER] * (-(len(ids) + 1) % block) + [token_counts.SEPARATOR]
        np.array(ids, dtype="<u2").tofile(file)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(2 * block * split_blocks))
    try:
        got = token_counts.scan_tokens(spark, str(tmp_path), keys=keys, block=block).collect()
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    got = sorted((os.path.basename(r.file), r.ordinal, r.start, r.n_tokens, r.key_ids) for r in got)
    assert [g for g in got if g[1] < 60] == [w for w in sorted(want) if w[1] < 60]
