import random
import re

import numpy as np

from tidemark.llm import decontaminate


def brute(docs, items, least=13):
    out = set()
    for d, text in docs:
        a = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            b = re.findall(r"\w+", (item or "").lower())
            for shift in range(-len(b) + 1, len(a)):
                pairs = [(p, p - shift) for p in range(max(0, shift), min(len(a), len(b) + shift))]
                best, run, start = 0, 0, 0
                for n, (p, q) in enumerate(pairs):
                    run += 1 if a[p] == b[q] else -4
                    if run <= 0:
                        run, start = 0, n + 1
                    best = max(best, run)
                    if run == best and run > 0:
                        span = (start, n + 1)
                if best and (span[1] - span[0] >= min(least, len(b))) and (len(b) >= decontaminate.SPAN or span[1] - span[0] == len(b)):
                    out.add((d, i))
    return out


def test_finds_passages_with_exchanged_words(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(5_000))
    items = [(i, " ".join(word() for _ in range(rng.choice([15, 20, 40, 59])))) for i in range(30)] + [(90, "Short one here"), (91, None), (92, ""), (93, items_long := " ".join(word() for _ in range(300)))]
    docs = []
    for n in range(45):
        text = [word() for _ in range(rng.randrange(5, 120))]
        if n % 3 == 0:
            passage = items[n // 3 % 30][1].upper().split()
            for _ in range(len(passage) // 15):
                passage[rng.randrange(len(passage))] = "other"
            text[3:3] = passage
        docs.append((n, ", ".join(text)))
    docs += [(500, None), (501, ""), (502, "a short one here"), (503, items_long), (504, " ".join(items_long.split()[100:130])), (505, "x " * 3_000), (None, items[0][1]), (503, items_long)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_WORDS, 1_000):
        rows = decontaminate.overlaps(frame, bench, block_words=size).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
        assert all(5 * r.matches >= 4 * r.length for r in rows)
    assert sum(r.doc_id == 503 and r.item_id == 93 for r in rows) == 2
    assert decontaminate.overlaps(frame.limit(0), bench).count() == 0
    assert decontaminate.overlaps(frame, bench.limit(0)).count() == 0


def qualifying(equal, need):
    return [(a, b) for a in range(len(equal)) for b in range(a + need, len(equal) + 1) if 5 * sum(equal[a:b]) >= 4 * (b - a)]


def test_longest_runs_against_every_run():
    rng = random.Random(5)
    for _ in range(400):
        equal = [rng.random() < rng.choice([0.6, 0.8, 0.9]) for _ in range(rng.randrange(0, 50))]
        found = decontaminate.longest_runs(np.array(equal, dtype=bool), 13)
        every = qualifying(equal, 13)
        assert [n for _, n, _ in found[:1]] == [max(b - a for a, b in every)] if every else found == []
        assert all((start, start + n) in every and m == sum(equal[start : start + n]) for start, n, m in found)
        assert all(any(a < start + n and start < b for start, n, _ in found) for a, b in every)
        assert len({p for start, n, _ in found for p in range(start, start + n)}) == sum(n for _, n, _ in found)


def test_every_overlap_of_four_words_in_five(spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in (13, 16, 17, 60)]
    changed = lambda item, at: ["other" if k in at else w for k, w in enumerate(item)]
    texts = [changed(items[0], {2}), changed(items[0], {0, 6}), changed(items[1], {4, 11}), changed(items[2], {8, 13}), changed(items[0], {2, 5, 8}), changed(items[3], range(20, 40))]
    docs = [(n, " ".join(["before", *t, "after"]), None) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, other string")
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id long, text string")
    rows = sorted(tuple(r) for r in decontaminate.overlaps(frame, bench).collect())
    assert rows == [(0, 0, 1, 0, 13, 12), (1, 0, 1, 0, 13, 11), (2, 1, 1, 0, 16, 14), (3, 2, 1, 0, 17, 15), (5, 3, 1, 0, 25, 20), (5, 3, 36, 35, 25, 20)]


def test_both_runs_of_a_diagonal(spark):
    item = [f"i{k}" for k in range(100)]
    text = ["other" if 30 <= k < 60 else w for k, w in enumerate(item)]
    frame, bench = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    rows = decontaminate.overlaps(frame, bench).collect()
    covered = {p for r in rows for p in range(r.doc_start, r.doc_start + r.length)}
    assert {*range(30), *range(60, 100)} <= covered and len(rows) == 2


def test_equal_words_do_not_pile_up():
    block = decontaminate.Block([(1, decontaminate.word_hashes(["x " * 1_000])[0])])
    hits, decontaminate.HITS = decontaminate.HITS, 4_000
    try:
        hashes = decontaminate.word_hashes(["x " * 3_000])[0]
        found = block.diagonals(hashes, np.array([0, 3_000]))
        assert len(found) == len({*map(tuple, found.tolist())}) and {r[2] for r in found.tolist()} >= set(range(2_001))
    finally:
        decontaminate.HITS = hits
