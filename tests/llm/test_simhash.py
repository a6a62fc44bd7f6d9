import re

import numpy as np
import xxhash

from tidemark.llm import simhash


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, f"{prints[n]:016x}", least.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)] + ["É", "Straße", "ABC"]
    base = [" ".join(rng.choice(words, n)) for n in (5, 40, 200, 400, 3, 1)]
    rows = []
    for text in base:
        parts = text.split()
        for _ in range(8):
            changed = list(parts)
            changed[rng.integers(len(parts))] = "Zed"
            rows.append(" ".join(changed))
        rows += [text, text.upper(), text + "\n\t"]
    rows += [None, "", "  \t ", "x" * 200_000, "a b " * 30_000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)] + [(None, base[2]), (0, rows[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame, tile=16).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_tiles_lose_no_link():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)
    prints = np.unique(seeds[:, None] ^ flips)
    for a_pop in np.unique(np.bitwise_count(prints)):
        for b_pop in range(a_pop, a_pop + 5):
            a, b = prints[np.bitwise_count(prints) == a_pop], prints[np.bitwise_count(prints) == b_pop]
            if len(b) == 0:
                continue
            u, v = simhash.compare_tiles(a, None if a_pop == b_pop else b, 4)
            root = {int(x): int(x) for x in np.concatenate((a, b))}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in zip(u.tolist(), v.tolist()):
                assert find(x) != find(y)
                root[find(x)] = find(y)
            for x in a.tolist():
                for y in b.tolist():
                    if (x ^ y).bit_count() <= 4:
                        assert find(x) == find(y)


def test_columns_named_like_the_results(spark):
    rows = [(1, "a b c d e", 9, "f", 8), (2, "a b c d e", 9, "f", 8), (3, "other words stand here now", 9, "f", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id int, fingerprint string, component_id int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
