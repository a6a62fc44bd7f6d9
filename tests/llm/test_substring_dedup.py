import hashlib
import random
import re

from tidemark.llm import substring_dedup


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for n in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[n : n + window])] = min(i, least.get(tuple(w[n : n + window]), i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for n in range(len(w) - window + 1):
            if i is not None and least[tuple(w[n : n + window])] < i:
                gone.update(range(n, n + window))
        left = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randrange(400))
    shared = [[word() for _ in range(n)] for n in (13, 20, 55, 200)]
    rows = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            at, low = rng.randrange(len(text) + 1), rng.randrange(len(s))
            text[at:at] = s[low : low + rng.randrange(1, len(s) + 1)]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(text)))
    rng.shuffle(rows)
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (201, "other text"), (300, None), (301, ""), (None, rows[3][1]), (302, "a " * 3_000), (303, "a " * 14), (1, "Á é x " * 30), (304, "Á é x " * 30)]
    rows += [(1_000 + n, " ".join(shared[2])) for n in range(60)]
    frame = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, hash string")
    for shard in (substring_dedup.SHARD_ROWS, 20):
        out = substring_dedup.dedup_substrings(frame, shard_rows=shard)
        got = out.select("doc_id", "n_words", "n_removed", substring_dedup.kept_digest(out.kept_text).alias("k"), "text", "kept_text", "hash").collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows)
        assert all(r.kept_text == r.text for r in got if not r.n_removed) and {r.hash for r in got} == {"y"}
    assert substring_dedup.dedup_substrings(frame.limit(0)).count() == 0
