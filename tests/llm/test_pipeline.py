"""The pipeline on a small corpus: each stage does what it says, on all that the one before kept."""

import random

from pyspark.sql import functions as F

from tidemark.llm import simhash


def write_corpus(spark, path):
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(5_000))
    prose = lambda n: [word() for _ in range(n)]
    docs, labels = {}, {}
    for i in range(400):
        docs[i] = prose(rng.randrange(60, 200))
        labels[i] = int(i % 5 == 0)
        if labels[i]:
            for _ in range(4):
                docs[i].insert(rng.randrange(len(docs[i])), rng.choice(["idiot", "scum", "moron"]))
    bench = [(n, " ".join(prose(30))) for n in range(5)]
    base = prose(400)
    docs[1_000], docs[1_001], docs[1_002] = base, list(base), [*base[:200], "changed", *base[201:]]
    passage = prose(60)
    docs[1_010], docs[1_011] = prose(100) + passage, prose(50) + passage + prose(50)
    docs[1_020] = prose(40) + bench[3][1].split() + prose(40)
    docs[1_030] = prose(5_000)
    rows = [(i, " ".join(t), "en", "src0", len(" ".join(t))) for i, t in docs.items()] + [(2_000, None, None, None, None), (2_001, "", "en", "s", 0), (None, "some words", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, labels, docs


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows, labels, words = write_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if n < 4:
            assert docs.columns == pipeline.COLUMNS
        seen.append({r.doc_id: r.text for r in docs.collect()} if n < 4 else docs.collect())
    clean = {i for i in range(400) if not labels[i]}
    assert len(clean - {*seen[0]}) <= 3 and sum(i in seen[0] for i in range(400) if labels[i]) <= 5
    assert {*seen[0]} - {*seen[1]} == {1_001, 1_002}
    assert {*seen[2]} == {*seen[1]}
    assert seen[2][1_010] == seen[1][1_010] and seen[2][1_011].split() == words[1_011][:50] + words[1_011][110:]
    assert {*seen[2]} - {*seen[3]} == {1_020}
    assert {r.doc_id for r in seen[4]} == {*seen[3]} and {2_000, 2_001, None} <= {*seen[3]}
    whole = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {*seen[3]}
    used = whole.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.agg(F.max("n")).first()[0] <= 4096


def test_confirmed_copies_are_similar(spark):
    rng = random.Random(13)
    rows, texts = [], {}
    for g in range(12):
        base = [f"v{rng.randrange(3_000)}" for _ in range(rng.choice([30, 120, 300]))]
        for c in range(7):
            own = list(base)
            for _ in range(c * len(own) // 60):
                own[rng.randrange(len(own))] = "new" + str(rng.randrange(99))
            texts[len(texts)] = " ".join(own)
    rows = [(i, t, "") for i, t in texts.items()] + [(None, texts[0], ""), (900, None, ""), (901, "", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component string")
    gone = {r.id for r in simhash.confirmed_copies(frame).collect()}
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    like = lambda a, b: simhash.overlap(sets[a], sets[b]) >= 0.8
    kept = {*texts} - gone
    assert gone <= {*texts} and all(any(like(g, k) for k in kept) for g in gone)
    missed = [(a, b) for a in kept for b in kept if a < b and like(a, b)]
    assert len(missed) <= 0.1 * len(gone)
    assert simhash.confirmed_copies(frame.limit(0)).count() == 0


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component long, hash string, piece int"
    odd = [(1, None, None, None, None, 0.5, 1, "h", 1), (None, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 0.5, 1, "h", 1), (2, "", "en", "s", 0, 0.5, 1, "h", 1), (3, "one", None, "s", 3, None, None, None, None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], odd):
        frame = spark.createDataFrame(rows, schema)
        for n, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            if n < 4:
                assert out.columns == pipeline.COLUMNS
            assert out.count() == (0 if not rows else 4 if name == "near_duplicates" else 5)


def test_long_groups_are_settled_to_the_end(spark):
    rng = random.Random(17)
    words = [f"c{k}" for k in range(300)]
    texts = {}
    for step in range(36):
        for k in range(3):
            words[(step * 3 + k) * 47 % 300] = f"s{step}n{k}"
        texts[step] = " ".join(words)
        texts[1_000 + step] = texts[step].upper()
    rows = list(texts.items())
    rng.shuffle(rows)
    gone = {r.id for r in simhash.confirmed_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    kept = set()
    for i in sorted(texts):
        if all(simhash.overlap(sets[i], sets[k]) < 0.8 for k in kept):
            kept.add(i)
    assert len(kept) > 7 and {i for i in texts if i >= 1_000} <= gone
    assert all(any(simhash.overlap(sets[g], sets[k]) >= 0.8 for k in {*texts} - gone) for g in gone)


def test_every_pair_of_near_copies_is_found(spark):
    rng = random.Random(19)
    texts, line = {}, [f"l{k}" for k in range(30)]
    for g in range(60):
        base = [f"v{rng.randrange(9_000)}" for _ in range(rng.choice([12, 60, 200, 400]))] + line * (g % 2)
        for share in (0, 0, 0.01, 0.02, 0.02, 0.03):
            own = [f"new{rng.randrange(99)}" if rng.random() < share else w for w in base]
            texts[rng.randrange(1 << 40)] = " ".join(own[: len(own) - rng.randrange(3)])
    rows = [(i, t) for i, t in texts.items()]
    gone = [r.id for r in simhash.confirmed_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sets, kept = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}, set()
    for i in sorted(texts):
        if all(simhash.overlap(sets[i], sets[k]) < 0.8 for k in kept):
            kept.add(i)
    assert {*texts} - {*gone} == kept and len(gone) == len({*gone})


def test_chains_are_settled_least_first(spark):
    edges = [(a, b) for a in range(30) for b in (a + 1, a + 2)]
    gone = {r.id for r in simhash.independent(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert gone == {n for n in range(31) if n % 3}


def test_sets_are_written_once_and_confirmed_in_parts(spark, monkeypatch):
    rng = random.Random(23)
    texts = {}
    for g in range(8):
        base = [f"v{rng.randrange(9_000)}" for _ in range(120)]
        for share in (0, 0, 0.01, 0.02):
            texts[rng.randrange(1 << 40)] = " ".join(f"new{rng.randrange(99)}" if rng.random() < share else w for w in base)
    rows = [*texts.items(), next(iter(texts.items()))]
    written, write = [], simhash.materialise

    def spy(df, name, rows=None):
        written.append((name, "binary" in dict(df.dtypes).values()))
        return write(df, name, rows)

    monkeypatch.setattr(simhash, "materialise", spy)
    monkeypatch.setattr(simhash, "MOST_IDS", 3)
    gone = [r.id for r in simhash.confirmed_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sets, kept = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}, set()
    for i in sorted(texts):
        if all(simhash.overlap(sets[i], sets[k]) < 0.8 for k in kept):
            kept.add(i)
    names = [n for n, _ in written]
    assert sum(binary for _, binary in written) == 1 and names.count("confirmed") > names.count("met")
    assert {*texts} - {*gone} == kept and len(gone) == len({*gone})


def test_texts_need_no_shuffle_to_lose_copies(spark, tmp_path):
    import corpus_pipeline

    write_corpus(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.filter("doc_id IN (1001, 1002)").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
