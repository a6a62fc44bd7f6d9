"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as numpy tiles: exclusive-or, bit count, compare. Distinct fingerprints are dealt into tiles
by their population count, and a pair of tiles whose counts differ by more than the radius is skipped, as no two of
their fingerprints can be that near; within a pair the counts of the low halves narrow the comparison further. A pair
of tiles yields a spanning forest of its links, never all of them, so a large group of near copies costs no more rows
than it has members and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import collect_garbage, drop, materialise
from tidemark.llm.graph import connected_components
from tidemark.llm.words import MULTIPLIER, mix, plain_hashes, slices

SEED = 42
TILE, MOST_TILE, MOST_PAIRS = 1 << 16, 1 << 20, 1 << 20
CHUNK = 1 << 15
SAMPLE, COMMON = 20_000, 500_000
MOST_IDS = 1 << 19  # pairs that are confirmed at once: their ids are broadcast, their sets travel


def bit_majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set where over half of a run's hashes have it."""
    out = np.zeros(len(starts), dtype=np.uint64)
    ones = np.zeros((len(starts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(starts)), counts)
    for at in range(0, len(hashes), CHUNK):
        part, own = hashes[at : at + CHUNK], owner[at : at + CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    for bit in range(64):
        out |= (ones[:, bit] * 2 > counts).astype(np.uint64) << np.uint64(63 - bit)
    return out


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of the word shingles of a text, repeats included; the whole sequence where it is shorter, none if empty."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at the six ASCII spaces
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for each row of df; fp is the 64-bit fingerprint as a signed long, 0 for null, empty and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            lists = [np.array(shingle_hashes(x.as_py(), shingle), dtype=np.uint64) for x in part.column(1)]
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            prints = bit_majority(np.concatenate(lists), np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; root[x] <= x always, and points at the tree's least node on return."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def compare_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs within the radius, of one tile (right None) or between two."""
    low = np.uint64(0xFFFFFFFF)
    own = right is None
    right = left if own else right
    left_low, right_low = np.bitwise_count(left & low).astype(np.int64), np.bitwise_count(right & low).astype(np.int64)
    a_order, b_order = np.argsort(left_low, kind="stable"), np.argsort(right_low, kind="stable")
    a, b, a_low, b_low = left[a_order], right[b_order], left_low[a_order], right_low[b_order]
    # |low difference| + |high difference| <= radius, and both sum to the difference of the tiles' population counts
    apart = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0])) if len(a) and len(b) else 0
    below, above = (radius - apart) // 2, (radius + apart) // 2
    nodes = a if own else np.concatenate((a, b))
    root, shift = np.arange(len(nodes)), 0 if own else len(a)
    limit = np.uint8(radius)
    for value in np.unique(a_low).tolist():
        a_from, a_to = np.searchsorted(a_low, [value, value + 1])
        b_from, b_to = np.searchsorted(b_low, [value - below, value + above + 1])
        for x in range(a_from, a_to, 64):
            block = a[x : min(x + 64, a_to), None]
            for y in range(max(b_from, x) if own else b_from, b_to, 1024):
                near = np.bitwise_count(block ^ b[None, y : min(y + 1024, b_to)]) <= limit
                if near.any():
                    i, j = np.nonzero(near)
                    _unite(root, i + x, j + y + shift)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning forest per pair of tiles over distinct fingerprints fp that differ in at most radius bits.

    Tiles hold fingerprints of one population count, about `tile` at most, more where there are many pairs of tiles; the
    counts of the 65 population counts are all that the driver sees. Comparisons grow with the square of the number of
    distinct fingerprints: 250,000 take some 24 CPU seconds, ten million about eleven CPU hours.
    """
    prints = prints.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    counts = {r[0]: r[1] for r in prints.groupBy("pop").count().collect()}
    pairs_of = lambda c: sum(n * (n + 1) // 2 + n * sum(c.get(p + d, 0) for d in range(1, radius + 1)) for p, n in c.items())
    chunks = {p: -(-n // tile) for p, n in counts.items()}
    while pairs_of(chunks) > MOST_PAIRS and tile < MOST_TILE:  # a tile is sent to each of its partners: larger ones are sent less often
        tile *= 2
        chunks = {p: -(-n // tile) for p, n in counts.items()}
    if not counts:
        return prints.sparkSession.createDataFrame([], "u long, v long")
    table = F.create_map(*[F.lit(int(x)) for p, n in chunks.items() for x in (p, n)])
    tiles = (
        prints.withColumn("chunk", F.pmod(F.xxhash64("fp"), table[F.col("pop")]).cast("int"))
        .groupBy("pop", "chunk").agg(F.sort_array(F.collect_list("fp")).alias("tile"))
    )
    pairs = pairs_of(chunks)
    chunks_of = F.coalesce(table[F.col("q")], F.lit(0))
    right_keys = F.filter(F.sequence("pop", F.col("pop") + radius), lambda q: F.map_contains_key(table, q))
    left_keys = F.filter(F.sequence(F.col("pop") - radius, F.col("pop")), lambda q: F.map_contains_key(table, q))
    as_left = (
        tiles.withColumn("q", F.explode(right_keys)).withColumn("j", F.explode(F.sequence(F.lit(0), chunks_of - 1)))
        .filter("q > pop OR j >= chunk").select(F.col("pop").alias("p"), F.col("chunk").alias("i"), "q", "j", F.col("tile").alias("a"))
    )
    as_right = (
        tiles.withColumn("q", F.explode(left_keys)).withColumn("i", F.explode(F.sequence(F.lit(0), chunks_of - 1)))
        .filter("q < pop OR i <= chunk").select(F.col("q").alias("p"), "i", F.col("pop").alias("q"), F.col("chunk").alias("j"), F.col("tile").alias("b"))
    )
    width = min(pairs, 4 * max(prints.sparkSession.sparkContext.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = ["p", "i", "q", "j"]
    met = as_left.repartition(width, *keys).join(as_right.repartition(width, *keys).hint("shuffle_hash"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                p, i, q, j = (batch.column(k)[n].as_py() for k in range(4))
                a, b = (batch.column(k)[n].values.to_numpy().view(np.uint64) for k in (4, 5))
                u, v = compare_tiles(a, None if (p, i) == (q, j) else b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits), component_id, the smallest id reachable by links.

    Rows with equal fingerprints are linked, blank texts among them. A null id keeps its row and its links but names no
    component; a component of null ids alone has a null component_id. Repeated rows stay, other columns are dropped, those
    named like the results too. Texts of any length count whole; an empty table gives no rows.
    """
    prints = materialise(fingerprint(df, id_col, text_col, shingle), "prints")
    named = materialise(component_names(prints, radius, tile), "named")  # a scan, so that Spark can split the join where one fingerprint has many rows
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_names(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of prints (id, fp): the smallest id that links within the radius reach."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    members = connected_components(links(distinct, radius, tile))
    rooted = distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = members.select("root").distinct()
    linked = rooted.join(heads, "root", "left_semi")
    names = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(names, "root").select(F.col("fp").alias("fp2"), "component")
    return distinct.join(named, distinct["fp"] == named["fp2"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))


def shingle_runs(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, 64-bit hashes of all in a row), repeats included; a shorter text is one shingle, if it has words."""
    counts, words = plain_hashes(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    powers = [np.uint64(pow(MULTIPLIER, j + 1, 1 << 64)) for j in range(shingle)]
    size = max(0, len(words) - shingle + 1)
    grams = np.zeros(size, dtype=np.uint64)
    for j, power in enumerate(powers):
        grams += words[j : j + size] * power
    whole = owner[:size] == owner[shingle - 1 :] if size else np.zeros(0, dtype=bool)
    found, of = grams[whole], owner[:size][whole]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        rest = np.array([sum(int(words[first[n] + j]) * int(powers[j]) for j in range(counts[n])) + int(counts[n]) & (1 << 64) - 1 for n in short.tolist()], dtype=np.uint64)
        found, of = np.concatenate((found, rest)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return np.bincount(of, minlength=len(counts)), mix(found)


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text as sorted 32-bit hashes, and the texts' 64-bit fingerprints."""
    counts, runs = shingle_runs(texts, shingle)
    prints = bit_majority(runs, np.cumsum(counts) - counts, counts)
    key = np.unique((np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(32)) | (runs >> np.uint64(32)))
    ends = np.searchsorted(key, np.arange(1, len(counts), dtype=np.uint64) << np.uint64(32))
    return np.split(key.astype(np.uint32), ends) if len(counts) else [], prints


def shingle_set(text: str | None, shingle: int) -> bytes:
    """The distinct shingles of a text as sorted 32-bit hashes."""
    return shingle_sets([text], shingle)[0][0].tobytes()


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def rarest(df: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of what about SAMPLE rows of df share: an order for prefixes, right whatever the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(part.column(1).to_pylist(), shingle)[0]).view(np.int32))], names=["token"])

    share = max(1, df.count() // SAMPLE)
    some = df.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    common = some.mapInArrow(run, "token int").groupBy("token").count().filter("count > 2").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    keys, counts = common["token"].to_numpy().view(np.uint32), common["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(found: np.ndarray, size: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first `size` of the sorted shingles of a set, those that keys lacks before those it has, rare before common."""
    if len(keys) == 0:
        return found[:size]
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.lexsort((found, np.where(keys[at] == found, counts[at], 0)))[:size]]


def independent(edges: DataFrame) -> DataFrame:
    """(id): the nodes of edges (u < v) that go if, least first, each node stays that has no edge to one that stays."""
    gone = edges.select(F.col("v").alias("id")).limit(0)
    left = edges.count()
    while left:
        heads = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_anti").distinct()
        out = materialise(edges.join(heads, "u").select("v").distinct(), "out", rows=left)
        gone = gone.unionAll(out.select(F.col("v").alias("id")))
        edges = materialise(edges.join(out, "v", "left_anti").join(out.select(F.col("v").alias("u")), "u", "left_anti").select("u", "v"), "edges", rows=left)
        left = edges.count()
    return gone


def confirmed_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 6) -> DataFrame:
    """(id): the ids of df that go if, least id first, each stays whose shingles are like those of none that stays.

    Alike are sets with a Jaccard similarity of `similarity` or more, and every such pair is found. Equal sets count once.
    Fingerprints of the shingles within `radius` bits form components; the members of each are compared with its least id,
    where that surely stays, so a large group of near copies goes without a pair for any two of its members. An exact
    search finds what fingerprints miss: two sets that are alike share one of the first shingles of each in an order of
    all shingles, rare ones first. While that helps, each shingle's least id is compared with the others that have it;
    what is left is joined on shingles, by size and position, and each pair confirmed. The sets are written once and read
    for MOST_IDS pairs at a time, so disk beyond them doesn't grow with the pairs. Rows with null ids and texts
    without words are left out; rows that share an id count as one of their texts. Texts of any length are taken whole; an
    empty table gives no ids; columns of df other than these two play no part.
    """
    spark = df.sparkSession
    scratch: list[DataFrame] = []

    def keep(frame: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        scratch.append(materialise(frame, name, rows))
        collect_garbage(spark)
        return scratch[-1]

    def forget(*tables: DataFrame) -> None:
        for table in tables:
            scratch[:] = [t for t in scratch if t is not table]
            drop(table)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    order = spark.sparkContext.broadcast(rarest(rows, shingle))
    least = lambda n: math.ceil(similarity * n - 1e-9)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets, prints = shingle_sets(part.column(1).to_pylist(), shingle)
            firsts = [prefix(x, len(x) - least(len(x)) + 1, *order.value).view(np.int32) if len(x) else x.view(np.int32) for x in sets]
            sums = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            columns = [part.column(0), pa.array(sums, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints.view(np.int64)), pa.array(firsts, pa.list_(pa.int32())), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "size", "fp", "first", "shingles"])

    every = keep(rows.mapInArrow(start, "id long, digest long, size long, fp long, first array<int>, shingles binary").filter("size > 0"), "prefixes")
    named = every.groupBy("id").agg(F.min(F.struct("digest", "size")).alias("set")).select("id", "set.*")
    firsts = keep(named.groupBy("digest", "size").agg(F.min("id").alias("id")), "firsts")
    gone = keep(named.select("id").join(firsts.select("id"), "id", "left_anti"), "equal")
    own = firsts.select("id", F.col("digest").alias("_digest"), F.col("size").alias("_size"))
    narrow = every.select("id", "digest", "size", "fp", "first")  # the sets stay where they are
    chosen = keep(narrow.join(own, "id").filter("digest = _digest AND size = _size").dropDuplicates(["id"]).select(*narrow.columns), "chosen")
    forget(firsts)
    tokens = chosen.select("id", "size", F.posexplode("first").alias("at", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    tokens = keep(tokens.join(shared, "token").select("id", "size", "at", "token"), "tokens")
    wanted = tokens.select("id").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlap(a.as_py(), b.as_py()) >= similarity for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "met")
        parts = max(1, -(-pairs.count() // MOST_IDS))

        def side(some: DataFrame, name: str, content: str) -> DataFrame:
            asked = chosen.select("id", "digest", "size").join(F.broadcast(some.select(F.col(name).alias("id")).distinct()), "id", "left_semi")
            sets = every.join(F.broadcast(asked), ["id", "digest", "size"], "left_semi").dropDuplicates(["id"])  # only sets that are asked for travel
            return sets.select(F.col("id").alias(name), F.col("shingles").alias(content))

        done = []
        for n in range(parts):  # however many pairs there are, the sets of so many at once take disk
            some = pairs.filter(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == n)
            met = some.join(side(some, "u", "a"), "u").join(side(some, "v", "b"), "v").select("u", "v", "a", "b")
            done.append(keep(met.mapInArrow(compare, "u long, v long"), "confirmed"))
        forget(pairs)
        return reduce(DataFrame.unionAll, done)

    prints = keep(chosen.select("id", "fp").join(wanted, "id", "left_semi"), "prints")
    linked = prints.join(keep(component_names(prints, radius), "named"), "fp").filter("id <> component_id").select(F.col("component_id").alias("u"), F.col("id").alias("v"))
    least_of = tokens.groupBy("token").agg(F.min("id").alias("u"))
    later = tokens.join(least_of, "token").filter("u < id").select(F.col("id").alias("u")).distinct()
    out = confirm(linked.join(later, "u", "left_anti")).select(F.col("v").alias("id")).distinct()
    gone = gone.unionAll(out)
    before, tokens = tokens, keep(tokens.join(out, "id", "left_anti"), "tokens")
    forget(before)
    left = tokens.select("id").distinct().count()
    while left:
        heads = tokens.groupBy("token").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        near = keep(tokens.join(heads, "token").filter("id <> u").select("u", F.col("id").alias("v")).distinct(), "near")
        first = near.select("u").join(near.select(F.col("v").alias("u")), "u", "left_anti").distinct()
        out = confirm(near.join(first, "u")).select(F.col("v").alias("id")).distinct()
        gone = gone.unionAll(out)
        settled = out.unionAll(first.select(F.col("u").alias("id")))  # a head has met all that could be like it
        before, tokens = tokens, keep(tokens.join(settled, "id", "left_anti"), "tokens")
        forget(before, near)
        went = out.count()
        if 20 * went < left:
            break
        left = tokens.select("id").distinct().count()
    a, b = (tokens.select("token", *[F.col(c).alias(p + c) for c in ("id", "size", "at")]) for p in "ab")
    enough = (F.col("asize") + F.col("bsize")) * (similarity / (1 + similarity)) - 1e-6
    fits = F.least(F.col("asize") - F.col("aat"), F.col("bsize") - F.col("bat")) >= enough
    pairs = a.join(b, "token").filter((F.col("aid") < F.col("bid")) & fits).select(F.col("aid").alias("u"), F.col("bid").alias("v")).distinct()
    found = materialise(gone.unionAll(independent(confirm(pairs))), "gone")
    forget(*scratch)
    return found


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4, radius=4)
