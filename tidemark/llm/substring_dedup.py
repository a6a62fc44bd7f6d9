"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words. Anchors narrow the search: the least hash among the short phrases of a window
is the same wherever the window occurs, so a window can recur only where its anchor occurs in two documents. Stretches
of text around such anchors become contexts, shared contexts confirm the recurring windows, and these are compiled
into Aho-Corasick automata over words, sharded by anchor and of bounded size. All documents' contexts are streamed
through the automata of their shards to locate every occurrence; what a window that starts in a document with a
smaller id covers is cut. A shard that many documents share is streamed in slices, each with its own copy of the
patterns, so copies never gather in one task; where its patterns are many, they are dealt anew by whole windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tidemark.llm.common import drop, materialise

WINDOW, PHRASE = 13, 5
SHARD_ROWS = 20_000
MOST_WINDOWS = 64
CHUNK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LETTERS = np.random.default_rng(0).integers(1, 1 << 63, 256, dtype=np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, as UTF-8."""
    return (text or "").encode().split()


class Words:
    """The words of some texts of an Arrow column, as places in its bytes and 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        self.bytes = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        inside = ~SPACES[self.bytes]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True  # a word ends with its text
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets[:-1])
        self.hashes = np.zeros(len(self.start), dtype=np.uint64)
        low = 0
        while low < len(self.start):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + CHUNK)))
            self.hashes[low:high] = self._hash(low, high)
            low = high

    def _hash(self, low: int, high: int) -> np.ndarray:
        begin, end = self.start[low:high], self.end[low:high]
        sizes = end - begin
        first = np.cumsum(sizes) - sizes
        within = np.arange(sizes.sum()) - np.repeat(first, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), MULTIPLIER, dtype=np.uint64))
        letters = LETTERS[self.bytes[within + np.repeat(begin, sizes)]] * powers[within]
        out = np.add.reduceat(letters, first)
        return (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)

    def anchors(self, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
        """(window numbers, anchors) of all windows; a window has the number of its first word."""
        n = len(self.hashes) - window + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        grams, factor = np.zeros(len(self.hashes) - phrase + 1, dtype=np.uint64), 1
        for j in range(phrase):
            factor = factor * MULTIPLIER % (1 << 64)
            grams += self.hashes[j : j + len(grams)] * np.uint64(factor)
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        grams ^= grams >> np.uint64(32)
        least, reach, need = grams, 1, window - phrase + 1
        while reach < need:  # minimum over the next `reach` phrases, doubled up to `need`
            step = min(reach, need - reach)
            least, reach = np.minimum(least[:-step], least[step:]), reach + step
        whole = np.flatnonzero(self.text[:n] == self.text[window - 1 :])
        return whole, least[whole].view(np.int64)

    def runs(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Where runs of following windows with one anchor in one text begin."""
        if not len(at):
            return np.zeros(0, dtype=bool)
        return np.concatenate(([True], (np.diff(at) > 1) | (own[1:] != own[:-1]) | (self.text[at[1:]] != self.text[at[:-1]])))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).tolist()
    low = 0
    for n, end in enumerate(ends):
        if end - (ends[low - 1] if low else 0) >= CHUNK or n == len(ends) - 1:
            yield batch.slice(low, n + 1 - low)
            low = n + 1


def _anchor_rows(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor, id) of each run of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                words = Words(part.column(1))
                at, own = words.anchors(window, phrase)
                first = words.runs(at, own)
                at, own = at[first], own[first]
                yield pa.RecordBatch.from_arrays([pa.array(own), part.column(0).take(pa.array(words.text[at]))], names=["anchor", "id"])

    return rows.select("id", "text").mapInArrow(run, "anchor long, id long")


def _shared_anchors(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, shared): the anchors of each id that another id has too; each step frees the last one's shuffle files."""
    spark = rows.sparkSession
    found = materialise(_anchor_rows(rows, window, phrase), "anchors")
    shared = materialise(found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor"), "shared")
    lists = materialise(found.join(shared, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("shared")), "lists")
    drop(found)
    drop(shared)
    return lists


def _contexts(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor, id, hash, start, context): the stretches of text whose windows have an anchor of two documents."""
    lists = _shared_anchors(rows, window, phrase)
    spread = np.uint64(MULTIPLIER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                words = Words(part.column(2))
                at, own = words.anchors(window, phrase)
                first = words.runs(at, own)
                known = part.column(3)
                values, sizes = known.flatten().to_numpy(), pa.compute.list_value_length(known).to_numpy(zero_copy_only=False)
                keys = values.view(np.uint64) + np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * spread
                mine = own[first].view(np.uint64) + words.text[at[first]].astype(np.uint64) * spread
                good = np.isin(mine, keys)[np.cumsum(first) - 1] if len(at) else np.zeros(0, dtype=bool)
                at, own = at[good], own[good]
                if not len(at):
                    continue
                new = words.runs(at, own)
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                low = np.flatnonzero(since % MOST_WINDOWS == 0)
                high = np.concatenate((low[1:], [len(at)])) - 1
                text, raw = pa.array(words.text[at[low]]), words.bytes.tobytes()
                cut = [raw[a:b] for a, b in zip(words.start[at[low]].tolist(), words.end[at[high] + window - 1].tolist())]
                starts = (at[low] - words.first[words.text[at[low]]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own[low]), part.column(0).take(text), part.column(1).take(text), pa.array(starts), pa.array(cut, pa.binary()).cast(pa.string())], names=["anchor", "id", "hash", "start", "context"])

    met = rows.join(lists, "id").select("id", "hash", "text", "shared")
    out = materialise(met.mapInArrow(run, "anchor long, id long, hash long, start int, context string"), "contexts")
    drop(lists)
    return out


def compile_passages(contexts: list[str], low: np.ndarray, high: np.ndarray, window: int) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """An automaton of what occurs in two documents, its values (words, least id), and the numbers of its words.

    contexts are distinct, low and high the least and greatest ids that have each. A window that only one context has
    recurs if that context does, so the context is one phrase for all of these; a window that several contexts have is a
    phrase of its own.
    """
    vocabulary: dict[bytes, int] = {}
    stream, sizes = [], []
    for text in contexts:
        words = split_words(text)
        sizes.append(len(words))
        stream += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
    ids, ends = np.array(stream, dtype=np.int64), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(ids) - window + 1
    at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    if not len(at):
        return None, vocabulary
    mixed = LETTERS[ids & 255] * (ids.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    keys, factor = np.zeros(len(at), dtype=np.uint64), 1
    for j in range(window):
        factor = factor * MULTIPLIER % (1 << 64)
        keys += mixed[at + j] * np.uint64(factor)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.flatnonzero(same)
    if any((ids[at[order[twice]] + j] != ids[at[order[twice + 1]] + j]).any() for j in range(window)):  # a collision of keys
        table = np.stack([ids[at + j] for j in range(window)], axis=1)
        order = np.lexsort(table.T)
        same = (table[order[1:]] == table[order[:-1]]).all(axis=1)
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    times, own = np.diff(np.concatenate((first, [len(order)]))), owner[at[order]]
    alone = np.unique(own[first[times == 1]])
    for c in alone[low[alone] < high[alone]].tolist():
        found.add_word(tuple(stream[ends[c] - sizes[c] : ends[c]]), (sizes[c], int(low[c])))
    least, most = np.minimum.reduceat(low[own], first), np.maximum.reduceat(high[own], first)
    for x in np.flatnonzero((times > 1) & (least < most)).tolist():
        start = at[order[first[x]]]
        found.add_word(tuple(stream[start : start + window]), (window, int(least[x])))
    if not len(found):
        return None, vocabulary
    found.make_automaton()
    return found, vocabulary


def locate(automaton: ahocorasick.Automaton, vocabulary: dict[bytes, int], contexts: list[str], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context numbers, first, last): runs of words covered by phrases that a smaller id has; words count in the document."""
    stream: list[int] = []
    at = np.zeros(len(contexts), dtype=np.int64)
    known = vocabulary.get
    for n, text in enumerate(contexts):
        at[n] = len(stream)
        stream += [known(w, 0) for w in split_words(text)]
        stream.append(0)
    hits = [(end, size, least) for end, (size, least) in automaton.iter(tuple(stream))]
    if not hits:
        return (np.zeros(0, dtype=np.int64),) * 3
    end, size, least = np.array(hits, dtype=np.int64).T
    own = np.searchsorted(at, end, side="right") - 1
    later = least < ids[own]
    own, end, size = own[later], end[later], size[later]
    place = end - size + 1 - at[own] + starts[own]
    order = np.lexsort((place, own))
    own, place, last = own[order], place[order], (place + size)[order]
    if not len(own):
        return own, place, last
    reach = np.maximum.accumulate(last + (own << 32)) - (own << 32)  # of what came before in the same context
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] > reach[:-1])))
    low = np.flatnonzero(new)
    return own[low], place[low], np.maximum.reduceat(last, low)


RANGES = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _cut(streamed: pa.Table, patterns: pa.Table, window: int) -> pa.Table:
    """The ranges to cut of the contexts in streamed; patterns: context, id_min, id_max of every distinct one."""
    automaton, vocabulary = compile_passages(patterns.column("context").to_pylist(), patterns.column("id_min").to_numpy(), patterns.column("id_max").to_numpy(), window)
    if automaton is None or not streamed.num_rows:
        return RANGES.empty_table()
    ids, marks, starts = (streamed.column(c).to_numpy() for c in ("id", "hash", "start"))
    own, first, last = locate(automaton, vocabulary, streamed.column("context").to_pylist(), ids, starts)
    return pa.table([pa.array(ids[own]), pa.array(marks[own]), pa.array(first, pa.int32()), pa.array(last, pa.int32())], schema=RANGES)


def _single_windows(contexts: DataFrame, window: int) -> DataFrame:
    """The contexts' windows, each a context of its own whose anchor is the hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 3):
                words = Words(part.column(3))
                at, own = words.anchors(window, window)
                text, raw = words.text[at], words.bytes.tobytes()
                cut = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at + window - 1].tolist())]
                starts = part.column(2).to_numpy()[text] + (at - words.first[text])
                yield pa.RecordBatch.from_arrays([pa.array(own), part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(starts.astype(np.int32)), pa.array(cut, pa.binary()).cast(pa.string())], names=["anchor", "id", "hash", "start", "context"])

    return contexts.select("id", "hash", "start", "context").mapInArrow(run, "anchor long, id long, hash long, start int, context string")


def _ranges(contexts: DataFrame, window: int, shard_rows: int, single: bool = False) -> DataFrame:
    """(id, hash, first, last): word ranges to cut, last not included.

    The contexts of a shard are its patterns, too. Shards of over twice the usual size are dealt into slices, each with
    all patterns of the shard, in which equal contexts are one. A shard with more different patterns than usual rows (a
    stock phrase in ever new surroundings) is dealt anew by whole windows, which no longer share a shard: `single` says
    that the contexts are such windows.
    """
    shards = max(1, -(-contexts.count() // shard_rows))
    contexts = contexts.withColumn("shard", F.pmod("anchor", F.lit(shards))).select("shard", "id", "hash", "start", "context")
    counts = contexts.groupBy("shard").count().filter(F.col("count") > 2 * shard_rows)
    hot = materialise(counts.select(F.col("shard").alias("hot"), F.ceil(F.col("count") / shard_rows).cast("int").alias("slices")), "hot")
    is_hot = F.col("shard") == F.col("hot")
    patterns = materialise(contexts.join(hot, is_hot).groupBy("shard", "slices", "context").agg(F.min("id").alias("id_min"), F.max("id").alias("id_max")), "patterns")
    rich = hot.limit(0).select(F.col("hot").alias("shard")) if single else patterns.groupBy("shard").count().filter(F.col("count") > shard_rows).select("shard")
    rich = materialise(rich, "rich")
    split = None if rich.isEmpty() else materialise(_single_windows(contexts.join(rich, "shard", "left_semi"), window), "windows")
    hot, patterns = (t.join(rich.withColumnRenamed("shard", name), name, "left_anti") for t, name in ((hot, "hot"), (patterns, "shard")))

    def alone(group: pa.Table) -> pa.Table:
        return _cut(group, group.group_by("context").aggregate([("id", "min"), ("id", "max")]), window)

    def sliced(streamed: pa.Table, patterns: pa.Table) -> pa.Table:
        return _cut(streamed, patterns, window)

    large = hot.select("hot").unionAll(rich.select("shard"))
    usual = contexts.join(large, is_hot, "left_anti").groupBy("shard").applyInArrow(alone, "id long, hash long, first int, last int")
    patterns = patterns.select(F.col("shard").alias("p_shard"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("p_slice"), "context", "id_min", "id_max")
    streamed = contexts.join(hot, is_hot).withColumn("slice", F.pmod(F.xxhash64("id", "start"), F.col("slices")).cast("int"))
    sharded = streamed.groupBy("shard", "slice").cogroup(patterns.groupBy("p_shard", "p_slice")).applyInArrow(sliced, "id long, hash long, first int, last int")
    found = materialise(usual.unionAll(sharded), "ranges")
    drop(contexts)
    return found if split is None else found.unionAll(_ranges(split, window, shard_rows, single=True))


def kept_words(words: list[bytes], first: list[int], last: list[int]) -> list[bytes]:
    """The words outside all ranges."""
    if not first:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row of df with n_words, n_removed and kept_text: its words that no repeated window covers, joined by spaces.

    A window is repeated if its words also start in a row with a smaller id; windows are judged on the input. A row
    that loses nothing keeps its text as it is. Null texts stay null and have no words; a row with a null id neither
    loses words nor counts as another's source; rows with one id don't count for one another. Other columns stay,
    except those named like the three. An empty table gives an empty one.
    """
    kept = [c for c in df.columns if c not in ("n_words", "n_removed", "kept_text", "_tm_hash")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    contexts = _contexts(rows, window, phrase)
    ranges = _ranges(contexts, window, shard_rows)
    cut = ranges.groupBy(F.col("id").alias("_tm_id"), F.col("hash").alias("_tm_mark")).agg(F.collect_list(F.struct("first", "last")).alias("_tm_ranges"))
    source = df.select(*kept, F.xxhash64(text_col).alias("_tm_hash"))
    met = source.join(cut, (source[id_col] == cut["_tm_id"]) & (source["_tm_hash"] == cut["_tm_mark"]), "left").select(*kept, F.col("_tm_ranges.first").alias("_tm_first"), F.col("_tm_ranges.last").alias("_tm_last"))
    schema = df.select(*kept).schema.add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sizes, removed, texts = [], [], []
                for text, first, last in zip(part.column(text_col), part.column("_tm_first"), part.column("_tm_last")):
                    text, first = text.as_py(), first.as_py()
                    words = split_words(text)
                    left = kept_words(words, first, last.as_py()) if first else words
                    sizes.append(len(words))
                    removed.append(len(words) - len(left))
                    texts.append(b" ".join(left).decode() if removed[-1] else text)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=[*kept, "n_words", "n_removed", "kept_text"])

    return met.mapInArrow(run, schema)


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", kept_digest(F.col("kept_text")).alias("kept_sha256"))


def kept_digest(text: F.Column) -> F.Column:
    """SHA-256 of a text's words joined by one space."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), 256)
