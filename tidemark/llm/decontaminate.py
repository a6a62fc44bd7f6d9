"""Benchmark decontamination by spaced seeds.

A seed hashes the words of a window under a fixed mask that ignores some positions, so that a passage with words
exchanged still shares seeds with its benchmark item. Benchmark seeds are joined with the seeds of every document on
the map side: the benchmark is dealt into blocks of a bounded number of words, each is broadcast, and each document
passes once per block. Every hit names a diagonal (document position less item position); overlaps are
the longest aligned runs on it with at least four words in five equal.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import share
from tidemark.llm.words import folded_hashes, slices

#: The masks; 1 compares a word, 0 ignores it.
MASKS = ["11100100011", "11000101101", "10110001011", "10011110001"]
SPAN = 11
MIN_WORDS = 13
PENALTY = 4
BLOCK_WORDS = 1_000_000
HITS = 1 << 18
FILTER_BITS = 22
MULTIPLIER = 0x9E3779B97F4A7C15


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    counts, (hashes,) = folded_hashes(texts)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A 64-bit seed for each window of words; the mask is part of it."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), xxhash.xxh64_intdigest(mask.encode()), dtype=np.uint64)
    factor = 1
    for j, used in enumerate(mask):
        factor = factor * MULTIPLIER % (1 << 64)
        if used == "1" and n > 0:
            out += hashes[j : j + n] * np.uint64(factor | 1)
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class Block:
    """The seeds of some benchmark items, sorted, behind a small table that tells most foreign seeds apart."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.masks = [*MASKS, *sorted({"1" * len(h) for _, h in items if 0 < len(h) < SPAN})]
        found = []
        for n, (_, hashes) in enumerate(items):
            for mask in MASKS if len(hashes) >= SPAN else ["1" * len(hashes)] if len(hashes) else []:
                own = seeds(hashes, mask)
                found.append((own, np.full(len(own), n), np.arange(len(own))))
        keys, owner, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 3
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.at = keys[order], owner[order], at[order]
        self.known = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.known[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def diagonals(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, item number, shift) of all seeds in common, once each; hashes are the words of texts that start at `first`.

        What a chunk of positions hits is made unique before the next, so equal words that meet equal words don't pile up.
        """
        found = np.zeros((0, 3), dtype=np.int64)
        for mask in self.masks:
            own = seeds(hashes, mask)
            at = np.flatnonzero(self.known[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, own[at]), np.searchsorted(self.keys, own[at], side="right")
            hit = high > low
            at, low, times = at[hit], low[hit], (high - low)[hit]
            ends, begin = np.cumsum(times), 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, side="right")))
                n = times[begin:end]
                entry = np.repeat(low[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
                place = np.repeat(at[begin:end], n)
                text = np.searchsorted(first, place, side="right") - 1
                new = np.stack((text, self.owner[entry].astype(np.int64), place - first[text] - self.at[entry].astype(np.int64)), axis=1)
                found = unique_rows(np.concatenate((found, unique_rows(new))))
                begin = end
        return found


def unique_rows(rows: np.ndarray) -> np.ndarray:
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]


def longest_runs(equal: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(start, length, matches) of disjoint runs of need words or more with 4/5 equal, the longest first, then what lies beside it.

    A run qualifies if its sum of 1 for an equal word and -PENALTY for another isn't negative.
    """
    out, parts = [], [(0, len(equal))]
    while parts:
        low, high = parts.pop()
        if high - low < need or (1 + PENALTY) * int(equal[low:high].sum()) < PENALTY * need:
            continue
        total = np.concatenate(([0], np.cumsum(np.where(equal[low:high], 1, -PENALTY))))
        most = np.maximum.accumulate(total[::-1])[::-1]  # falls: the last end whose sum is at least that of a start
        length = np.searchsorted(-most, -total, side="right") - 1 - np.arange(len(total))
        start = int(np.argmax(length))
        size = int(length[start])
        if size < need:
            continue
        start += low
        out.append((start, size, int(equal[start : start + size].sum())))
        parts += [(low, start), (start + size, high)]
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, doc_start, item_start, length, matches): every overlap of a row of docs with a benchmark item.

    Texts are compared as words (runs of letters, digits and _), lower-cased; positions count words. An overlap is an
    aligned run, on the diagonal of a shared seed, of min_words words or more, or a whole shorter item, of which at least
    4/5 are equal; of runs that share words the longest is given, so changed words may stand at its ends.
    Items of fewer than SPAN words must occur exactly; null or wordless items and texts overlap nothing. A row of docs
    is never compared with another, repeated rows repeat their overlaps, null ids are kept. Texts of any length are compared
    whole, other columns play no part, an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has a character at least
    blocks = max(1, -(-words // block_words))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for n in range(blocks):
        own = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).toLocalIterator()]
        block = share(spark, Block(list(zip([i for i, _ in own], word_hashes([t for _, t in own])))))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = pickle.loads(block.value)
            for batch in slices(batches, 1):
                yield from found_in(held, batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist()), min_words)

        part = rows.mapInArrow(run, "id long, item_id long, doc_start long, item_start long, length long, matches long")
        out = part if out is None else out.unionAll(part)
    return out.withColumnRenamed("id", id_col)


def found_in(block: Block, ids: list, texts: list[np.ndarray], min_words: int) -> Iterator[pa.RecordBatch]:
    if not texts:
        return
    hashes = np.concatenate(texts)
    first = np.cumsum([0, *map(len, texts)])
    rows = []
    for d, n, shift in block.diagonals(hashes, first).tolist():
        name, words = block.items[n]
        low, high = max(0, -shift), min(len(words), len(texts[d]) - shift)
        if high <= low:
            continue  # the window ran over the end of its text
        equal = texts[d][low + shift : high + shift] == words[low:high]
        if len(words) < SPAN:
            runs = [(0, len(words), len(words))] if len(equal) == len(words) and equal.all() else []
        else:
            runs = longest_runs(equal, min(min_words, len(words)))
        rows += [(ids[d], name, low + shift + start, low + start, length, matches) for start, length, matches in runs]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["id", "item_id", "doc_start", "item_start", "length", "matches"])


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
