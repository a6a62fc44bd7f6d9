"""Token counts of flat token files, found by their separators.

A flat token file is the documents' ids one after another, each document closed by a separator id, with no index. The
files are read in blocks of a fixed size wherever they lie between separators; numpy finds the separators of many blocks
at once, and what a document has on either side of a boundary is stitched: within a split by the last separator seen,
between the splits of a file by a prefix scan over one row per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import delete, materialise, new_path, once
from tidemark.llm.tokens import ByteTokens
from tidemark.llm.words import slices

SEPARATOR, FILLER = 50256, 0xFFFF
BLOCK = 1 << 15  # ids
ROUNDS = 2
KEY_IDS, KEY_BITS, NO_KEY = 5, 15, 1 << 15


def key_ids(key: int | None) -> list[int]:
    """A 64-bit key as ids below 2**15; a null key as ids of 2**15."""
    return [NO_KEY] * KEY_IDS if key is None else [key >> KEY_BITS * n & (1 << KEY_BITS) - 1 for n in range(KEY_IDS)]


def key_of(ids: Column) -> Column:
    """The key that key_ids() turned into ids."""
    parts = [F.shiftleft(ids[n].cast("long"), KEY_BITS * n) for n in range(KEY_IDS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return F.when(ids[0] != NO_KEY, out)


def write_tokens(df: DataFrame, path: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, block: int = BLOCK) -> None:
    """Write the texts' uint16 ids as flat token files below path, one for each partition.

    A document is its key (KEY_IDS ids), the ids of its text and the separator; a null text has no ids. The last document
    of a file is filler that makes it a whole number of blocks. Spark's own text writer puts the separator after each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = once(("bytes", ranks), lambda: ByteTokens(ranks, pattern)), 0
        for part in slices(batches, 1):
            if part.num_rows:
                out = []
                for key, text in zip(part.column(0), part.column(1)):
                    out.append(np.array(key_ids(key.as_py()), dtype="<u2").tobytes() + tokens.ids(text.as_py() or "").tobytes())
                    size += len(out[-1]) // 2 + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([np.full(-(size + 1) % block, FILLER, dtype="<u2").tobytes()], pa.binary())], names=["ids"])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", separator.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


ROWS = pa.schema([
    ("file", pa.string()), ("summary", pa.bool_()), ("split", pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
    ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())),
])


class SplitScan:
    """The separators of one split of a file, block after block.

    search() gives a row for each separator: (file, False, split, rank, start, stop, first ids, None); start and ids are null
    where the document began in an earlier split. summary() gives (file, True, split, separators, last separator, None, ids
    before the first separator, ids after the last). Of ids, the first `kept` are given; positions count ids in the file.
    """

    def __init__(self, file: str, split: int, separator: int, kept: int):
        self.file, self.split, self.separator, self.kept, self.at = file, split, separator, kept, split
        self.last = -1 if split == 0 else None
        self.rank, self.whole = 0, False
        self.head: list[int] = []
        self.tail: list[int] = []

    def search(self, data: bytes) -> pa.RecordBatch:
        ids, base = np.frombuffer(data, dtype="<u2"), self.at
        self.at += len(ids)
        stops = np.flatnonzero(ids == self.separator)
        if not self.whole and len(self.head) < self.kept:
            self.head += ids[: (int(stops[0]) if len(stops) else len(ids))][: self.kept - len(self.head)].tolist()
        if not len(stops):
            if self.last is not None:
                self.tail += ids[max(0, self.last + 1 - base) :][: self.kept - len(self.tail)].tolist()
            return pa.RecordBatch.from_pylist([], schema=ROWS)
        begins = np.concatenate(([-1 if self.last is None else self.last - base], stops[:-1])) + 1
        sizes = np.minimum(stops - begins, self.kept)
        inside = np.arange(self.kept) < sizes[1:, None]
        rest = ids[np.minimum(begins[1:, None] + np.arange(self.kept), len(ids) - 1)][inside]
        if begins[0] < 0:  # it began in an earlier block
            first = (self.tail + ids[: int(stops[0])][: self.kept].tolist())[: self.kept]
        else:
            first = ids[int(begins[0]) : int(stops[0])][: self.kept].tolist()
        lengths = np.concatenate(([len(first)], sizes[1:]))
        known = np.ones(len(stops), dtype=bool)
        known[0] = self.last is not None
        heads = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate((np.array(first, dtype=np.int32), rest.astype(np.int32)))))
        if not known[0]:
            heads = pa.concat_arrays([pa.nulls(1, heads.type), heads.slice(1)])
        n = len(stops)
        columns = [
            pa.array([self.file] * n), pa.array(np.zeros(n, dtype=bool)), pa.array(np.full(n, self.split)), pa.array(self.rank + np.arange(n)),
            pa.array(begins + base, mask=~known), pa.array(stops + base), heads, pa.nulls(n, pa.list_(pa.int32())),
        ]
        self.rank, self.last, self.whole = self.rank + n, int(stops[-1]) + base, True
        self.tail = ids[int(stops[-1]) + 1 :][: self.kept].tolist()
        return pa.RecordBatch.from_arrays(columns, schema=ROWS)

    def summary(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(ROWS.names, (self.file, True, self.split, self.rank, self.last, None, self.head, self.tail)))], schema=ROWS)


def read_blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(file, first, data) of the blocks of the files below path, in order within each task: one split of one file.

    first is where the split starts, in bytes. Spark's reader of records of fixed length finds the splits on any file
    system; the rows stay in the JVM until Arrow hands them to Python.
    """
    records = spark.sparkContext._jsc.binaryRecords(path, 2 * block)
    rows = spark._jsparkSession.createDataset(records.rdd(), spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(rows.toDF(), spark).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("first"), F.col("value").alias("data"))


def scan_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, keys: int = KEY_IDS, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, key_ids) of each document of the flat uint16 files below path.

    ordinal and start (in ids) count within the file; the first `keys` ids of a document are its key and not counted.
    Documents of filler are left out. Each file must be a whole number of blocks of `block` ids and end with a
    separator. A document may span any number of blocks and splits; without files or documents there are no rows.
    """
    kept = max(keys, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            names, starts, data = (batch.column(n) for n in range(3))
            edges = [n for n in range(batch.num_rows) if n == 0 or (names[n], starts[n]) != (names[n - 1], starts[n - 1])]
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                name, start = names[low].as_py(), starts[low].as_py() // 2
                if scan is None or (scan.file, scan.split) != (name, start):
                    if scan is not None:
                        yield scan.summary()
                    scan = SplitScan(name, start, separator, kept)
                yield scan.search(b"".join(data.slice(low, high - low).to_pylist()))
        if scan is not None:
            yield scan.summary()

    rows = read_blocks(spark, path, block).mapInArrow(run, "file string, summary boolean, split long, rank long, start long, stop long, head array<int>, tail array<int>")
    rows = materialise(rows, "scan")
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.filter("summary").withColumn("next", F.lead("head").over(order))
    carry = F.last(F.when(F.col("start").isNotNull(), F.struct("start", F.concat("tail", F.coalesce("next", F.array().cast("array<int>"))).alias("ids"))), ignorenulls=True)
    splits = splits.select("file", "split", carry.over(before).alias("carry"), F.coalesce(F.sum("rank").over(before), F.lit(0)).alias("base"))
    docs = rows.filter("NOT summary").join(splits, ["file", "split"])
    start = F.coalesce("start", F.col("carry.start") + 1)
    ids = F.coalesce("head", F.slice("carry.ids", F.lit(1), F.least(F.lit(kept), F.col("stop") - start).cast("int")))
    docs = docs.select("file", (F.col("base") + F.col("rank")).alias("ordinal"), start.alias("start"), F.greatest(F.col("stop") - start - keys, F.lit(0)).alias("n_tokens"), ids.alias("key_ids"))
    return docs.filter((F.size("key_ids") == 0) | (F.get("key_ids", F.lit(0)) != FILLER))


def count_tokens(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_tokens) of each row of df: its texts are written as flat token files in the shared folder, which are scanned.

    The rows are dealt into rounds by a hash of the id, and the token files of a round are deleted once they are scanned,
    so that only a share of all tokens takes space at a time. Null and empty texts have no tokens; repeated rows are
    counted each, a null id stays null; other columns go. A text of any length is one document of any number of blocks; an
    empty table gives no rows.
    """
    spark, out = df.sparkSession, None
    for n in range(rounds):
        path = new_path(spark, "tokens")
        write_tokens(df.filter(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(rounds)) == n), path, ranks, pattern, id_col, text_col, block=block)
        found = scan_tokens(spark, path, block=block).select(key_of(F.col("key_ids")).alias(id_col), "n_tokens")
        delete(spark, path)
        out = found if out is None else out.unionAll(found)
    return out


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
