"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most `capacity` tokens. Packing depends on the histogram of piece lengths alone, a table
of at most `capacity` rows, so the driver solves it: a configuration is a multiset of lengths that fits one sequence,
and the linear program asks for the fewest configurations that cover all pieces. It is solved by multiplicative weights:
a knapsack over the weights of the lengths prices the best configuration, what it covers loses weight, and the uses of
all configurations are averaged and rounded down. What that leaves is solved again, the last remainder is packed
best-fit, longest first; where plain best-fit needs fewer sequences, it is taken. Pieces get a rank within their length,
and ranks are mapped to places by intervals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, once
from tidemark.llm.tokens import WordTokens
from tidemark.llm.words import slices

CAPACITY, END = 4096, 1
SLICE = 1 << 18  # bytes of text tokenised at once
#: Lengths that the program tells apart; its rounds, the share of them that goes before uses count, and the first step.
CLASSES, ROUNDS, FIRST, STEP = 400, 2_400, 0.5, 0.2
SALTS = 64
PARTS, MOST_INTERVALS = 1, 1_000_000


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and its end id, cut into pieces of `capacity`.

    Null and empty texts are one piece of the end id. With ids, the ids come too, as array<long>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(("words", tokenizer), lambda: WordTokens(tokenizer))
        tail = np.array([end], dtype="<u4").tobytes()
        for part in slices(batches, 1, SLICE):
            if part.num_rows:
                rows, codes = [], []
                for n, code in enumerate(words.ids_of([t or "" for t in part.column(1).to_pylist()])):
                    code += tail
                    for at in range(0, len(code), 4 * capacity):
                        own = code[at : at + 4 * capacity]
                        rows.append((n, at // (4 * capacity), at // 4, len(own) // 4, zlib.crc32(own)))
                        codes.append(np.frombuffer(own, dtype="<u4").astype(np.int64) if ids else None)
                n, piece, start, length, crc = zip(*rows)
                out = [part.column(0).take(pa.array(n)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.array(codes, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def price(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of items, at most limits[i] of item i, whose sizes sum to at most capacity: {i: times}."""
    best, steps = np.zeros(capacity + 1), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, value, most = int(sizes[i]), float(values[i]), min(int(limits[i]), capacity // int(sizes[i]))
        times = 1
        while most > 0:  # times by powers of two, the last what is left
            times = min(times, most)
            most -= times
            width = size * times
            offer = best[: capacity + 1 - width] + value * times
            steps.append((i, times, width, offer > best[width:]))
            np.maximum(best[width:], offer, out=best[width:])
            times *= 2
    at, found = int(np.argmax(best)), {}
    for i, times, width, taken in reversed(steps):
        if at >= width and taken[at - width]:
            found[i] = found.get(i, 0) + times
            at -= width
    return found


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """([(configuration {i: times}, its number of sequences, a fraction)], dual bound) of the configuration linear program.

    Multiplicative weights: each round prices the best configuration for the weights, uses it as often as its scarcest
    item allows, and lowers the weights of what it covers, by ever smaller steps. The uses of the later rounds are averaged
    and scaled to as many tokens as there are. For any weights, the weight of all pieces over that of the best
    configuration is a lower bound on the number of sequences: the greatest is the dual bound.
    """
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    weights, tokens, bound = sizes / capacity, 0.0, 0.0
    for n in range(rounds):
        found = price(sizes, weights, counts, capacity)
        items, times = np.array(list(found)), np.array(list(found.values()))
        bound = max(bound, float((weights * counts).sum() / (weights[items] * times).sum()))
        often = float((counts[items] / times).min())
        if n >= FIRST * rounds:
            name = tuple(sorted(found.items()))
            uses[name] = uses.get(name, 0.0) + often
            tokens += often * float((sizes[items] * times).sum())
        weights[items] *= np.exp(-STEP * max(0.1, 1 - n / (0.6 * rounds)) * often * times / counts[items])
        weights = np.maximum(weights / weights.max(), 1e-12)
    scale = tokens / float((counts * sizes).sum())
    return [(dict(c), often / scale) for c, often in sorted(uses.items(), key=lambda x: (-x[1], x[0]))], bound


def solve(counts: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, number of such sequences)] that hold counts[length] pieces of each length, exactly.

    The linear program is solved and rounded down, then again for what is left, as long as that places at least a tenth of
    it; the remainder goes best-fit, longest first. All pieces best-fit are taken instead where that needs fewer sequences.
    """
    left = {n: c for n, c in sorted(counts.items()) if c}
    plain = best_fit(left, capacity)
    plan: list[tuple[list[int], int]] = []
    if left.get(capacity):
        plan.append(([capacity], left.pop(capacity)))
    rounds = ROUNDS
    while left:
        before = sum(n * c for n, c in left.items())
        plan += rounded(left, capacity, classes, rounds)
        rounds = ROUNDS // 4
        left = {n: c for n, c in left.items() if c}
        if sum(n * c for n, c in left.items()) > 0.9 * before:
            break
    plan += best_fit(left, capacity)
    return min(plan, plain, key=lambda x: sum(n for _, n in x))


def bound_of(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the number of sequences: by tokens, and by pieces of over half a sequence."""
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))


def rounded(left: dict[int, int], capacity: int, classes: int, rounds: int) -> list[tuple[list[int], int]]:
    """Sequences of the linear program over what is left, rounded down; takes their pieces out of left.

    Where there are over `classes` lengths, the program sees them to the nearest 2, 4, 8 ... tokens; each sequence then gets
    lengths of its classes that fill it best. A sequence is used only where it is as full as the whole allows.
    """
    unit = 1
    while len({max(1, (n + unit // 2) // unit) for n in left}) > classes:
        unit *= 2
    own: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        own.setdefault(max(1, (n + unit // 2) // unit), []).append(n)
    sizes = np.array(sorted(own), dtype=np.int64)
    rest = np.array([sum(left[n] for n in own[s]) for s in sizes.tolist()], dtype=np.int64)
    rounds = min(rounds, 200 + 12 * len(sizes))
    plan: list[tuple[list[int], int]] = []
    for found, often in fractional(sizes, rest, capacity // unit, rounds)[0]:
        wanted = min([int(often)] + [int(rest[i]) // t for i, t in found.items()])
        names = [int(sizes[i]) for i, t in found.items() for _ in range(t)]
        while wanted:  # in runs of equal sequences
            lengths = choose(names, own, left, capacity)
            if not lengths:
                break
            run = min([wanted] + [left[n] // lengths.count(n) for n in set(lengths)])
            for n in lengths:
                left[n] -= run
            for i, t in found.items():
                rest[i] -= run * t
            plan.append((lengths, run))
            wanted -= run
    return plan


def choose(wanted: list[int], classes: dict[int, list[int]], left: dict[int, int], capacity: int) -> list[int]:
    """Lengths, one of each wanted class, with the greatest sum that fits; none if no choice does."""
    mask, sums, options = (1 << capacity + 1) - 1, [1], []  # bit n of a number: the sum n can be had
    for n, size in enumerate(wanted):
        again = wanted[:n].count(size)  # a length needs as many pieces as its class may take of it
        options.append([x for x in classes[size] if left.get(x, 0) > again] or [x for x in classes[size] if left.get(x, 0) > 0][:1])
        reach = 0
        for x in options[-1]:
            reach |= sums[-1] << x
        sums.append(reach & mask)
    if not sums[-1]:
        return []
    total, out = sums[-1].bit_length() - 1, []
    for before, open_ in zip(reversed(sums[:-1]), reversed(options)):
        x = next(x for x in open_ if total >= x and before >> total - x & 1)
        out.append(x)
        total -= x
    return sorted(out, reverse=True) if all(out.count(x) <= left[x] for x in set(out)) else []


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: sequences with equal contents are kept as one entry with their number."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            room = min((r for r in groups if r >= length), default=None)
            held, number = groups[room].pop() if room is not None else ((), -(-todo // (capacity // length)))
            if room is not None and not groups[room]:
                del groups[room]
            space = capacity if room is None else room
            each = min(space // length, todo)
            full = min(number, todo // each)
            put = [(held + (length,) * each, full, space - length * each)]
            todo -= full * each
            if full < number:
                if room is None:
                    if todo:  # the last new sequence holds what is left
                        put.append(((length,) * todo, 1, capacity - length * todo))
                        todo = 0
                else:
                    put.append((held, number - full, space))
            for items, n, gap in put:
                if n:
                    groups.setdefault(gap, []).append((items, n))
    return [(list(items), n) for own in groups.values() for items, n in own]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a column length (1 to capacity), in as few sequences as it can.

    A piece's rank within its length comes from windows over slices of the length, so a length that a third of all
    pieces share makes no large group. Sequences of one configuration are numbered in a row.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(SALTS * max(1, spark.sparkContext.defaultParallelism))).cast("int"))
    sliced = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in sliced.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    intervals, base = [], 0
    ranks: dict[int, int] = {}
    for lengths, copies in solve(counts, capacity):
        offset = 0
        for length in lengths:
            low = ranks.get(length, 0)
            intervals.append((length, low, low + copies, base, offset))
            ranks[length] = low + copies
            offset += length
        base += copies
    table, widths = lookup(spark, intervals, counts)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sliced.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "first").join(widths, "length")
    inner = Window.partitionBy("length", "salt").orderBy(*names)
    ranked = pieces.withColumn("k", F.row_number().over(inner) - 1).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("k"))
    ranked = ranked.withColumn("part", F.expr("rank div width"))
    return ranked.join(table, ["length", "part"]).filter("rank >= low AND rank < high").select(*names, (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def lookup(spark: SparkSession, intervals: list[tuple[int, ...]], counts: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """The intervals of ranks dealt into parts of equal width, one width a length, so that a rank meets few of them.

    (length, part, low, high, base, at), at most PARTS + 1 rows an interval on average, and (length, width). Both depend on
    the histogram and the plan only, not on the number of pieces; they are broadcast up to MOST_INTERVALS rows.
    """
    number: dict[int, int] = {}
    for x in intervals:
        number[x[0]] = number.get(x[0], 0) + 1
    width = {n: -(-counts[n] // (PARTS * own)) for n, own in number.items()}
    rows = [(length, part, *rest) for length, *rest in intervals for part in range(rest[0] // width[length], (rest[1] - 1) // width[length] + 1)]
    columns = {k: pa.array([x[i] for x in rows], pa.int64()) for i, k in enumerate(("length", "part", "low", "high", "base", "at"))}
    table = spark.createDataFrame(pa.table(columns))
    widths = spark.createDataFrame(pa.table({"length": pa.array(list(width), pa.int64()), "width": pa.array(list(width.values()), pa.int64())}))
    return F.broadcast(table) if len(rows) <= MOST_INTERVALS else table, F.broadcast(widths)


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each row of df: id, piece, start, length, ids_crc32, sequence_id and offset.

    Repeated rows are packed each; null texts count as empty; a text of any length is cut into as many pieces as it takes; an
    empty table gives no pieces; other columns go, those named like the results too.
    """
    pieces = materialise(cut_pieces(df, tokenizer, capacity, end, id_col, text_col), "pieces")
    return place(pieces, capacity).withColumnRenamed("id", id_col)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
