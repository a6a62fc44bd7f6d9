"""Toxicity by a convolutional text classifier, written and trained in numpy.

A word's embedding is the sum of three hashed vectors (the word, its first four and its first five letters). Filters
of several widths run over a text's words, each keeps its maximum, and a linear layer makes the logit. Training draws
balanced batches from a bounded sample of labelled rows; gradients reach the maxima only. The language of a text is
told from its function words, and each language's threshold is set on labelled rows kept out of training; scores are
scaled so that the threshold of every language lies at one value.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from tidemark.llm.common import once, share
from tidemark.llm.words import Numbers, folded, folded_hashes, hash_word, slices

#: Function words that tell languages apart.
LANGUAGES = {
    "en": "the of and to is that it with for was are this by from which".split(),
    "de": "der die das und von den mit ist ein eine nicht auf dem zu im".split(),
    "fr": "le les des et du une pour qui dans est au pas sur la ou".split(),
    "es": "el los las y que por con para una del se es lo como de".split(),
}
BUCKETS, WIDTHS, DIM, FILTERS = 1 << 16, (1, 2, 3), 12, 8
STEPS, BATCH, RATE = 600, 48, 0.02
MAX_ROWS, MAX_CHARS = 3_000, 16_384
THRESHOLD = 0.7
BATCH_WORDS, PART = 1 << 16, 1 << 16  # words in one run of the network; of a text in one part
PAD, BLANK = -1, -2


def flags() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, sorted, and for each a bit for every language that has it, from bit 48."""
    words = {w: sum((w in own) << 48 + n for n, own in enumerate(LANGUAGES.values())) for own in LANGUAGES.values() for w in own}
    keys = {hash_word(w): bits for w, bits in words.items()}
    return np.array(sorted(keys), dtype=np.uint64), np.array([keys[k] for k in sorted(keys)], dtype=np.int64)


def packed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """A code for each word of each text: three 16-bit buckets (of the word, its first four and its first five letters) and
    the flags of the languages whose function word it is; a text without words is one BLANK."""
    counts, (whole, four, five) = folded_hashes(texts, (4, 5))
    keys, bits = once(("toxicity", "flags"), flags)
    at = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
    codes = np.where(keys[at] == whole, bits[at], 0)
    for n, own in enumerate((whole, four * np.uint64(3), five * np.uint64(5))):
        codes |= (own >> np.uint64(48)).astype(np.int64) % BUCKETS << 16 * n
    blank = np.array([BLANK], dtype=np.int64)
    return [part if len(part) else blank for part in np.split(codes, np.cumsum(counts)[:-1])] if len(texts) else []


def pack_word(word: str) -> int:
    return int(packed_texts([word])[0][0])


def packed(text: str | None, memo: Numbers) -> np.ndarray:
    """packed_texts() for one text, word by word."""
    found = np.array([memo[w] for w in folded(text)], dtype=np.int64)
    return found if len(found) else np.array([BLANK], dtype=np.int64)


def language(codes: np.ndarray) -> int:
    """Number of the language with the most function words; len(LANGUAGES) where there are none."""
    hits = [int(np.count_nonzero(codes >> 48 + n & 1)) if codes[0] != BLANK else 0 for n in range(len(LANGUAGES))]
    return int(np.argmax(hits)) if max(hits) else len(LANGUAGES)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray
    shift: float
    thresholds: np.ndarray  # logits, one a language and one for none
    slope: float = 1.0

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        z = self.slope * (logits - self.thresholds[languages]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes in a row with pads after each, and where each starts."""
    gap = np.full(max(WIDTHS), PAD, dtype=np.int64)
    return np.concatenate([x for t in texts for x in (t, gap)]), np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])


def forward(model: Model, codes: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Logits, the responses of each width, and the pooled maxima; where skip is true no window starts."""
    words = model.table[codes & 0xFFFF] + model.table[codes >> 16 & 0xFFFF] + model.table[codes >> 32 & 0xFFFF]
    words[codes < 0] = 0
    all_, pooled = [], []
    for width, filters in zip(WIDTHS, model.filters):
        z = words @ filters[0]
        for j in range(1, width):
            z[:-j] += words[j:] @ filters[j]
        z[codes == PAD if skip is None else skip | (codes == PAD)] = -1e30
        all_.append(z)
        pooled.append(np.maximum.reduceat(z, starts, axis=0))
    top = np.concatenate(pooled, axis=1) + model.bias
    return np.maximum(top, 0) @ model.out + model.shift, all_, top


class Adam:
    def __init__(self, value: np.ndarray):
        self.value, self.m, self.v = value, np.zeros_like(value), np.zeros_like(value)

    def step(self, gradient: np.ndarray, t: int, rows: np.ndarray | slice = slice(None)) -> None:
        self.m[rows] = m = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = v = 0.99 * self.v[rows] + 0.01 * gradient**2
        self.value[rows] -= (RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Train on four rows in five and set the thresholds on the rest. Without both labels every text scores low."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    model = Model(small(BUCKETS, DIM), [small(w, DIM, FILTERS) for w in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), small(len(WIDTHS) * FILTERS), 0.0, np.full(len(LANGUAGES) + 1, 30.0))
    order = rng.permutation(len(texts))
    kept = order[: len(order) // 5] if len(order) >= 50 else order
    train = order[len(order) // 5 :] if len(order) >= 50 else order
    groups = [train[labels[train] == y] for y in (0, 1)]
    if not len(groups[0]) or not len(groups[1]):
        return model
    table, out, bias, shift = Adam(model.table), Adam(model.out), Adam(model.bias), Adam(np.zeros(1, np.float32))
    filters = [Adam(f) for f in model.filters]
    for t in range(1, STEPS + 1):
        batch = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        codes, starts = lay_out([texts[i] for i in batch])
        logits, responses, top = forward(model, codes, starts)
        error = (1 / (1 + np.exp(-logits)) - labels[batch]) / BATCH
        grad_top = error[:, None] * model.out * (top > 0)
        table_rows, table_grads = [], []
        ends = np.concatenate((starts[1:], [len(codes)]))
        filter_grads = []
        for n, (width, own) in enumerate(zip(WIDTHS, model.filters)):
            grad = grad_top[:, n * FILTERS : (n + 1) * FILTERS]
            at = np.stack([s + responses[n][s:e].argmax(axis=0) for s, e in zip(starts, ends)])
            gradient = np.zeros_like(own)
            for j in range(width):
                code = codes[np.minimum(at + j, len(codes) - 1)]
                real = (code >= 0)[..., None]
                vectors = (model.table[code & 0xFFFF] + model.table[code >> 16 & 0xFFFF] + model.table[code >> 32 & 0xFFFF]) * real
                gradient[j] = np.einsum("nf,nfd->df", grad, vectors)
                to_word = (grad[..., None] * own[j].T[None]) * real
                for part in range(3):
                    table_rows.append((code >> 16 * part & 0xFFFF).ravel())
                    table_grads.append(to_word.reshape(-1, DIM))
            filter_grads.append(gradient + 1e-4 * own)
        rows, where = np.unique(np.concatenate(table_rows), return_inverse=True)
        sums = np.zeros((len(rows), DIM), np.float32)
        np.add.at(sums, where, np.concatenate(table_grads))
        out.step(np.maximum(top, 0).T @ error + 1e-4 * model.out, t)
        bias.step(grad_top.sum(axis=0), t)
        shift.step(np.array([error.sum()]), t)
        for adam, gradient in zip(filters, filter_grads):
            adam.step(gradient, t)
        table.step(sums + 1e-4 * model.table[rows], t, rows)
        model.shift = float(shift.value[0])
    codes, starts = lay_out([texts[i] for i in kept])
    logits, spoken = forward(model, codes, starts)[0], np.array([language(texts[i]) for i in kept])
    everywhere = best_threshold(logits, labels[kept], 0.0)
    model.thresholds = np.array([best_threshold(logits[spoken == n], labels[kept][spoken == n], everywhere) for n in range(len(LANGUAGES) + 1)])
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray, default: float) -> float:
    """The middle of the gap between logits at which balanced accuracy is highest; the default without ten of each label."""
    if min((labels == 0).sum(), (labels == 1).sum()) < 10:
        return float(default)
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    missed, cleared = np.concatenate(([0], np.cumsum(y == 1))) / (y == 1).sum(), np.concatenate(([0], np.cumsum(y == 0))) / (y == 0).sum()
    good = cleared - missed
    best = np.flatnonzero(good >= good.max() - 1e-12)
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    return float(edges[best[len(best) // 2]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most max_rows labelled rows of each label, those with the least hash of the id; held-out ids never count.

    Rows with a null id, label or text, repeated labels and texts of more than max_chars characters are no examples; of the
    texts that share an id the least is one. So at most 2 * max_rows texts of that length reach the driver. Below 50 rows all
    are trained on and set the thresholds, too.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * max_rows rows at most
    short = F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars)
    rows = docs.filter(short).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes = [c.tobytes() for c in packed_texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label").cast(pa.int32()), pa.array(codes, pa.binary())], names=["id", "label", "codes"])

    found = rows.mapInArrow(run, "id long, label int, codes binary").toArrow()
    order = np.lexsort((found.column("label").to_numpy(), found.column("id").to_numpy()))
    texts = found.column("codes")
    return fit([np.frombuffer(texts[i].as_py(), dtype=np.int64) for i in order.tolist()], found.column("label").to_numpy()[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) to each row of docs; null and empty texts are scored too.

    Whole texts count, however long. Columns of docs with these names are replaced; repeated rows score alike.
    """
    shared = share(docs.sparkSession, model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in slices(batches, text_col):
            texts = packed_texts(batch.column(text_col).to_pylist())
            if texts:
                values = own.score(long_forward(own, texts), np.array([language(t) for t in texts])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema.add("score", DoubleType()).add("predicted", IntegerType()))


def long_forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Logits of texts; a text of many words is run in overlapping parts, whose maxima are the text's."""
    parts, owner, more = [], [], max(WIDTHS) - 1
    for n, t in enumerate(texts):
        for at in range(0, len(t), PART):
            parts.append((t[at : at + PART + more], min(PART, len(t) - at)))  # windows start in the part's own words
            owner.append(n)
    tops, low = [], 0
    while low < len(parts):
        high, size = low, 0
        while high < len(parts) and (high == low or size + len(parts[high][0]) <= BATCH_WORDS):
            size += len(parts[high][0])
            high += 1
        codes, starts = lay_out([t for t, _ in parts[low:high]])
        skip = np.zeros(len(codes), dtype=bool)
        for start, (t, own) in zip(starts.tolist(), parts[low:high]):
            skip[start + own : start + len(t)] = True
        tops.append(forward(model, codes, starts, skip)[2])
        low = high
    first = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    top = np.maximum.reduceat(np.concatenate(tops), first, axis=0)
    return np.maximum(top, 0) @ model.out + model.shift


def op6_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
