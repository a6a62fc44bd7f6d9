"""From documents to packed training sequences: five stages, each one operator over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

- toxicity: documents that the classifier rejects go.
- near_duplicates: of each group of near copies the document with the smallest doc_id stays.
- repeated_passages: words covered by a passage that a smaller doc_id has are cut; documents without words left go.
- decontaminate: documents that overlap a benchmark item go.
- pack: what is left becomes pieces in sequences of at most 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, simhash, substring_dedup, toxicity
from tidemark.llm.common import drop, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MOST_IDS = 1 << 21  # that are broadcast, some 100 MB


def few(ids: DataFrame) -> DataFrame:
    """These ids, broadcast to where the texts are while they aren't too many, so that texts need no shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, null and empty texts too; the classifier learns from `labels`."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id; of rows that share a doc_id, the least text.

    A document goes if a document that stays has the same doc_id, or has at least 0.8 of their five-word shingles in
    common with it; every such pair is found. Texts without words and rows with a null doc_id aren't compared and stay.
    """
    docs = docs.select(*COLUMNS)
    gone = few(simhash.confirmed_copies(docs, shingle=5, similarity=0.8).select(F.col("id").alias("doc_id")))
    often = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    often = few(materialise(often, "often"))
    first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    one = docs.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "row.*")
    return docs.join(often, "doc_id", "left_anti").select(*COLUMNS).unionAll(one).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages, n_chars anew where words went; rows that lose all words go.

    Null and empty texts and rows with a null doc_id stay as they are; repeated rows are cut alike, an empty table gives none.
    """
    cut = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    left = cut.filter("n_removed = 0 OR n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of `benchmark`; rows with a null doc_id stay."""
    found = decontaminate.overlaps(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = materialise(found.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "leaked")
    return docs.select(*COLUMNS).join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; null texts count as empty, repeated rows are packed each, no rows give none."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

#: Training, fingerprints, automata and the linear program are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if n:
            drop(before)
    return docs
