"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has several points on a ring of hash buckets. A row belongs to the first point clockwise from its own
bucket; where that shard is full, it goes on clockwise to the next point of a shard with room. Capacities are the
floor or the ceiling of rows / shards, so row counts are at most one apart.

Filling the ring bucket by bucket needs only the counts of the buckets, a table of fixed size: the walk round the ring
yields, per bucket, the intervals of row ranks that each shard takes. Equal rows are counted into rows of at most 64
copies, and all are dealt by range; a rank is the sum of the ranges before and a window over the row's own bucket and
range, so no key, however frequent and with however many texts, makes a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, materialise, shuffle_partitions

BUCKETS = 1 << 14
POINTS_PER_SHARD = 64
COPIES = (1 << 16, 64)


def ring_points(shards: int, points: int, buckets: int) -> list[tuple[int, int]]:
    """(bucket, shard) of every virtual node in clockwise order; placed by a multiplicative rule, ties by shard."""
    spread = 0x9E3779B97F4A7C15
    at = lambda s, i: (((s * points + i + 1) * spread) & (1 << 64) - 1) * buckets >> 64
    return sorted((at(s, i), s) for s in range(shards) for i in range(points))


def fill(counts: dict[int, int], shards: int, points: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Walk the ring once: (bucket, first rank, end rank, shard, first slot) of each interval."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan, n = [0] * shards, [], len(points)
    nxt = 0
    for bucket in sorted(counts):
        while nxt < n and points[nxt][0] < bucket:
            nxt += 1
        rank, at = 0, nxt
        while rank < counts[bucket]:
            shard = points[at % n][1]
            take = min(counts[bucket] - rank, room[shard] - used[shard])
            if take:
                plan.append((bucket, rank, rank + take, shard, used[shard]))
                rank, used[shard] = rank + take, used[shard] + take
            at += 1
    return plan


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS_PER_SHARD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in its shard).

    Rows are ordered in their bucket by hash, id, size and checksum; rows equal in all of these are interchangeable and
    get consecutive places. Null texts have size 1 and checksum 0, a null id is a key like any other. Other columns of
    docs are dropped. With fewer rows than shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), key.alias("key"))
    rows = rows.groupBy("id", "size", "crc", "key").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.expr(f"key div {(1 << 60) // buckets}").cast("int"))
    for most in COPIES:  # rows of at most so many copies each
        rows = rows.withColumn(f"part{most}", F.explode(F.expr(f"sequence(0L, (copies - 1) div {most})"))).withColumn("copies", F.least(F.lit(most).cast("long"), F.col("copies") - F.col(f"part{most}") * most))
    rows = materialise(rows, "ring")
    counts = {r[0]: r[1] for r in rows.groupBy("bucket").agg(F.sum("copies")).collect()}  # one row a bucket at most
    order = ["key", "id", "size", "crc", *[f"part{most}" for most in COPIES]]
    dealt = materialise(rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "bucket", *order).withColumn("range", F.spark_partition_id()), "ranges")
    drop(rows)
    within = Window.partitionBy("bucket", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("bucket", "range").agg(F.sum("copies").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("within", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(firsts, ["bucket", "range"]).withColumn("rank", F.col("first") + F.col("within"))
    plan = fill(counts, shards, ring_points(shards, points, buckets))
    values = ", ".join(map(str, plan)) or "(-1, 0, 0, 0, 0)"
    takes = docs.sparkSession.sql(f"SELECT INT(col1) AS bucket, BIGINT(col2) AS r_from, BIGINT(col3) AS r_to, INT(col4) AS shard, BIGINT(col5) AS base FROM VALUES {values}")
    takes = F.broadcast(takes.withColumnRenamed("bucket", "t_bucket"))  # at most a row a bucket and one for each end of a shard
    meets = (ranked["bucket"] == takes["t_bucket"]) & (F.col("rank") < F.col("r_to")) & (F.col("rank") + F.col("copies") > F.col("r_from"))
    first, end = F.greatest("rank", "r_from"), F.least(F.col("rank") + F.col("copies"), F.col("r_to"))
    slots = F.explode(F.sequence(F.col("base") + first - F.col("r_from"), F.col("base") + end - F.col("r_from") - 1))
    return ranked.join(takes, meets).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slots.alias("slot"))


def op9_ring_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
