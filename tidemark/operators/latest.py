"""Latest and most common values per key, and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in that order; each task keeps n rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) with the value that occurs most, the smallest of equals; nulls and blanks don't count."""
    held = df.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
    counted = held.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value))).alias("_best"))
    return best.select(*keys, F.col(f"_best.{value}").alias(value))


def first_seen(listings: DataFrame, links: DataFrame) -> DataFrame:
    """Add first_seen, the earliest over a listing's links, else its start."""
    seen = links.groupBy(F.col("id").alias("_id")).agg(F.min("first_seen").alias("_seen"))
    return listings.join(seen, F.col("id") == F.col("_id"), "left").withColumn("first_seen", F.coalesce("_seen", "starts_at")).drop("_id", "_seen")


def backoff(failures: Column, base_minutes: int) -> Column:
    """Minutes to wait after so many failures in a row: base * 2^(failures - 1)."""
    return F.when(failures > 0, F.lit(base_minutes) * F.pow(F.lit(2), failures - 1)).otherwise(0).cast("long")


def priority_union(*frames: DataFrame, key: str) -> DataFrame:
    """The row of each key from the first frame that has it."""
    out = None
    for n, df in enumerate(frames):
        part = df.withColumn("_priority", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return latest(out, [key], F.col("_priority")).drop("_priority")


def save_attempts(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, failures) after a round: a success sets failures in a row to zero, a failure adds one, no attempt changes nothing."""
    done = results.select(F.col("id").alias("_id"), F.col("ok"))
    joined = jobs.join(done, F.col("id") == F.col("_id"), "left")
    return joined.select("id", F.when(F.col("ok"), 0).when(~F.col("ok"), F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0))).cast("long").alias("failures"))
