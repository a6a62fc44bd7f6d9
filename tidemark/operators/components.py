"""Connected components by minimum labels with shortcuts, each round cut from its lineage by a checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir; in a local folder only where the session names none and all is one JVM."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for nodes(node) and edges(a, b); a component is named by its least node."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", "component", F.least("component", "heard").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("lowest"))
        new = cut(lower.join(up, "low", "left").select("node", F.coalesce("lowest", "low").alias("new"), F.col("component").alias("old")))
        labels = new.select("node", F.col("new").alias("component"))
        if new.filter("new <> old").isEmpty():
            return labels
