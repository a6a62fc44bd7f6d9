"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """make()'s result, kept for later tasks of the same Python worker; for what has a bounded size."""
    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def share(spark: SparkSession, value: Any) -> Broadcast[bytes]:
    """Broadcast a value together with its class, so that executors need no copy of this package; pickle.loads() it there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all is one JVM."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


ROWS_A_FILE = 1 << 20
#: How a table of our own is written: shuffle files go with the step that made them, and Arrow hands rows over by bytes.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session while it lasts."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Where it is known that there are `rows` rows at most, few files are written for few rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, SETTINGS):
        (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of the plans, broadcasts and shuffle files that no one holds any more: else the driver's heap grows with the steps taken."""
    gc.collect()  # frames in cycles hold their plans
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_size(text: str) -> F.Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
