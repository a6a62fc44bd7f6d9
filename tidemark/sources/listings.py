"""Raw listings from files, by source, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import html, ical

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(platform: str):
    def keep(function):
        READERS[platform] = function
        return function

    return keep


@reader("jsonld")
def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Events in the JSON-LD of HTML files, one page a file."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), F.col("value").alias("html"))
    return html.jsonld_events(pages)


@reader("ical")
def read_calendars(spark: SparkSession, path: str) -> DataFrame:
    return ical.read_ical(spark.read.format("binaryFile").load(path))


@reader("json")
def read_json_pages(spark: SparkSession, path: str, items: str = "_embedded.events", schema: str | None = None) -> DataFrame:
    """Items of paged JSON answers, a page a file; the schema is inferred only if none is given."""
    source = spark.read.option("multiLine", True)
    pages = source.schema(schema).json(path) if schema else source.json(path)
    return pages.select(F.explode(F.col(items)).alias("item")).select("item.*")


def read(spark: SparkSession, platform: str, path: str) -> DataFrame:
    """Raw listings of a platform; an unknown platform is an error that names the known ones."""
    if platform not in READERS:
        raise ValueError(f"unknown platform {platform}: one of {sorted(READERS)}")
    return READERS[platform](spark, path)
