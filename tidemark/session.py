"""Sessions with the settings that the engine expects."""

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override, with `_` for `.` in their names."""
    builder = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**base, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
