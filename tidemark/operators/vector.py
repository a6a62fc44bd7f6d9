"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(df: DataFrame, probe: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity) of the k most similar rows, ties by id: one scan, k rows kept by each task."""
    point = F.array(*[F.lit(float(x)) for x in probe])
    scored = df.filter(F.col(vector_col).isNotNull()).select(id_col, cosine(F.col(vector_col), point).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), id_col).limit(k)


def similar_to(df: DataFrame, probe_id: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to one row, without it; that row's vector is read first."""
    row = df.filter(F.col(id_col) == probe_id).select(vector_col).first()
    others = df.filter(F.col(id_col) != probe_id)
    return nearest(others if row else others.limit(0), row[0] if row else [0.0], k, id_col, vector_col)
