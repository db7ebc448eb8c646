"""Vectors as arrays of float: cosine distance and nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; nan if either vector is zero, so it sorts last."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    norms = F.sqrt(_sum(F.transform(a, lambda v: v * v)) * _sum(F.transform(b, lambda v: v * v)))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _sum(F.zip_with(a, b, lambda x, y: x * y)) / F.nullif(norms, F.lit(0.0)))


def nearest(rows: DataFrame, vector: str, query: Column, k: int, tie: str) -> DataFrame:
    """The k rows nearest to the query vector, exactly; ties go to the smaller tie column."""
    return rows.withColumn("distance", cosine_distance(F.col(vector), query)).orderBy(F.col("distance").asc_nulls_last(), tie).limit(k)
