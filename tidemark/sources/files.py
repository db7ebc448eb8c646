"""CSV files, literal rows and series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """CSV with a declared schema, plain or gzip; only the wanted columns are parsed further."""
    df = spark.read.schema(schema).option("header", header).option("sep", delimiter).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def pg_array(text: Column) -> Column:
    """An array written as {a,b,"c d"}; elements with commas inside quotes are kept whole."""
    inner = F.regexp_extract(text, r"^\{(.*)\}$", 1)
    parts = F.regexp_extract_all(inner, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), 1)
    plain = F.transform(parts, lambda p: F.when(p.startswith('"'), F.regexp_replace(F.regexp_replace(p, r'^"|"$', ""), r"\\(.)", "$1")).otherwise(F.nullif(p, F.lit("NULL"))))
    return F.when(text.isNotNull(), plain)


def time_series(spark: SparkSession, start: datetime, end: datetime, step: timedelta) -> DataFrame:
    """(ts) from start to end, end included, made in parallel."""
    micro = timedelta(microseconds=1)
    n = (end - start) // step + 1
    base = (start - datetime(1970, 1, 1)) // micro
    return spark.range(max(n, 0)).select(F.timestamp_micros(F.lit(base) + F.col("id") * (step // micro)).cast("timestamp_ntz").alias("ts"))


def each_of(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """Every row with each integer from first to last, none if last is less."""
    return df.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias(name))
