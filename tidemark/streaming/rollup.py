"""The streaming twin of a rollup: closed buckets of an append-only stream, or all buckets with corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def bucket_stream(rows: DataFrame, ts: str, width: str, keys: list[str], aggregates: list[Column], late: str) -> DataFrame:
    """(bucket, keys..., aggregates...) of a stream; a bucket is closed once the watermark has passed its end."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width).alias("bucket"), *keys).agg(*aggregates)
    return out.withColumn("bucket", F.col("bucket.start").cast("timestamp_ntz"))


def write_closed(buckets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed buckets as Parquet, all that is there now, exactly once."""
    return buckets.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_live(buckets: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write every bucket that a batch opens or corrects, under the batch's number: open ones show at once, and a late
    row writes its bucket anew. A batch that is run again takes the place of its first run."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = buckets.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_live(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest state of each bucket."""
    rows = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)
    newest = F.max_by(F.struct(*schema.names), "batch").alias("row")
    return rows.groupBy("bucket", *keys).agg(newest).select("row.*")
