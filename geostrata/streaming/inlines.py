"""A stream of sections: each micro-batch of points is grouped by the same operator as a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators import islands


def write_grouped(stream: DataFrame, path: str, checkpoint: str, max_gap: float = 10):
    """Starts a query that appends the grouped points of every batch to path. A section must arrive whole, in one file."""

    def each(batch: DataFrame, number: int) -> None:
        out = islands.group_points(batch, max_gap).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) with a watermark: picks by time as they arrive."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
