"""Quality metrics over a stream of events, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_metrics(events: DataFrame, window: str = "1 day", late: str = "2 days", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(window_start, key, n, total) of a stream or a table with (time, key, value). Rows more
    than `late` behind the newest one are dropped, and in append or update mode so is the state of windows that ended
    before."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = events.withWatermark(time, late) if events.isStreaming else events
    g = rows.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), key, "n", "total")


def collected_windows(metrics: DataFrame, at: str) -> DataFrame:
    """Runs a stream of windowed_metrics() over all that is there and returns the last version of every window. `at` is a
    folder that all machines share; the stream goes on from its state if it is run there again."""
    key = metrics.columns[1]

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = metrics.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    done = metrics.sparkSession.read.schema(T.StructType([*metrics.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/out")
    return done.groupBy("window_start", key).agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
