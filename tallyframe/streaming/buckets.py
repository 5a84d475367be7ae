"""Streaming counters at bucket grain, from which every trailing interval can be summed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """name, bucket (epoch seconds), count of a stream with (name, ts): state is one row for each open bucket, dropped after `late`."""
    x = stream.withWatermark("ts", late).groupBy("name", F.window("ts", width).alias("w")).agg(F.count("*").alias("count"))
    return x.select("name", F.unix_seconds("w.start").alias("bucket"), "count")


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in one process, where that is unset, under the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tally-{uuid.uuid4().hex}"


def written(df: DataFrame, mode: str, folder: str) -> str:
    """Runs a stream to its end into a Parquet table, each batch a folder of its own that a repeated batch replaces; in update mode
    the row of a key in its last batch counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"
