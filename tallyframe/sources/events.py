"""Event tables in the engine's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, client, name, us (epoch microseconds), value, k (days to expiry) of the events table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("client"),
        F.col("event_type").alias("name"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The type that each event name of the table stands for in the queries.
TYPED = {"click": "CounterGroup", "view": "TotalsCounter", "purchase": "PercentileGroup", "error": "Gauge", "signup": "Buffer"}


def typed(events: DataFrame, conflicts: bool = True) -> DataFrame:
    """Events with tab_type, text and expiry. With conflicts, every 97th event but a name's first disagrees on the type."""
    of_name = F.lit(None).cast("string")
    for name, tab_type in TYPED.items():
        of_name = F.when(F.col("name") == name, tab_type).otherwise(of_name)
    if conflicts:
        of_name = F.when((F.col("event_id") % 97 == 0) & (F.col("event_id") > 96), "PercentileCounter").otherwise(of_name)
    text = F.round("value").cast("long").cast("string")
    return events.withColumns({"tab_type": of_name, "text": text, "expiry": F.col("us") + F.col("k") * 86_400_000_000})


def latest(events: DataFrame) -> int:
    """The default as_of: the largest timestamp, in microseconds (one row reaches the driver)."""
    return events.agg(F.max("us")).first()[0] or 0
