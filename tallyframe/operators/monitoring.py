"""Statistics of queues, agents and latency, load balancing, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import smoothed

SAMPLE_ROOM, SAMPLE_SLOT, SAMPLE_SPAN = 1000, 10, 600  # fixed values: samples a slot, seconds of a slot and of all


def sampled_percentiles(values: DataFrame, as_of: int, fractions=(0.5, 0.9, 0.99), *keys: str) -> DataFrame:
    """keys and p0, p1, ..: values at index (n - 1) * fraction of a sample: the lowest hashes of each slot of the last span. values: us, value, event_id.

    0 without samples. A group holds at most 60 slots of 1,000 samples.
    """
    at = F.floor(F.col("us") / (SAMPLE_SLOT * 1_000_000)).cast("long") * SAMPLE_SLOT
    slot = Window.partitionBy(*keys, "slot").orderBy(F.md5(F.col("event_id").cast("string")))
    x = values.withColumn("slot", at).where((F.col("us") <= as_of) & (F.col("slot") > as_of // 1_000_000 - SAMPLE_SPAN))
    x = x.withColumn("r", F.row_number().over(slot)).where(F.col("r") <= SAMPLE_ROOM)
    held = x.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("held"))
    return held.select(*keys, *[F.coalesce(F.get("held", F.floor((F.size("held") - 1) * F.lit(f)).cast("int")), F.lit(0.0)).alias(f"p{i}") for i, f in enumerate(fractions)])


def cluster_latency(servers: DataFrame, as_of: int, expiry: int = 300) -> DataFrame:
    """latency: the mean over servers of queue and processing medians; servers: us, queued, processed; older reports than `expiry` seconds go."""
    return servers.where(F.col("us") > as_of - expiry * 1_000_000).agg(F.coalesce(F.avg(F.col("queued") + F.col("processed")), F.lit(0.0)).alias("latency"))


def event_rates(events: DataFrame, width: int = 60, *keys: str) -> DataFrame:
    """keys, slot (seconds), rate (events a second)."""
    slot = F.floor(F.col("us") / (width * 1_000_000)).cast("long") * width
    return events.groupBy(*keys, slot.alias("slot")).agg((F.count("*") / width).alias("rate"))


def post_latency(events: DataFrame, received) -> DataFrame:
    """name, client, latency: the mean seconds from an event to its receipt in each bundle."""
    return events.groupBy("name", "client").agg(F.avg((received - F.col("us")) / 1_000_000).alias("latency"))


def queue_statistics(queues: DataFrame, as_of: int) -> DataFrame:
    """server, shards, tasks, oldest (seconds) and load (1000 * (share of tasks - 1 / servers)); queues: server, tasks, us of the oldest task."""
    own = queues.groupBy("server").agg(F.count("*").alias("shards"), F.sum("tasks").alias("tasks"), F.max((as_of - F.col("us")) / 1_000_000).alias("oldest"))
    return _with_load(own, "tasks")


def _with_load(own: DataFrame, column: str) -> DataFrame:
    whole = own.agg(F.sum(column).alias("_all"), F.count("*").alias("_n"))  # one row
    share = F.coalesce(F.col(column) / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0))
    return own.crossJoin(F.broadcast(whole)).withColumn("load", F.round(1000 * (share - 1 / F.col("_n")), 6)).drop("_all", "_n")


def agent_status(buffers: DataFrame, room: int = 5_000_000) -> DataFrame:
    """url, shards, total_events, buffered, queued, pending, buffer_pct, load; buffers: url and these counts of a shard."""
    own = buffers.groupBy("url").agg(F.count("*").alias("shards"), *[F.sum(c).alias(c) for c in ("total_events", "buffered", "queued", "pending")])
    return _with_load(own.withColumn("buffer_pct", F.col("buffered") * 100.0 / room), "total_events")


def load_weights(loads: DataFrame) -> DataFrame:
    """server, weight: smoothed loads in order of time; loads: server, us, load, a few reports of each server."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("us", "load"))), lambda x: x["load"])
    return loads.groupBy("server").agg(smoothed(ordered).alias("weight"))


def oldest_first(queues: DataFrame) -> DataFrame:
    """shard, turn: queues with tasks in order of their oldest one, ties by shard; turns within each server."""
    turn = Window.partitionBy("server").orderBy("us", "shard")
    return queues.where("tasks > 0").withColumn("turn", F.row_number().over(turn)).select("server", "shard", "turn")


def assigned(shards: DataFrame, servers: int) -> DataFrame:
    """shard, server: shards in order of weight dealt to servers to and fro, so that no server's sum is off by more than the largest weight a turn."""
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "shard")) - 1  # one row a shard
    x = shards.withColumn("place", place)
    way = F.expr(f"place div {servers}") % 2
    own = F.col("place") % servers
    return x.select("shard", F.when(way == 0, own).otherwise(servers - 1 - own).cast("int").alias("server"))


def handed_over(urls: DataFrame) -> DataFrame:
    """url, shards, target, moves: shards that each URL gives (negative) or gets to even them out, ties to the lighter, then by name."""
    order = Window.orderBy("shards", "url")  # one row a URL
    whole = urls.agg(F.sum("shards").alias("_all"), F.count("*").alias("_n"))  # one row
    x = urls.crossJoin(F.broadcast(whole)).withColumn("_i", F.row_number().over(order))
    extra = (F.col("_i") > F.col("_n") - F.col("_all") % F.col("_n")).cast("long")
    target = F.expr("_all div _n") + extra
    return x.select("url", "shards", target.alias("target"), (target - F.col("shards")).alias("moves"))


def per_client(events: DataFrame, limit: int) -> DataFrame:
    """Events with `now`: whether they are among their client's first `limit` by time; the others wait."""
    turn = Window.partitionBy("client").orderBy("us", "event_id")
    return events.withColumn("now", F.row_number().over(turn) <= limit)


def bundles(events: DataFrame, most: int = 50_000) -> DataFrame:
    """client, name, bundle, events: the sizes of bundles of at most `most` events."""
    n = events.groupBy("client", "name").agg(F.count("*").alias("n"))
    x = n.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))))
    return x.select("client", "name", "bundle", F.least(F.lit(most).cast("long"), F.col("n") - F.col("bundle") * most).alias("events"))
