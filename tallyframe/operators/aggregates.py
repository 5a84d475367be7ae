"""The aggregates over events, at any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import in_window
from ..schema import BUFFER_ROWS, GAUGE_HOURS, INTERVALS, MOVING, PER_MILLE


def _totals():
    total = F.sum(F.col("value").cast("long"))
    return [F.count("value").alias("count"), F.coalesce(total, F.lit(0)).alias("total"), F.round(F.coalesce(total / F.nullif(F.count("value"), F.lit(0)), F.lit(0.0)), 4).alias("average")]


def totals(events: DataFrame, *keys: str) -> DataFrame:
    """All-time count, sum of whole parts and average (0 without events)."""
    return events.groupBy(*keys).agg(*_totals())


def totals_at_all_levels(events: DataFrame) -> DataFrame:
    """totals by (name, client), by name and over all, in one pass."""
    return events.groupingSets([["name", "client"], ["name"], []], "name", "client").agg(*_totals())


def pyramid(events: DataFrame, as_of: int, *keys: str, intervals=INTERVALS) -> DataFrame:
    """Count and sum over each trailing interval: one scan and one partial aggregation for all intervals."""
    cols = []
    for label, (w, n) in intervals.items():
        hit = in_window(as_of, w, n)
        cols += [F.count_if(hit).alias(f"count_{label}"), F.round(F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0)), 2).alias(f"total_{label}")]
    return events.groupBy(*keys).agg(*cols)


def percentiles(events: DataFrame, *keys: str, splits: int = 64) -> DataFrame:
    """count, total and the values at index per_mille * count // 1000 of the sorted values, exactly.

    Approximate splitters cut each group's values into ranges; range counts say which range holds each wanted index, and only
    those ranges are ranked. So no group is collected or sorted in one task; equal values are counted before the shuffle.
    """
    k = list(keys)
    x = events.where("value is not null")
    cuts = x.groupBy(*k).agg(F.percentile_approx("value", F.array(*[F.lit(i / splits) for i in range(1, splits)]), F.lit(1000)).alias("cuts"))
    x = x.join(cuts, k).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    counts = x.groupBy(*k, "b", "value").agg(F.count("*").alias("c"))
    ranges = counts.groupBy(*k, "b").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("value")).alias("t"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("m").over(Window.partitionBy(*k).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = ranges.groupBy(*k).agg(F.sum("m").alias("count"), F.round(F.sum("t"), 2).alias("total"))
    wanted = whole.select(*k, "count", "total", F.explode(F.array(*map(F.lit, PER_MILLE))).alias("p")).withColumn("at", F.floor(F.col("p") * F.col("count") / 1000))
    hit = wanted.join(ranges, k).where("at >= start and at < start + m").select(*k, "b", "start", "count", "total", "p", "at")
    running = counts.join(hit.select(*k, "b").distinct(), [*k, "b"], "left_semi").withColumn("upto", F.sum("c").over(Window.partitionBy(*k, "b").orderBy("value")))
    found = hit.join(running, [*k, "b"]).where("at >= start + upto - c and at < start + upto")
    return found.groupBy(*k, "count", "total").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in PER_MILLE])


def moving_percentiles(events: DataFrame, as_of: int, *keys: str, intervals=MOVING) -> DataFrame:
    """percentiles over each trailing interval, one row for each group and interval with events."""
    labels = F.array(*[F.when(in_window(as_of, w, n), F.lit(label)) for label, (w, n) in intervals.items()])
    return percentiles(events.withColumn("interval", F.explode(F.array_compact(labels))), *keys, "interval")


def counter_group(events: DataFrame, as_of: int, *keys: str, intervals=INTERVALS) -> DataFrame:
    """pyramid and percentiles side by side."""
    return pyramid(events, as_of, *keys, intervals=intervals).join(percentiles(events, *keys), list(keys))


def gauge(events: DataFrame, as_of: int, expiry=None, value="value") -> DataFrame:
    """name, value, clients: how many clients' latest value it is; values past their expiry (48 hours, or the given column) go."""
    expiry = F.col("us") + GAUGE_HOURS * 3_600_000_000 if expiry is None else expiry
    last = events.groupBy("name", "client").agg(F.max_by(F.struct(F.col(value).alias("value"), expiry.alias("expiry")), F.struct(F.col("us"), -F.col("event_id"))).alias("x"))
    return last.where(F.col("x.expiry") > as_of).groupBy("name", F.col("x.value").alias("value")).agg(F.count("*").alias("clients"))


def buffer(events: DataFrame, as_of: int, expiry, rows: int = BUFFER_ROWS) -> DataFrame:
    """The unexpired events of each name with the latest expiries; Spark limits each partition's groups before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.desc("expiry"), "event_id")
    x = events.withColumn("expiry", expiry).where(F.col("expiry") > as_of)
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("name", "rank", "event_id", "value", "us", "expiry")


def bottom_k(events: DataFrame, k: int, *keys: str) -> DataFrame:
    """A uniform sample of k values of each group: those of the lowest hash. A sampling operator; samples merge without loss."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.col("event_id").cast("string")), "event_id")
    return events.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(*keys, "event_id", "value")


def trailing_counts(events: DataFrame, span: int, *keys: str) -> DataFrame:
    """event_id, trailing: how many events of the same keys lie within the last `span` microseconds up to each event.

    Each event stands in its own stretch of time and, for the events after it, in the next one, so a window holds two
    stretches of a key and not all its time.
    """
    own = F.floor(F.col("us") / span).cast("long")
    x = events.select(*keys, "event_id", "us", own.alias("own")).withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    near = Window.partitionBy(*keys, "stretch").orderBy("us").rangeBetween(-(span - 1), 0)
    return x.withColumn("trailing", F.count("*").over(near)).where("stretch = own").select("event_id", "trailing")
