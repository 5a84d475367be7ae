"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_side, stored


def word_count(text) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size); one row a source, so the windows are small.

    Resharing what is above the caps by weight ends at a level: target = min(cap * size, level * weight). Sources are capped in the
    order of cap / weight, and the level is the first one that the next source's ratio reaches.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", pick.cast("long")).withColumn("full", F.col("source_size") * cap).withColumn("ratio", F.col("full").cast("double") / F.col("w"))
    x = x.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("full").over(by_ratio), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
    x = x.withColumn("level", level).withColumn("n", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    x = x.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("n"))).over(everything))
    reach = F.coalesce(F.col("level") * F.col("w"), F.col("full").cast("double"))
    return x.select("source", "source_size", F.least(F.col("full").cast("double"), reach).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", digits: int = 3, row: F.Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes) for every document, and `row` if one is given.

    A document's random key is md5(seed:doc_id), without an id md5(seed:null:md5 of the text). Within a source documents stand in
    key order, ranges of keys being its first hex digits. Sums of (source, range) are prefix-summed over at most 16^digits rows a
    source, then each range's documents within it: no task holds a whole source. Whole epochs take every document; the rest of the
    budget is cut at the exact word. Null text: size 0. Null source: a source of its own. Rows with equal doc_id are ordered by
    size, then by the text's hash, so reruns agree; rows of one doc_id stand in one range. An empty table gives no rows. Other
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("text_hash"), *([row.alias("row")] if row is not None else []))
    sized = stored(sized.withColumn("range", F.substring("key", 1, digits)))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start"))
    plan = small_side(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    sums = sums.withColumnsRenamed({"source": "s", "range": "r"})
    x = sized.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    x = x.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return x.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *(["row"] if row is not None else []))
