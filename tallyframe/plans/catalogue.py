"""Named queries over the events table and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import sanitised, valid
from ..operators import aggregates as A
from ..schema import COARSE, INTERVALS, MOVING, PER_MILLE
from ..sources.events import latest, load_events
from ..streaming.buckets import bucket_counts, new_folder, written

QUERIES, ORACLES = {}, {}
E = "e AS (SELECT event_id, 'user_' || user_id AS client, event_type AS name, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), t AS (SELECT max(us) AS now FROM e)"
DAY = 86_400_000_000
SPECS = INTERVALS | COARSE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load_events(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = f"WITH {E} {sql}"
        return f

    return add


TOTALS = "count(value) AS count, sum(trunc(value)::BIGINT)::BIGINT AS total, round(coalesce(sum(trunc(value)::BIGINT)::BIGINT / nullif(count(value), 0), 0), 4) AS average"


@query(f"SELECT name, client, {TOTALS} FROM e GROUP BY name, client")
def totals_projection(e, spark, sf_dir):
    return A.totals(e, "name", "client")


@query(f"SELECT name, {TOTALS} FROM e GROUP BY name")
def totals_tabs(e, spark, sf_dir):
    return A.totals(e, "name")


@query(f"SELECT {TOTALS} FROM e")
def totals_super(e, spark, sf_dir):
    return A.totals(e)


@query(f"SELECT name, client, {TOTALS} FROM e GROUP BY GROUPING SETS ((name, client), (name), ())")
def totals_grouping_sets(e, spark, sf_dir):
    return A.totals_at_all_levels(e)


def _hit(w: int, n: int) -> str:
    w *= 1_000_000
    return f"us >= (now // {w}) * {w} - {(n - 1) * w} AND us < (now // {w}) * {w} + {w}"


PYRAMID = ", ".join(f"count(*) FILTER (WHERE {_hit(w, n)}) AS count_{x}, round(coalesce(sum(value) FILTER (WHERE {_hit(w, n)}), 0), 2) AS total_{x}" for x, (w, n) in SPECS.items())
PCT = "count(value) AS count, round(sum(value), 2) AS total, " + ", ".join(f"list_sort(list(value))[({p} * count(value)) // 1000 + 1] AS p{p}" for p in PER_MILLE)


@query(f"SELECT name, {PYRAMID} FROM e, t GROUP BY name")
def pyramid_tabs(e, spark, sf_dir):
    return A.pyramid(e, latest(e), "name", intervals=SPECS)


@query(f"SELECT name, client, {PYRAMID} FROM e, t GROUP BY name, client")
def pyramid_projection(e, spark, sf_dir):
    return A.pyramid(e, latest(e), "name", "client", intervals=SPECS)


@query(f"SELECT name, {PCT} FROM e GROUP BY name")
def pct_tabs(e, spark, sf_dir):
    return A.percentiles(e, "name")


@query(f"SELECT name, {PYRAMID}, {PCT} FROM e, t GROUP BY name")
def counter_group_tabs(e, spark, sf_dir):
    return A.counter_group(e, latest(e), "name", intervals=SPECS)


_MOVING = " UNION ALL ".join(f"SELECT name, '{x}' AS interval, value FROM e, t WHERE {_hit(w, n)}" for x, (w, n) in (MOVING | COARSE).items())


@query(f", m AS ({_MOVING}) SELECT name, interval, {PCT} FROM m GROUP BY name, interval")
def pct_group_tabs(e, spark, sf_dir):
    return A.moving_percentiles(e, latest(e), "name", intervals=MOVING | COARSE)


_LAST = ", l AS (SELECT *, row_number() OVER (PARTITION BY name, client ORDER BY us DESC, event_id) AS r FROM e)"


@query(f"{_LAST} SELECT name, round(value)::BIGINT AS value, count(*) AS clients FROM l, t WHERE r = 1 AND us + 48 * 3600000000 > now GROUP BY 1, 2")
def gauge_tabs(e, spark, sf_dir):
    return A.gauge(e.withColumn("value", F.round("value").cast("long")), latest(e))


@query(f"{_LAST} SELECT name, round(value)::BIGINT AS value, count(*) AS clients FROM l, t WHERE r = 1 AND us + k * {DAY} > now GROUP BY 1, 2")
def expiry_gauge_tabs(e, spark, sf_dir):
    return A.gauge(e.withColumn("value", F.round("value").cast("long")), latest(e), F.col("us") + F.col("k") * DAY)


@query(f", x AS (SELECT *, us + k * {DAY} AS expiry FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY expiry DESC, event_id)::INTEGER AS rank FROM x, t WHERE expiry > now) SELECT name, rank, event_id, value, us, expiry FROM r WHERE rank <= 1000")
def buffer_top(e, spark, sf_dir):
    return A.buffer(e, latest(e), F.col("us") + F.col("k") * DAY)


@query(f"SELECT name, client, {TOTALS} FROM e WHERE name IN ('click', 'view') AND client IN ('user_1', 'user_2', 'user_3') GROUP BY name, client")
def filter_in(e, spark, sf_dir):
    return A.totals(e.where(F.col("name").isin("click", "view") & F.col("client").isin("user_1", "user_2", "user_3")), "name", "client")


@query(f"SELECT name, client, {TOTALS} FROM e WHERE regexp_matches(name, '^(?:c|s)') AND regexp_matches(client, '^(?:user_1)') GROUP BY name, client")
def filter_regex(e, spark, sf_dir):
    return A.totals(e.where(F.col("name").rlike("^(?:c|s)") & F.col("client").rlike("^(?:user_1)")), "name", "client")


@query("SELECT DISTINCT name FROM e WHERE NOT regexp_matches(name, '^(?:err|vi)')")
def blacklist(e, spark, sf_dir):
    return e.where(~F.col("name").rlike("^(?:err|vi)")).select("name").distinct()


@query("""SELECT client, s AS spoilt, NOT regexp_matches(s, '[^A-Za-z0-9._~:/?@!$()*+;=-]') AS valid, regexp_replace(s, '[^A-Za-z0-9._~:/?@!$()*+;=-]', '_', 'g') AS clean
FROM (SELECT DISTINCT client, CASE k % 3 WHEN 0 THEN client WHEN 1 THEN client || '&' || name ELSE client || chr(10) END AS s FROM e)""")
def valid_names(e, spark, sf_dir):
    spoilt = F.when(F.col("k") % 3 == 0, F.col("client")).when(F.col("k") % 3 == 1, F.concat("client", F.lit("&"), "name")).otherwise(F.concat("client", F.lit("\n")))
    x = e.select("client", spoilt.alias("spoilt")).distinct()
    return x.select("client", "spoilt", valid("spoilt").alias("valid"), sanitised("spoilt").alias("clean"))


@query("SELECT DISTINCT name FROM e")
def names(e, spark, sf_dir):
    return e.select("name").distinct()


@query("SELECT DISTINCT client FROM e")
def clients(e, spark, sf_dir):
    return e.select("client").distinct()


@query("SELECT DISTINCT name FROM e WHERE client IN ('user_1', 'user_7')")
def names_for_clients(e, spark, sf_dir):
    return e.where(F.col("client").isin("user_1", "user_7")).select("name").distinct()


@query(f"SELECT name, client, max(us) AS last_us FROM e GROUP BY name, client HAVING max(us) < (SELECT now FROM t) - 7 * {DAY}")
def prune_candidates(e, spark, sf_dir):
    return e.groupBy("name", "client").agg(F.max("us").alias("last_us")).where(F.col("last_us") < latest(e) - 7 * DAY)


@query("SELECT client, arg_min(name, (us, event_id)) AS first_type FROM e GROUP BY client")
def first_type_wins(e, spark, sf_dir):
    return e.groupBy("client").agg(F.min_by("name", F.struct("us", "event_id")).alias("first_type"))


@query("SELECT event_id, count(*) OVER (PARTITION BY name, client ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS trailing FROM e")
def trailing_range(e, spark, sf_dir):
    return A.trailing_counts(e, DAY, "name", "client")


@query(", n AS (SELECT client, count(*) AS c FROM e GROUP BY client) SELECT client, c AS count, round(1000 * (c / (SELECT sum(c) FROM n)::BIGINT - 1.0 / (SELECT count(*) FROM n)), 6)::DOUBLE AS load FROM n")
def load_factor(e, spark, sf_dir):
    n = e.groupBy("client").agg(F.count("*").alias("count"))
    whole = n.agg(F.sum("count").alias("all"), F.count("*").alias("n"))  # one row
    return n.crossJoin(F.broadcast(whole)).select("client", "count", F.round(1000 * (F.col("count") / F.col("all") - 1 / F.col("n")), 6).alias("load"))


@query("SELECT name, (us // 3600000000) * 3600 AS bucket, count(*) AS count FROM e GROUP BY 1, 2")
def stream_buckets(e, spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(raw).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    out = bucket_counts(stream.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts")))
    return spark.read.parquet(written(out, "update", new_folder(spark))).groupBy("name", "bucket").agg(F.max_by("count", "batch").alias("count"))


@query("SELECT name, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM e) WHERE r <= 200")
def bottom_k_sample(e, spark, sf_dir):
    return A.bottom_k(e, 200, "name")
