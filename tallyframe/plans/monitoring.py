"""Named queries of monitoring, limits, scalar rules and streams, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import monitoring as M
from ..sources.events import latest, typed
from ..sources.wire import decode_bundles, encode_clients
from ..streaming.buckets import new_folder, written
from ..streaming.states import keep_states, latest_values, sliding_counts
from . import api, catalogue

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            e = catalogue.load_events(spark, sf_dir)
            return f(e, spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {api.Y} {sql}"
        return f

    return add


SLOT = "s AS (SELECT name, value, us // 10000000 * 10 AS slot, row_number() OVER (PARTITION BY name, us // 10000000 ORDER BY md5(event_id::VARCHAR)) AS i FROM e, t WHERE us <= now)"


@query(f", {SLOT}, h AS (SELECT name, list_sort(list(value)) AS v FROM s, t WHERE i <= 1000 AND slot > now // 1000000 - 600 GROUP BY name) SELECT name, " + ", ".join(f"v[floor((len(v) - 1) * {f}::DOUBLE)::BIGINT + 1] AS p{i}" for i, f in enumerate((0.5, 0.9, 0.99))) + " FROM h")
def sampler_percentiles(e, spark, sf_dir):
    return M.sampled_percentiles(e, latest(e), (0.5, 0.9, 0.99), "name")


@query("SELECT name, us // 60000000 * 60 AS slot, count(*) / 60.0::DOUBLE AS rate FROM e GROUP BY 1, 2")
def event_rates(e, spark, sf_dir):
    return M.event_rates(e, 60, "name")


@query("SELECT name, client, round(avg((now - us) / 1000000.0::DOUBLE), 3) AS latency FROM e, t GROUP BY name, client")
def post_latency(e, spark, sf_dir):
    x = M.post_latency(e, F.lit(latest(e)))
    return x.withColumn("latency", F.round("latency", 3))


@query(", s AS (SELECT client, max(us) AS us, median(value) AS q, avg(value) AS p FROM e GROUP BY client) SELECT round(coalesce(avg(q + p), 0), 6) AS latency FROM s, t WHERE us > now - 86400000000")
def cluster_latency(e, spark, sf_dir):
    servers = e.groupBy("client").agg(F.max("us").alias("us"), F.median("value").alias("queued"), F.avg("value").alias("processed"))
    return M.cluster_latency(servers, latest(e), 86_400).select(F.round("latency", 6).alias("latency"))


QUEUES = "q AS (SELECT name AS server, client AS shard, count(*) AS tasks, min(us) AS us FROM e GROUP BY 1, 2)"


def _queues(e):
    return e.groupBy(F.col("name").alias("server"), F.col("client").alias("shard")).agg(F.count("*").alias("tasks"), F.min("us").alias("us"))


@query(f", {QUEUES}, o AS (SELECT server, count(*) AS shards, sum(tasks)::BIGINT AS tasks, max((now - us) / 1000000.0::DOUBLE) AS oldest FROM q, t GROUP BY server) SELECT *, round(1000 * (tasks / (SELECT sum(tasks) FROM o)::DOUBLE - 1.0::DOUBLE / (SELECT count(*) FROM o)), 6) AS load FROM o")
def queue_statistics(e, spark, sf_dir):
    return M.queue_statistics(_queues(e), latest(e))


@query(", b AS (SELECT name AS url, count(*) AS shards, sum(n)::BIGINT AS total_events, sum(n % 7)::BIGINT AS buffered, sum(n % 5)::BIGINT AS queued, sum(n % 3)::BIGINT AS pending FROM (SELECT name, client, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) SELECT *, buffered * 100.0::DOUBLE / 5000000 AS buffer_pct, round(1000 * (total_events / (SELECT sum(total_events) FROM b)::DOUBLE - 1.0::DOUBLE / (SELECT count(*) FROM b)), 6) AS load FROM b")
def agent_status(e, spark, sf_dir):
    n = e.groupBy(F.col("name").alias("url"), "client").agg(F.count("*").alias("total_events"))
    return M.agent_status(n.select("url", "total_events", *[(F.col("total_events") % m).alias(c) for c, m in (("buffered", 7), ("queued", 5), ("pending", 3))]))


@query(", l AS (SELECT client AS server, list(value ORDER BY us, value) AS v FROM e GROUP BY client) SELECT server, round(list_reduce(v, lambda a, b: b + (a - b) * 0.75::DOUBLE), 6) AS weight FROM l")
def load_weights(e, spark, sf_dir):
    loads = e.select(F.col("client").alias("server"), "us", F.col("value").alias("load"))
    return M.load_weights(loads).select("server", F.round("weight", 6).alias("weight"))


@query(f", {QUEUES} SELECT server, shard, row_number() OVER (PARTITION BY server ORDER BY us, shard)::INTEGER AS turn FROM q")
def oldest_first(e, spark, sf_dir):
    return M.oldest_first(_queues(e))


@query(", w AS (SELECT client AS shard, row_number() OVER (ORDER BY count(*) DESC, client) - 1 AS p FROM e GROUP BY client) SELECT shard, CASE p // 4 % 2 WHEN 0 THEN p % 4 ELSE 3 - p % 4 END::INTEGER AS server FROM w")
def assigned_shards(e, spark, sf_dir):
    return M.assigned(e.groupBy(F.col("client").alias("shard")).agg(F.count("*").alias("weight")), 4)


@query(", u AS (SELECT name AS url, count(DISTINCT client) AS shards FROM e GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY shards, url) AS i, sum(shards) OVER ()::BIGINT AS a, count(*) OVER () AS n FROM u) SELECT url, shards, a // n + CASE WHEN i > n - a % n THEN 1 ELSE 0 END AS target, a // n + CASE WHEN i > n - a % n THEN 1 ELSE 0 END - shards AS moves FROM i")
def handed_over(e, spark, sf_dir):
    return M.handed_over(e.groupBy(F.col("name").alias("url")).agg(F.count_distinct("client").alias("shards")))


@query("SELECT client, count(*) FILTER (WHERE i <= 20) AS sent, count(*) FILTER (WHERE i > 20) AS left_over FROM (SELECT client, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS i FROM e) GROUP BY client")
def per_client_limit(e, spark, sf_dir):
    return M.per_client(e, 20).groupBy("client").agg(F.count_if("now").alias("sent"), F.count_if(~F.col("now")).alias("left_over"))


@query(", n AS (SELECT client, name, count(*) AS n FROM e GROUP BY 1, 2) SELECT client, name, b AS bundle, least(5, n - b * 5) AS events FROM (SELECT client, name, n, unnest(range(0, (n - 1) // 5 + 1)) AS b FROM n)")
def bundle_limit(e, spark, sf_dir):
    return M.bundles(e, 5)


@query(", n AS (SELECT name, client, count(*) * 20000 AS queued FROM e GROUP BY 1, 2) SELECT name, client, round(greatest(0, least(1, (queued - 50000) / 1950000.0::DOUBLE)), 6) AS chance, round(pow(0.001, 1.0 / (queued // 20000)), 6) AS sits_out FROM n")
def admission(e, spark, sf_dir):
    n = e.groupBy("name", "client").agg((F.count("*") * 20000).alias("queued"), F.count("*").alias("servers"))
    return n.select("name", "client", F.round(S.admission("queued"), 6).alias("chance"), F.round(S.skip_chance("servers"), 6).alias("sits_out"))


@query()
def agent_shards(e, spark, sf_dir):
    return e.select("client", "name").distinct().withColumn("shard", S.agent_shard("client", "name"))


@query()
def checksums(e, spark, sf_dir):
    return e.select("client").distinct().select("client", S.adler32("client").alias("adler"), S.vbucket("client").alias("bucket"), S.storage_shard("client", [16, 40, 64]).alias("shard"))


@query("SELECT client, name, count(*) AS events FROM e GROUP BY client, name")
def wire_round_trip(e, spark, sf_dir):
    """Every event written as request bodies and read again."""
    import pandas as pd

    x = typed(e).select("client", "name", "tab_type", F.timestamp_micros("us").alias("ts"), F.col("value").cast("string").alias("payload"))

    def read(frames):
        for pdf in frames:
            rows = [(c, n, len(v)) for body in pdf["body"] for c, n, _, v in decode_bundles(body)]
            yield pd.DataFrame(rows, columns=["client", "name", "events"])

    read_again = encode_clients(x, 5000).mapInPandas(read, "client string, name string, events long")
    return read_again.groupBy("client", "name").agg(F.sum("events").alias("events"))


def _stream(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(raw).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events*.parquet")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    return s.select("event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("client"), F.col("event_type").alias("name"), F.unix_micros(ts).alias("us"), ts.alias("ts"), "value", k.alias("k"))


@query(", w AS (SELECT name, unnest([us // 21600000000 * 21600, us // 21600000000 * 21600 - 21600, us // 21600000000 * 21600 - 43200, us // 21600000000 * 21600 - 64800]) AS start FROM e) SELECT name, start, count(*) AS count FROM w GROUP BY 1, 2")
def stream_sliding(e, spark, sf_dir):
    out = spark.read.parquet(written(sliding_counts(_stream(spark, sf_dir)), "update", new_folder(spark)))
    return out.groupBy("name", "start").agg(F.max_by("count", "batch").alias("count"))


@query(", l AS (SELECT name, client, value, us, row_number() OVER (PARTITION BY name, client ORDER BY us DESC, event_id) AS i FROM e) SELECT name, client, us FROM l WHERE i = 1")
def stream_gauge(e, spark, sf_dir):
    """The latest value's time of each (name, client), from a stream with state by key."""
    values = _stream(spark, sf_dir).withColumn("value", F.col("value").cast("string"))
    out = spark.read.parquet(written(latest_values(values), "append", new_folder(spark)))
    return out.groupBy("name", "client").agg(F.max("us").alias("us"))


@query("SELECT name, tab_type, count(value) AS count FROM a WHERE name = 'view' GROUP BY name, tab_type")
def stream_states(e, spark, sf_dir):
    """States kept by a stream."""
    store = api._store(spark)
    keep_states(typed(_stream(spark, sf_dir)), store, f"{store.folder}/checkpoint").awaitTermination()
    return store.engine(latest(e)).tabs(names=["view"], raw=True).groupBy("name", "tab_type").agg(F.sum("count").alias("count"))
