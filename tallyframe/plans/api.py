"""Named queries of the parameterised API over typed events, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine, StateStore, admitted, text_lines, types_of
from ..operators.states import Group, MovingPercentile, Pyramid, Registry, Totals
from ..schema import BUFFER_ROWS, COARSE, GROUP_SAMPLES, INTERVALS, MOVING, MOVING_SAMPLES, PER_MILLE
from ..sources.events import TYPED, latest, typed
from ..streaming.buckets import new_folder
from . import catalogue

QUERIES, ORACLES = {}, {}
DAY = 86_400_000_000

OF_NAME = "CASE name " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in TYPED.items()) + " END"
#: Events with their own types, then those of their name's first type.
Y = f"""{catalogue.E}, y AS (SELECT *, CASE WHEN event_id % 97 = 0 AND event_id > 96 THEN 'PercentileCounter' ELSE {OF_NAME} END AS tab_type, round(value)::BIGINT::VARCHAR AS text, us + k * {DAY} AS expiry FROM e),
r AS (SELECT name, arg_min(tab_type, (us, event_id)) AS kept FROM y GROUP BY name), a AS (SELECT y.* FROM y JOIN r ON y.name = r.name AND tab_type = kept)"""


def api(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            e = catalogue.load_events(spark, sf_dir)
            return f(typed(e), spark, latest(e))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {Y} {sql}"
        return f

    return add


def totals_json(where: str, keys: str) -> str:
    c, t = "count(value)", "coalesce(sum(trunc(value)::BIGINT), 0)::DOUBLE"
    by = f"GROUP BY {keys}" if keys else ""
    lead = keys + ", " if keys else ""
    return f"SELECT {lead}any_value(tab_type) AS tab_type, printf('{{\"count\": %d, \"total\": %.2f, \"average\": %.2f}}', {c}, {t}, coalesce({t} / nullif({c}, 0), 0)) AS state FROM a WHERE {where} {by}"


def _sums(specs, average: bool = True) -> str:
    out = []
    for x, (w, n) in specs.items():
        hit = catalogue._hit(w, n)
        c, t = f"count(value) FILTER (WHERE {hit})", f"coalesce(sum(value) FILTER (WHERE {hit}), 0)"
        out.append(f"printf('\"{x}\": {{\"count\": %d, \"total\": %.2f, \"average\": %.2f}}', {c}, {t}, coalesce({t} / nullif({c}, 0), 0))")
    return " || ', ' || ".join(out)


def _pct(values: str, count: str, total: str) -> str:
    n = f"len({values})"
    each = " || ', ' || ".join(f"printf('%.2f', coalesce(list_sort({values})[({p} * {n}) // 1000 + 1], 0))" for p in PER_MILLE)
    return f"printf('{{\"count\": %d, \"total\": %f, \"pct\": [', {count}, {total}) || {each} || ']}}'"


LOW = f"list(value) FILTER (WHERE place <= {GROUP_SAMPLES})"
GROUPS = f"""p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(event_id::VARCHAR)) AS place FROM a, t WHERE tab_type = 'CounterGroup')
SELECT name, any_value(tab_type) AS tab_type, '{{' || {_sums(INTERVALS)} || ', "pct": ' || {_pct(LOW, "count(value)", "sum(value)")} || '}}' AS state FROM p GROUP BY name"""


@api(totals_json("name IN ('view', 'nothing')", "name, client"))
def api_projection(y, spark, now):
    return Engine.over_events(y, now).projection(names="view,nothing")


@api(totals_json("regexp_matches(name, '^(?:vi)') AND regexp_matches(client, '^(?:user_1)')", "name"))
def api_tabs_by_expression(y, spark, now):
    return Engine.over_events(y, now).tabs(names="vi", clients="user_1", use_re=True)


@api(totals_json("name = 'view' AND client IN ('user_1', 'user_2')", ""))
def api_supertabs(y, spark, now):
    return Engine.over_events(y, now).supertabs(names=["view"], clients=["user_1", "user_2"])


@api(f", {GROUPS}")
def api_counter_group(y, spark, now):
    """Interval averages and percentiles of a counter group, as JSON."""
    return Engine.over_events(y, now).tabs(names=["click"])


def _moving() -> tuple[str, str, str]:
    """CTEs of the intervals' samples (each bucket keeps its own, the interval one of what its buckets kept), the JSON, the joins."""
    ctes, parts, joins = [], [], []
    for x, (w, n) in (MOVING | COARSE).items():
        k = MOVING_SAMPLES.get(x, 128)
        ctes.append(f"""b_{x} AS (SELECT *, row_number() OVER (PARTITION BY name, us // {w * 1_000_000} ORDER BY md5(event_id::VARCHAR)) AS i FROM a, t WHERE tab_type = 'PercentileGroup' AND {catalogue._hit(w, n)}),
m_{x} AS (SELECT *, row_number() OVER (PARTITION BY name, i <= {k} ORDER BY md5(event_id::VARCHAR)) AS j FROM b_{x}),
v_{x} AS (SELECT name, count(*) AS n, sum(value) AS s, list_sort(list(value) FILTER (WHERE i <= {k} AND j <= {k})) AS v FROM m_{x} GROUP BY name)""")
        each = " || ', ' || ".join(f"printf('%.2f', coalesce(v_{x}.v[({p} * len(v_{x}.v)) // 1000 + 1], 0))" for p in PER_MILLE)
        parts.append(f"printf('\"{x}\": {{\"count\": %d, \"total\": %f, \"pct\": [', coalesce(v_{x}.n, 0), coalesce(v_{x}.s, 0)) || {each} || ']}}'")
        joins.append(f"LEFT JOIN v_{x} ON v_{x}.name = g.name")
    return ", ".join(ctes), " || ', ' || ".join(parts), " ".join(joins)


_CTES, _PARTS, _JOINS = _moving()


@api(f", {_CTES}, g AS (SELECT DISTINCT name, tab_type FROM a WHERE tab_type = 'PercentileGroup') SELECT g.name, tab_type, '{{' || {_PARTS} || '}}' AS state FROM g {_JOINS}")
def api_percentile_group(y, spark, now):
    return Engine.over_events(y, now, Registry({"PercentileGroup": MovingPercentile(MOVING | COARSE)})).tabs(names=["purchase"])


LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY name, client ORDER BY us DESC, md5(event_id::VARCHAR) DESC) AS i FROM a WHERE tab_type = 'Gauge'), h AS (SELECT name, text, count(*) AS n FROM l, t WHERE i = 1 AND us + 48 * 3600000000 > now GROUP BY name, text)"


@api(f""", {LAST}, g AS (SELECT DISTINCT name FROM l) SELECT name, 'Gauge' AS tab_type, coalesce((SELECT '{{' || string_agg(x, ', ' ORDER BY x) || '}}' FROM (SELECT printf('"%s": %d', text, n) AS x FROM h WHERE h.name = g.name)), '{{}}') AS state FROM g""")
def api_gauge(y, spark, now):
    return Engine.over_events(y, now).tabs(names=["error"])


@api(f""", b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY expiry DESC, event_id) AS i FROM a, t WHERE tab_type = 'Buffer')
SELECT name, 'Buffer' AS tab_type, '[' || string_agg(printf('["%s", %d]', text, us // 1000000), ', ' ORDER BY i) FILTER (WHERE i <= {BUFFER_ROWS} AND expiry > now) || ']' AS state FROM b GROUP BY name""")
def api_buffer(y, spark, now):
    return Engine.over_events(y, now).tabs(names=["signup"])


@api("SELECT name, kept AS tab_type FROM r WHERE regexp_matches(name, '^(?:[c-p])')")
def api_types(y, spark, now):
    return types_of(y).where(F.col("name").rlike("^(?:[c-p])"))


@api("SELECT name, client, count(*) AS events FROM a WHERE NOT (regexp_matches(name, '^(?:err)') OR regexp_matches(client, '^(?:err)')) AND NOT (regexp_matches(name, '^(?:user_2)') OR regexp_matches(client, '^(?:user_2)')) GROUP BY name, client")
def api_admitted(y, spark, now):
    """Blacklist, types and type conflicts."""
    return admitted(y, Registry(), ["err", "user_2"]).groupBy("name", "client").agg(F.count("*").alias("events"))


@api("SELECT DISTINCT client FROM a WHERE regexp_matches(client, '^(?:user_1)')")
def api_clients(y, spark, now):
    return Engine.over_events(y, now).clients(clients="user_1", use_re=True)


@api("SELECT DISTINCT name FROM a WHERE client IN ('user_1', 'user_9') AND name IN ('view', 'click')")
def api_names(y, spark, now):
    return Engine.over_events(y, now).names(names=["view", "click"], clients=["user_1", "user_9"])


@api(f"{totals_json("name = 'view'", 'name, client').replace('SELECT name, client, any_value(tab_type) AS tab_type, ', 'SELECT client AS value0, ').replace('SELECT client AS value0, ', "SELECT 'view, ' || client || ': ' || ")} ".replace(" AS state FROM a", " AS value FROM a"))
def api_text(y, spark, now):
    return text_lines(Engine.over_events(y, now).projection(names=["view"]), "name", "client")


def _store(spark, registry: Registry | None = None) -> StateStore:
    return StateStore(spark, new_folder(spark), registry)


ALL = f"""SELECT name, tab_type, count(value) AS count, round(sum(value), 2) AS total FROM a WHERE name = 'click' GROUP BY name, tab_type"""


@api(ALL)
def state_upserts(y, spark, now):
    """States of two batches, merged one after the other, equal those of all events."""
    store = _store(spark)
    for i in range(2):  # the first batch holds each name's first event
        early = y.where(F.col("event_id") < 97) if i == 0 else y.where(F.col("event_id") >= 97)
        store.upsert(early)
    cells = store.engine(now).tabs(names=["click"], raw=True).where("kind = 'sum' and part = 'pct/all'")
    return cells.groupBy("name", "tab_type").agg(F.sum("count").alias("count"), F.round(F.sum("total"), 2).alias("total"))


@api(f"SELECT DISTINCT name, client FROM a, t WHERE tab_type = 'TotalsCounter' OR (tab_type = 'Buffer' AND expiry > now) OR (tab_type = 'Gauge' AND us + 48 * 3600000000 > now) OR (tab_type = 'CounterGroup' AND {catalogue._hit(900, 96)}) OR (tab_type = 'PercentileGroup' AND {catalogue._hit(21600, 4)})")
def state_gc(y, spark, now):
    """(name, client) of the states that are left after a collection."""
    store = _store(spark)
    store.upsert(y)
    store.gc(now)
    return store.table("states").select("name", "client").distinct()


@api("SELECT name, client FROM a WHERE name NOT IN ('view', 'error') GROUP BY name, client")
def state_delete(y, spark, now):
    store = _store(spark)
    store.upsert(y)
    store.delete("view,error")
    return store.table("states").select("name", "client").distinct()


@api("SELECT 'name' AS kind, name AS value FROM a UNION SELECT 'client', client FROM a")
def state_ids(y, spark, now):
    """The dictionaries: every id stands for one value."""
    store = _store(spark)
    store.upsert(y)
    store.upsert(y)
    return store.ids().groupBy("kind", "id").agg(F.max("value").alias("value")).select("kind", "value")


@api("SELECT 'type without states' AS problem, 'name' AS kind, 'ghost' AS value UNION ALL SELECT 'no id', 'name', 'view' UNION ALL SELECT 'no id', 'client', 'user_1' UNION ALL SELECT 'states without a type', 'name', 'error'")
def state_self_check(y, spark, now):
    """A store spoilt in four ways, as its check reports it; the repair must leave none."""
    store = _store(spark)
    store.upsert(y)
    types = store.table("types").where("name <> 'error'").unionByName(spark.createDataFrame([("ghost", "Buffer")], "name string, tab_type string"))
    store._commit(types=types, ids=store.table("ids").where("value not in ('view', 'user_1')"))
    found = store.self_check(dry=False)
    left = store.self_check()
    return found.unionByName(left)


@api("SELECT name, client, count(value) AS count, count(DISTINCT us // 86400000000) AS days FROM a WHERE name = 'view' GROUP BY name, client")
def api_registered_group(y, spark, now):
    """A user's aggregate composed of handlers: totals and buckets of a day, under a type that had another handler."""
    own = Group({"whole": Totals(), "daily": Pyramid({"d": (86400, 4000)})}, ("whole",))
    cells = Engine.over_events(y, now, Registry({"TotalsCounter": own})).projection(names=["view"], raw=True)
    count = F.sum(F.when(F.col("part") == "whole/all", F.col("count")))
    return cells.groupBy("name", "client").agg(count.alias("count"), F.count_if(F.col("part") == "daily/d").alias("days"))
