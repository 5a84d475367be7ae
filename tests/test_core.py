import glob
import os
import zlib

import duckdb
import pytest

from tallyframe.engine import Engine, StateStore, admitted, types_of
from tallyframe.functions import scalars
from tallyframe.functions.windows import bounds, sanitised, valid
from tallyframe.operators.states import Buffer, Registry, Totals, merged
from tallyframe.operators import aggregates as A
from tallyframe.plans import api, catalogue, monitoring
from tallyframe.sources.wire import checked_bodies, decode_body, decode_bundles, encode_body, encode_clients, inflated, read_bodies

QUERIES, ORACLES = catalogue.QUERIES | api.QUERIES | monitoring.QUERIES, catalogue.ORACLES | api.ORACLES | monitoring.ORACLES
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(DIR + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_documented_percentiles(spark):
    e = spark.createDataFrame([("n", 100.0), ("n", 1000.0), ("n", None)], "name string, value double")
    r = A.percentiles(e, "name").first()
    assert (r["count"], r.total, r.p250, r.p500, r.p999) == (2, 1100.0, 100.0, 1000.0, 1000.0)


def test_percentiles_of_many_ties(spark):
    values = [1.0] * 500 + [float(i) for i in range(501)]
    r = A.percentiles(spark.createDataFrame([("n", v) for v in values], "name string, value double"), "name").first()
    assert [r[f"p{p}"] for p in (250, 500, 750, 999)] == [sorted(values)[p * len(values) // 1000] for p in (250, 500, 750, 999)]


def test_window_bounds_and_empty_table(spark):
    assert bounds(59_500_000, 1, 60) == (0, 60_000_000)
    e = spark.createDataFrame([], "event_id long, name string, client string, us long, value double")
    assert A.totals(e, "name").count() == A.percentiles(e, "name").count() == A.gauge(e, 0).count() == 0


def test_wire_round_trip(spark, tmp_path):
    events = [("c1", "n1", "A", 5.0, "321"), ("c1", "n2", "B", 5.0, '"s,\\"x"'), ("c2", "n2", "B", 6.0, "1.5")]
    body = encode_body(events)
    assert list(decode_body(body)) == events
    assert list(decode_body(body.rstrip("\n"))) == events
    with pytest.raises(ValueError):
        list(decode_body("2\n\n"))
    (tmp_path / "a").write_text(body)
    df = read_bodies(spark, f"file://{tmp_path}")
    got = [x for r in encode_clients(df).collect() for x in decode_body(r.body)]
    assert sorted(got) == sorted(events)


def test_wire_size_limits_and_pieces():
    body = encode_body([("client1", "name1", "typeA", 1234567890, "321")] * 75_000 + [("client1", "name2", "typeB", 1234567890, '"str1"')])
    got = [(c, n, k, len(v)) for c, n, k, v in decode_bundles(body)]
    assert got == [("client1", "name1", "typeA", 50_000), ("client1", "name1", "typeA", 25_000), ("client1", "name2", "typeB", 1)]
    packed = zlib.compress(body.encode())
    pieces = [packed[i : i + 1024] for i in range(0, len(packed), 1024)]
    assert list(decode_body(inflated(pieces))) == list(decode_body(body))
    with pytest.raises(ValueError, match="ends early"):
        list(inflated(pieces[:-1]))


@pytest.mark.parametrize("body", ["2\n\n", "1\nclient1\n", "1\n\nclient1\nname1\n"])
def test_wire_separators_must_stand(body):
    with pytest.raises(ValueError):
        list(decode_body(body))


def test_wire_files_plain_and_compressed(spark, tmp_path):
    events = [("c1", "n1", "A", 5.25, "321"), ("c2", "n2", "B", 6.0, '"\u2248"')]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "good").write_bytes(zlib.compress(encode_body(events).encode()))
    (tmp_path / "z" / "bad").write_bytes(b"nothing")
    got = read_bodies(spark, f"file://{tmp_path}/z", compressed=True, bad="drop").selectExpr("client", "name", "tab_type", "unix_micros(ts) / 1000000", "payload")
    assert sorted(map(tuple, got.collect())) == events
    with pytest.raises(Exception):
        read_bodies(spark, f"file://{tmp_path}/z", compressed=True).count()
    bodies = spark.createDataFrame([(encode_body(events),), ("",), ("7\n\n",)], "body string")
    assert [r.problem for r in checked_bodies(bodies).collect()] == [None, "no events", "unknown protocol version '7'"]


def test_names(spark):
    cases = {"aValidValue01_./-": "aValidValue01_./-", "a value with spaces": "a_value_with_spaces", "invalid&char1": "invalid_char1", "invalid|char2": "invalid_char2", "invalid'char3": "invalid_char3", "aUnicodeStr\u2248\u2248\u2248\u2248\u2606": "aUnicodeStr_____", "abc\n": "abc_", "": ""}
    got = spark.createDataFrame([(x,) for x in cases], "n string").select("n", valid("n").alias("v"), sanitised("n").alias("s")).collect()
    assert {r.n: r.s for r in got} == cases and {r.n for r in got if r.v} == {"aValidValue01_./-", ""}


def test_scalars(spark):
    rows = [("321",), ("[5, 9]",), ('"x"',), ("{}",), ("not json",), (None,)]
    x = spark.createDataFrame(rows, "p string").select(scalars.payload_value("p").alias("v"), scalars.payload_text("p").alias("t"), scalars.adler32("p").alias("a")).collect()
    assert [r.v for r in x] == [321.0, 5.0, None, None, None, None] and [r.t for r in x[:3]] == ["321", "5", "x"]
    assert [r.a for r in x[:-1]] == [zlib.adler32(p.encode()) for p, in rows[:-1]]
    import hashlib

    y = spark.createDataFrame([("c1", "n1"), ("c2", "name2")], "c string, n string").select("c", "n", scalars.agent_shard("c", "n").alias("s")).collect()
    assert all(r.s == int(hashlib.md5((r.c + r.n).encode()).hexdigest(), 16) % 750 for r in y)
    assert scalars.roles("frontend, BACKEND") == ["FRONTEND", "BACKEND"]
    with pytest.raises(ValueError):
        scalars.roles("cook")
    assert scalars.counter("c", "n", 1)[0][:3] == ("c", "n", "CounterGroup") and scalars.gauge("c", "bad name", 1, 2) == []


EVENTS = "name string, client string, tab_type string, event_id long, us long, value double, text string, expiry long"


def test_documented_counter_group(spark):
    """A counter of 100 and 1000 within the last minute, and a gauge."""
    rows = [("c", "x", "CounterGroup", i, 10**12 + i, v, None, None) for i, v in enumerate((100.0, 1000.0))] + [("g", "x", "Gauge", 5, 10**12, None, "value", None)]
    e = Engine.over_events(spark.createDataFrame(rows, EVENTS), 10**12 + 5)
    inner = '{"count": 2, "total": 1100.00, "average": 550.00}'
    want = "{" + ", ".join(f'"{x}": {inner}' for x in ("1m", "10m", "1h", "1d")) + ', "pct": {"count": 2, "total": 1100.000000, "pct": [100.00, 1000.00, 1000.00, 1000.00, 1000.00, 1000.00, 1000.00]}}'
    assert e.tabs(names="c").first().state == want and e.tabs(names="g").first().state == '{"value": 1}'
    assert e.supertabs(names="nothing").count() == 0 and len(e.tabs(raw=True).columns) == 15
    with pytest.raises(ValueError, match="different types"):
        e.supertabs()
    with pytest.raises(TypeError):
        e.tabs(colour="red")


def test_registry_and_upgrade(spark, tmp_path):
    class Newer(Totals):
        version = 1

    with pytest.raises(TypeError):
        Registry({"X": 5})
    with pytest.raises(KeyError):
        Registry()["unknown"]
    rows = [("n", "c", "TotalsCounter", 1, 1, 2.9, None, None), ("b", "c", "Buffer", 2, 1, 2.0, "2", 10**15)]
    df = spark.createDataFrame(rows, EVENTS)
    StateStore(spark, f"file://{tmp_path}/s").upsert(df)
    newer = StateStore(spark, f"file://{tmp_path}/s", Registry({"TotalsCounter": Newer()}))
    newer.upgrade()
    assert {(r.name, r.version, r.total) for r in newer.table("states").collect()} == {("n", 1, 2.0), ("b", 0, None)}

    class NewBuffer(Buffer):
        version = 3

    with pytest.raises(Exception, match="no upgrade"):
        StateStore(spark, f"file://{tmp_path}/s", Registry({"Buffer": NewBuffer()})).upgrade()
    newer.flush()
    assert newer.table("states").count() == 0


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_samples_and_tops_are_cut_before_the_shuffle(spark):
    """Else all cells of a name meet in one task."""
    rows = [("n", f"c{i % 7}", t, i, i, float(i), str(i), 10**15 + i) for i in range(3000) for t in ["Buffer"]]
    e = spark.createDataFrame(rows, EVENTS)
    registry = Registry({"Wide": Buffer(2500)})
    cells = Registry().fold(e, ("name",))
    assert nodes(cells, "WindowGroupLimit") == 4 and cells.count() == 1000  # of samples and of tops, on each partition and on all
    wide = registry.fold(e.replace("Buffer", "Wide", subset=["tab_type"]), ("name",))
    assert sorted(int(r.value) for r in wide.collect()) == list(range(500, 3000))
    stored = merged(registry.fold(e.unionByName(e.replace("Buffer", "Wide", subset=["tab_type"]))), "name")
    assert {(r.tab_type, r["count"]) for r in stored.groupBy("tab_type").count().collect()} == {("Buffer", 1000), ("Wide", 2500)}


def test_types_of_first_events_without_a_sort_or_a_join_by_name(spark):
    rows = [("n", "c", t, i, us, 1.0, None, None) for t, i, us in (("Gauge", 9, -5), ("Buffer", 2, -5), ("TotalsCounter", 1, 7))]
    e = spark.createDataFrame([*rows, ("m", "c", "Gauge", 2**62, 2**52, 1.0, None, None), ("m", "c", "Buffer", 2**62 + 1, 2**52, 1.0, None, None)], EVENTS)
    assert {tuple(r) for r in types_of(e).collect()} == {("n", "Buffer"), ("m", "Gauge")}
    x = admitted(e, Registry())
    assert nodes(x, "SortMergeJoin") == 0 and {(r.name, r.event_id) for r in x.collect()} == {("n", 2), ("m", 2**62)}


def test_latest_of_a_group_without_a_sort():
    import pandas as pd

    from tallyframe.streaming.states import _latest

    for us, ids, want in (([1, 3, 3, 2], [4, 9, 7, 1], 2), ([5], [0], 0), ([1.0, None, 1.0], [6, 2, 5], 2)):
        assert _latest(pd.DataFrame({"us": us, "event_id": ids})) == want
