"""The query API over events or stored states, and the maintenance of stored states."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.windows import valid
from .operators.states import COLUMNS, Registry, merged, rendered
from .schema import CELL


def matches(column: str, wanted: list[str] | str | None, use_re: bool) -> Column:
    """Whether a name or client is one of a list, or with use_re starts with a match of the expression; nothing wanted: all."""
    if not wanted:
        return F.lit(True)
    if use_re:
        patterns = [wanted] if isinstance(wanted, str) else wanted
        return F.col(column).rlike("|".join(f"^(?:{p})" for p in patterns))
    return F.col(column).isin(wanted.split(",") if isinstance(wanted, str) else wanted)


def not_listed(patterns: list[str]) -> Column:
    """Events whose name and client start with a match of none of the patterns."""
    out = F.lit(True)
    for p in patterns:
        out = out & ~F.col("name").rlike(f"^(?:{p})") & ~F.col("client").rlike(f"^(?:{p})")
    return out


def types_of(events: DataFrame) -> DataFrame:
    """name, tab_type: the type of each name's first event (by time, then id).

    Time and id make one number of 38 digits, so that events are hashed and not sorted; times past the year 170,000 would raise.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(-(2**63) if c == "event_id" else -(2**62))).cast("decimal(19,0)")
    place = (part("us") * F.lit(2 * 10**18).cast("decimal(19,0)") * F.lit(10) + part("event_id")).cast("decimal(38,0)")
    first = events.groupBy("name", "tab_type").agg(F.min(place).alias("first"))
    return first.groupBy("name").agg(F.min_by("tab_type", "first").alias("tab_type"))


#: So many names with their types are sent to every task (some MB); more are joined.
SENT = 100_000


def sent(types: DataFrame) -> DataFrame:
    """The types of names, computed once, as a table to broadcast if they are few: a join by name would gather a name's events in one task."""
    rows = types.limit(SENT + 1).collect()
    return F.broadcast(types.sparkSession.createDataFrame(rows, types.schema)) if len(rows) <= SENT else types


def permitted(events: DataFrame, registry: Registry, blacklist: list[str] | None = None) -> DataFrame:
    """Events with valid names and clients, not listed, of a known type."""
    return events.where(valid("name") & valid("client") & not_listed(blacklist or [])).where(registry.known())


def admitted(events: DataFrame, registry: Registry, blacklist: list[str] | None = None, types: DataFrame | None = None) -> DataFrame:
    """Events with valid names and clients, not listed, of a known type that is their name's registered one."""
    x = permitted(events, registry, blacklist)
    kept = sent(types_of(x)) if types is None else types
    return x.join(kept.select("name", F.col("tab_type").alias("_type")), "name").where(F.col("tab_type") == F.col("_type")).drop("_type")


def present(df: DataFrame) -> list[str]:
    """The types that occur, a handful: only their handlers need to be planned."""
    return [r[0] for r in df.select("tab_type").distinct().collect()]


class Engine:
    """Answers queries as of a time over the cells of (name, client) states.

    names and clients are lists, comma lists, or with use_re start-anchored expressions; that flag holds for both. Results are DataFrames.
    raw gives cells in place of JSON. Unknown arguments raise, as in any function.
    """

    def __init__(self, states: DataFrame | None, as_of: int, registry: Registry | None = None, events: DataFrame | None = None, kept: DataFrame | None = None):
        self._states, self.as_of, self.registry, self.events, self._kept = states, as_of, registry or Registry(), events, kept

    @classmethod
    def over_events(cls, events: DataFrame, as_of: int, registry: Registry | None = None, blacklist: list[str] | None = None) -> Engine:
        """Answers from events that pass admitted(); each query makes the states that it needs."""
        registry = registry or Registry()
        kept = sent(types_of(permitted(events, registry, blacklist)))
        return cls(None, as_of, registry, admitted(events, registry, blacklist, kept), kept)

    @property
    def states(self) -> DataFrame:
        return self._picked(None, None, False, True, "name", "client")[0]

    def _picked(self, names, clients, use_re: bool, raw: bool, *keys: str) -> tuple[DataFrame, Registry]:
        """The cells of the wanted states merged at the keys (unless raw, of those shown), and the handlers of the types that the wanted names have."""
        stored = self.events is None
        source = self._states if stored else self.events
        source = source.where(matches("name", names, use_re) & matches("client", clients, use_re))
        some = self.registry.only(present(source if stored or clients else self._kept.where(matches("name", names, use_re))))
        if not stored:
            return some.fold(source, keys, None if raw else self.as_of), some
        return source if "client" in keys else merged(source, *keys, kinds=some.kinds() or ("sum",)), some

    def _shown(self, cells: DataFrame, some: Registry, raw: bool, *keys: str) -> DataFrame:
        return cells if raw else rendered(cells, some, self.as_of, *keys)

    def projection(self, *, names=None, clients=None, use_re: bool = False, raw: bool = False) -> DataFrame:
        """A state for each (name, client)."""
        cells, some = self._picked(names, clients, use_re, raw, "name", "client")
        return self._shown(cells, some, raw, "name", "client")

    def tabs(self, *, names=None, clients=None, use_re: bool = False, raw: bool = False) -> DataFrame:
        """States merged over clients."""
        cells, some = self._picked(names, clients, use_re, raw, "name")
        return self._shown(cells, some, raw, "name")

    def supertabs(self, *, names=None, clients=None, use_re: bool = False, raw: bool = False, one_type: bool = True) -> DataFrame:
        """States merged over names too: of one type, or an error; with one_type off a row for each type. No match: no row."""
        cells, some = self._picked(names, clients, use_re, raw)
        if one_type and len(some.handlers) > 1:
            raise ValueError(f"states of different types can't be merged: {', '.join(some.handlers)}")
        return self._shown(cells, some, raw)

    def _pairs(self) -> DataFrame:
        return self._states if self.events is None else self.events

    def clients(self, *, clients=None, use_re: bool = False) -> DataFrame:
        return self._pairs().where(matches("client", clients, use_re)).select("client").distinct()

    def names(self, *, names=None, clients=None, use_re: bool = False) -> DataFrame:
        """Names, if clients are given only those with a state of one of them."""
        return self._pairs().where(matches("name", names, use_re) & matches("client", clients, use_re)).select("name").distinct()

    def types(self, *, names=None, use_re: bool = False) -> DataFrame:
        return self._pairs().where(matches("name", names, use_re)).select("name", "tab_type").distinct()

    def get(self, name: str, client: str) -> DataFrame:
        """The cells of one state."""
        return self.states.where((F.col("name") == name) & (F.col("client") == client))

    def sizes(self) -> DataFrame:
        """clients and cells of each name."""
        return self.states.groupBy("name").agg(F.count_distinct("client").alias("clients"), F.count("*").alias("cells"))

    def prunable(self) -> DataFrame:
        """(name, client) of states of which nothing is left as of the time."""
        out, states = None, self.states
        for tab_type, h in self.registry.only(present(states)).handlers.items():
            one = states.where(F.col("tab_type") == tab_type).groupBy("name", "client").agg(h.empty(self.as_of).alias("gone")).where("gone").select("name", "client")
            out = one if out is None else out.unionByName(one)
        return states.select("name", "client").where("false") if out is None else out


def text_lines(result: DataFrame, *keys: str) -> DataFrame:
    """value: `keys: state` lines of a result in order of the keys."""
    return result.orderBy(*keys).select(F.concat(F.concat_ws(", ", *keys), F.lit(": "), F.col("state")).alias("value"))


class StateStore:
    """States, types and dictionaries as tables in a folder; each change writes a new version and then names it the current one.

    A change reads the current version, so it may be run again after a failure: a half-written version is never named.
    """

    TABLES = {"states": CELL, "types": "name string, tab_type string", "ids": "kind string, id long, value string"}

    def __init__(self, spark: SparkSession, folder: str, registry: Registry | None = None):
        self.spark, self.folder, self.registry = spark, folder.rstrip("/"), registry or Registry()

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _current(self) -> dict[str, str]:
        path = self._path(f"{self.folder}/current")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []
        return dict(x.split("=") for x in names[-1].split(",")[1:]) if names else {}

    def table(self, name: str) -> DataFrame:
        at = self._current().get(name)
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], self.TABLES[name])

    def _commit(self, batch: int | None = None, **tables: DataFrame) -> None:
        now = self._current()
        if batch is not None:
            now["batch"] = str(batch)
        for name, df in tables.items():
            now[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{now[name]}")
        path = self._path(f"{self.folder}/current")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        version = 1 + max([int(f.getPath().getName().split(",")[0]) for f in store.listStatus(path)] if store.exists(path) else [0])
        store.mkdirs(path)
        mark = f"{self.folder}/current/{version:012d}," + ",".join(f"{k}={v}" for k, v in now.items())
        if not store.createNewFile(self._path(mark)):
            raise RuntimeError("another change came first; run this one again")

    def last_batch(self) -> int:
        """The number of the last micro-batch merged, -1 without any."""
        return int(self._current().get("batch", -1))

    def upsert(self, events: DataFrame, blacklist: list[str] | None = None, batch: int | None = None) -> None:
        """Merges new events into the states; names keep the type they have, new names and clients get ids. batch: a number to keep with it."""
        known = self.table("types")
        x = events.where(self.registry.known())
        types = sent(known.unionByName(types_of(x).join(known.select("name"), "name", "left_anti")))
        new = admitted(events, self.registry, blacklist, types)
        cells = self.registry.only(present(types)).exploded(new)
        self._commit(states=merged(self.table("states").unionByName(cells), "name", "client"), types=types, ids=self._with_ids(new.select("name", "client")), batch=batch)

    def _with_ids(self, new: DataFrame) -> DataFrame:
        """The dictionaries with ids for new names and clients: above all earlier ones, in order of the values' hash ranges, with gaps."""
        have = self.table("ids")
        values = new.select(F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("client").alias("kind"), F.col("client").alias("value")))).alias("x")).select("x.*")
        values = values.where("value is not null").distinct().join(have.select("kind", "value"), ["kind", "value"], "left_anti")
        top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        return have.unionByName(values.join(F.broadcast(top), F.lit(True)).select("kind", (F.col("top") + 1 + F.monotonically_increasing_id()).alias("id"), "value"))  # one row

    def engine(self, as_of: int) -> Engine:
        return Engine(self.table("states"), as_of, self.registry)

    def ids(self) -> DataFrame:
        return self.table("ids")

    def delete(self, names) -> None:
        """Drops names with their states, types and ids; ids aren't used again while larger ones exist."""
        gone = lambda c: ~F.col(c).isin(names.split(",") if isinstance(names, str) else names)
        self._commit(states=self.table("states").where(gone("name")), types=self.table("types").where(gone("name")), ids=self.table("ids").where((F.col("kind") != "name") | gone("value")))

    def gc(self, as_of: int) -> None:
        """Drops states of which nothing is left, buckets and values that no query as of this time or later shows, and unused dictionary entries."""
        e = self.engine(as_of)
        states = e.states.join(e.prunable(), ["name", "client"], "left_anti").where(F.col("expiry").isNull() | (F.col("expiry") > as_of))
        self._commit(states=states)
        left = self.table("states")
        used = left.select(F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(left.select(F.lit("client"), "client").toDF("kind", "value")).distinct()
        self._commit(types=self.table("types").join(left.select("name").distinct(), "name", "left_semi"), ids=self.table("ids").join(used, ["kind", "value"], "left_semi"))

    def problems(self) -> DataFrame:
        """problem, kind, value of states without a type, of another type, types and ids without a state, and doubled or missing ids."""
        states, types, ids = self.table("states"), self.table("types"), self.table("ids")
        names = states.select("name").distinct()
        both = states.select("name", F.col("tab_type").alias("own")).distinct().join(types, "name", "full_outer")
        wrong = both.select(F.when(F.col("own").isNull(), "type without states").when(F.col("tab_type").isNull(), "states without a type").when(F.col("own") != F.col("tab_type"), "states of another type").alias("problem"), F.lit("name").alias("kind"), F.col("name").alias("value")).where("problem is not null")
        used = names.select(F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(states.select(F.lit("client").alias("kind"), F.col("client").alias("value")).distinct())
        index = used.withColumn("used", F.lit(True)).join(ids, ["kind", "value"], "full_outer")
        index = index.select(F.when(F.col("id").isNull(), "no id").when(F.col("used").isNull(), "id without states").alias("problem"), "kind", "value").where("problem is not null")
        twice = ids.groupBy("kind", "id").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n > 1").select(F.lit("id used twice").alias("problem"), "kind", "value")
        return wrong.unionByName(index).unionByName(twice)

    def self_check(self, dry: bool = True) -> DataFrame:
        """problems(); unless dry, what has no states or no type is dropped and missing ids are made."""
        if dry:
            return self.problems()
        report = f"{self.folder}/report-{uuid.uuid4().hex}"  # as found, before the change
        self.problems().write.parquet(report)
        states = self.table("states").join(self.table("types"), ["name", "tab_type"], "left_semi").select(*COLUMNS)
        types = self.table("types").join(states.select("name").distinct(), "name", "left_semi")
        used = states.select(F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(states.select(F.lit("client").alias("kind"), F.col("client").alias("value"))).distinct()
        ids = self._with_ids(states.select("name", "client")).join(used, ["kind", "value"], "left_semi").select("kind", "id", "value")
        self._commit(states=states, types=types, ids=ids)
        return self.spark.read.parquet(report)

    def upgrade(self) -> None:
        """Brings the states of all types to their handlers' versions."""
        states = self.table("states")
        out = states.where("false")
        for tab_type, h in self.registry.only(present(states)).handlers.items():
            one = h.upgrade(states.where(F.col("tab_type") == tab_type)).select(*COLUMNS)
            out = out.unionByName(one)
        self._commit(states=out)

    def flush(self) -> None:
        """Empties all tables."""
        self._commit(**{name: self.spark.createDataFrame([], schema) for name, schema in self.TABLES.items()})
