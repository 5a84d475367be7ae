"""Mergeable states: rows of cells, the handlers that make and render them, and their registry.

A state of (name, client) is a few rows, its cells. Cells of one key merge without regard to order, in one of four ways:
  sum     counts and totals of a bucket or of all time are added;
  sample  of the values of a percentile counter those with the `room` lowest scores stay (a uniform sample, as scores are hashes);
  last    of a client's values that of the latest (expiry, time) stays;
  top     the `room` values of the latest expiries stay.
So states of new events merge into stored ones, clients merge into names and names into types by one function. Any aggregate that is
built of such cells can be registered; see Handler.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import bounds
from ..schema import BUFFER_ROWS, CELL, GAUGE_HOURS, GROUP_SAMPLES, INTERVALS, MOVING, MOVING_SAMPLES, PER_MILLE, SAMPLES

COLUMNS = [c.split()[0] for c in CELL.split(", ")]
SECOND = 1_000_000


TYPES = dict(c.split() for c in CELL.split(", "))
MADE = [c for c in COLUMNS if c not in ("name", "client", "tab_type")]


def cell(kind: str, part: Column | str, when: Column | None = None, **made: Column) -> Column:
    """One cell of an event, or null if `when` doesn't hold."""
    have = {"kind": F.lit(kind), "part": F.lit(part) if isinstance(part, str) else part, "version": F.lit(0)} | made
    out = F.struct(*[have.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in MADE])
    return out if when is None else F.when(when, out)


def score() -> Column:
    """An event's place in a uniform sample: a hash, so that reruns agree."""
    return F.md5(F.col("event_id").cast("string"))


def fixed(x: Column | str, digits: int = 2) -> Column:
    """A number to print with %.2f: ties go to the even digit, as where the format comes from."""
    return F.bround(F.col(x) if isinstance(x, str) else x, digits)


def _bucket(width: int) -> Column:
    """Start of the event's bucket in seconds, also before the epoch."""
    return F.floor(F.col("us") / (width * SECOND)).cast("long") * width


class Handler:
    """An aggregate. cells are made of an event (name, client, event_id, us, value, text, expiry); render makes text of merged cells.

    Subclass it, or compose handlers by Group, and register the class's instance under a type.
    """

    version = 0
    kinds = ("sum", "sample", "last", "top")  # of its cells

    def cells(self) -> list[Column]:
        raise NotImplementedError

    def labelled(self) -> list[tuple[str, Column]]:
        """The cells, each with what goes before its part."""
        return [("", c) for c in self.cells()]

    def render(self, cells: DataFrame, as_of: int, keys: list[str]) -> DataFrame:
        """keys (tab_type among them) and `state`, JSON."""
        raise NotImplementedError

    def empty(self, as_of: int) -> Column:
        """Over a state's cells, an aggregate: whether nothing is left of it."""
        return F.lit(False)

    def room(self) -> int | None:
        """The largest room of its cells, None if it doesn't tell (of a handler without samples and tops: 0)."""
        return None if {"sample", "top"} & set(self.kinds) else 0

    def shown(self, as_of: int, prefix: str = "") -> Column:
        """The samples that render may show, of parts with a prefix; others needn't be merged for it."""
        return F.lit(True)

    def upgrade(self, cells: DataFrame) -> DataFrame:
        """Cells of older versions as those of this one."""
        known = (F.col("version") == self.version) | F.raise_error(F.concat(F.lit("no upgrade from version "), F.col("version").cast("string"))).isNotNull()
        return cells.where(known)


class Totals(Handler):
    """All-time count and sum of whole parts."""

    kinds = ("sum",)

    def cells(self):
        return [cell("sum", "all", F.col("value").isNotNull(), count=F.lit(1), total=F.col("value").cast("long"))]

    def render(self, cells, as_of, keys):
        c, t = F.sum("count"), F.sum("total")
        average = F.coalesce(t / F.nullif(c, F.lit(0)), F.lit(0.0))
        return cells.groupBy(*keys).agg(F.format_string('{"count": %d, "total": %.2f, "average": %.2f}', c, fixed(t.cast("double")), fixed(average)).alias("state"))

    def empty(self, as_of):
        return F.coalesce(F.sum("count"), F.lit(0)) == 0

    def upgrade(self, cells):
        return cells.withColumn("version", F.lit(self.version))  # all versions have one shape


@dataclass
class Pyramid(Handler):
    """Counts and sums of the last buckets of several widths."""

    intervals: dict[str, tuple[int, int]] = field(default_factory=lambda: INTERVALS)
    kinds = ("sum",)

    def cells(self):
        return [cell("sum", label, F.col("value").isNotNull(), at=_bucket(w), count=F.lit(1), total=F.col("value")) for label, (w, _) in self.intervals.items()]

    def _live(self, as_of: int, label: str) -> Column:
        w, n = self.intervals[label]
        lo, hi = bounds(as_of, w, n)
        return (F.col("part") == label) & (F.col("at") >= lo // SECOND) & (F.col("at") < hi // SECOND)

    def _sums(self, cells, as_of, keys):
        made = [f(F.when(self._live(as_of, x), F.col(c))).alias(f"{c}_{x}") for x in self.intervals for c, f in (("count", F.sum), ("total", F.sum))]
        return cells.groupBy(*keys).agg(*made).na.fill(0)

    def render(self, cells, as_of, keys):
        parts, args = [], []
        for x in self.intervals:
            c, t = F.col(f"count_{x}"), F.col(f"total_{x}")
            parts.append(f'"{x}": {{"count": %d, "total": %.2f, "average": %.2f}}')
            args += [c, fixed(t), fixed(F.coalesce(t / F.nullif(c, F.lit(0)), F.lit(0.0)))]
        return self._sums(cells, as_of, keys).select(*keys, F.format_string("{" + ", ".join(parts) + "}", *args).alias("state"))

    def detail(self, cells: DataFrame, as_of: int, keys: list[str]) -> DataFrame:
        """keys, part, at, count, total of every bucket of every interval, empty ones too."""
        at = [F.transform(F.sequence(F.lit(bounds(as_of, w, n)[0] // SECOND), F.lit(bounds(as_of, w, n)[1] // SECOND - w), F.lit(w)), lambda a, x=x: F.struct(F.lit(x).alias("part"), a.cast("long").alias("at"))) for x, (w, n) in self.intervals.items()]
        every = cells.select(*keys).distinct().withColumn("x", F.explode(F.concat(*at))).select(*keys, "x.*")
        sums = cells.groupBy(*keys, "part", "at").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
        return every.join(sums, [*keys, "part", "at"], "left").na.fill(0, ["count", "total"])

    def empty(self, as_of):
        live = F.lit(False)
        for x in self.intervals:
            live = live | self._live(as_of, x)
        return F.coalesce(F.sum(F.when(live, F.col("count"))), F.lit(0)) == 0


def _percentiles(samples: Column) -> Column:
    """The values at per_mille * n // 1000 of the sorted samples; zeros without any. samples: an array within its room."""
    ordered = F.sort_array(samples)
    return F.transform(F.array(*map(F.lit, PER_MILLE)), lambda p: F.coalesce(F.get(ordered, F.floor(p * F.size(ordered) / 1000).cast("int")), F.lit(0.0)))


def _pct_json(count: Column, total: Column, pct: Column) -> Column:
    return F.concat(F.format_string('{"count": %d, "total": %f, "pct": [', count, fixed(total, 6)), F.array_join(F.transform(pct, lambda v: F.format_string("%.2f", fixed(v))), ", "), F.lit("]}"))


@dataclass
class Percentile(Handler):
    """All-time count, sum and percentiles of a sample."""

    samples: int = SAMPLES
    kinds = ("sum", "sample")

    def room(self):
        return self.samples

    def cells(self):
        some = F.col("value").isNotNull()
        return [cell("sum", "all", some, count=F.lit(1), total=F.col("value")), cell("sample", "all", some, score=score(), value=F.col("value"), room=F.lit(self.samples))]

    def render(self, cells, as_of, keys):
        held = F.collect_list(F.when(F.col("kind") == "sample", F.col("value").cast("double")))  # at most the room
        sums = cells.groupBy(*keys).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("c"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("t"), held.alias("held"))
        return sums.select(*keys, _pct_json(F.col("c"), F.col("t"), _percentiles(F.col("held"))).alias("state"))


@dataclass
class MovingPercentile(Handler):
    """Count, sum and percentiles over the last buckets of several widths; each bucket has a sample of its own."""

    intervals: dict[str, tuple[int, int]] = field(default_factory=lambda: MOVING)
    samples: dict[str, int] = field(default_factory=lambda: MOVING_SAMPLES)
    kinds = ("sum", "sample")

    def cells(self):
        samples = [cell("sample", x, F.col("value").isNotNull(), at=_bucket(w), score=score(), value=F.col("value"), room=F.lit(self.samples.get(x, 128))) for x, (w, _) in self.intervals.items()]
        return Pyramid(self.intervals).cells() + samples

    def room(self):
        return max([self.samples.get(x, 128) for x in self.intervals], default=0)

    def shown(self, as_of, prefix=""):
        p = Pyramid({f"{prefix}{x}": s for x, s in self.intervals.items()})
        return reduce(lambda a, x: a | p._live(as_of, x), p.intervals, F.lit(False))

    def render(self, cells, as_of, keys):
        whole = merged(cells.where(self.shown(as_of)).withColumn("at", F.lit(None).cast("long")), *keys, kinds=self.kinds)  # one sample an interval
        held = F.collect_list(F.when(F.col("kind") == "sample", F.col("value").cast("double")))
        each = whole.groupBy(*keys, "part").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("c"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("t"), held.alias("held"))
        each = each.select(*keys, "part", _pct_json(F.col("c"), F.col("t"), _percentiles(F.col("held"))).alias("j"))
        none = _pct_json(F.lit(0), F.lit(0.0), _percentiles(F.array().cast("array<double>")))
        of = {x: F.coalesce(F.max(F.when(F.col("part") == x, F.col("j"))), none) for x in self.intervals}
        json = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{x}": '), v) for x, v in of.items()]), F.lit("}"))
        every = cells.select(*keys).distinct()
        return every.join(each, keys, "left").groupBy(*keys).agg(json.alias("state"))

    def empty(self, as_of):
        return Pyramid(self.intervals).empty(as_of)


class ExpiryGauge(Handler):
    """Each client's latest value until it expires: value -> clients."""

    kinds = ("last",)

    def _expiry(self) -> Column:
        return F.col("expiry")

    def cells(self):
        return [cell("last", "all", owner=F.col("client"), value=F.col("text"), us=F.col("us"), expiry=self._expiry(), score=score())]

    def render(self, cells, as_of, keys):
        live = cells.where(F.col("expiry") > as_of).groupBy(*keys, "value").agg(F.count("*").alias("n"))
        pairs = F.sort_array(F.collect_list(F.format_string('"%s": %d', "value", "n")))  # as the result is to hold
        made = live.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("state"))
        return cells.select(*keys).distinct().join(made, keys, "left").na.fill("{}", ["state"])

    def empty(self, as_of):
        return F.coalesce(F.max("expiry"), F.lit(0)) <= as_of


class Gauge(ExpiryGauge):
    """ExpiryGauge of 48 hours."""

    def _expiry(self):
        return F.col("us") + GAUGE_HOURS * 3600 * SECOND


@dataclass
class Buffer(Handler):
    """The unexpired values of the latest expiries."""

    rows: int = BUFFER_ROWS
    kinds = ("top",)

    def room(self):
        return self.rows

    def cells(self):
        return [cell("top", "all", F.col("expiry").isNotNull(), value=F.col("text"), us=F.col("us"), expiry=F.col("expiry"), score=F.lpad(F.col("event_id").cast("string"), 20, "0"), room=F.lit(self.rows))]

    def render(self, cells, as_of, keys):
        row = F.struct((-F.col("expiry")).alias("e"), "score", F.format_string('["%s", %d]', "value", F.expr(f"us div {SECOND}")).alias("j"))
        held = F.sort_array(F.collect_list(F.when(F.col("expiry") > as_of, row)))  # at most the room
        return cells.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(held, lambda x: x["j"]), ", "), F.lit("]")).alias("state"))

    def empty(self, as_of):
        return F.coalesce(F.max("expiry"), F.lit(0)) <= as_of


class Noop(Handler):
    """Keeps nothing of its events."""

    kinds = ("sum",)

    def cells(self):
        return [cell("sum", "none", count=F.lit(0), total=F.lit(0.0))]

    def render(self, cells, as_of, keys):
        return cells.groupBy(*keys).agg(F.lit("noop").alias("state"))

    def upgrade(self, cells):
        return cells.withColumn("version", F.lit(self.version))


@dataclass
class Group(Handler):
    """Several handlers over the same events: label -> member. deciding: the labels whose emptiness makes the group's (default: all)."""

    members: dict[str, Handler]
    deciding: tuple[str, ...] = ()
    flat: str | None = None  # the member whose JSON object is joined into the group's

    @property
    def kinds(self):
        return tuple(dict.fromkeys(k for h in self.members.values() for k in h.kinds))

    def cells(self):
        return [c.withField("part", F.concat(F.lit(label), c["part"])) for label, c in self.labelled()]

    def labelled(self):
        return [(f"{label}/{more}", c) for label, h in self.members.items() for more, c in h.labelled()]

    def room(self):
        rooms = [h.room() for h in self.members.values()]
        return None if None in rooms else max(rooms, default=0)

    def shown(self, as_of, prefix=""):
        out = F.lit(True)
        for label, h in self.members.items():
            out = out & (~F.col("part").startswith(f"{prefix}{label}/") | h.shown(as_of, f"{prefix}{label}/"))
        return out

    def _of(self, cells, label):
        return cells.where(F.col("part").startswith(f"{label}/")).withColumn("part", F.expr(f"substr(part, {len(label) + 2})"))

    def render(self, cells, as_of, keys):
        out, parts = cells.select(*keys).distinct(), []
        for i, (label, h) in enumerate(self.members.items()):
            one = h.render(self._of(cells, label), as_of, keys).withColumnRenamed("state", f"s{i}")
            out = out.join(one, keys, "left")
            parts.append(F.expr(f"substr(s{i}, 2, length(s{i}) - 2)") if label == self.flat else F.concat(F.lit(f'"{label}": '), F.col(f"s{i}")))
        return out.select(*keys, F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("state"))

    def empty(self, as_of):
        out = F.lit(True)
        for label in self.deciding or self.members:
            own = Prefixed(self.members[label], label)
            out = out & own.empty(as_of)
        return out


class Prefixed:
    """A member's emptiness over the group's cells."""

    def __init__(self, handler: Handler, label: str):
        self.handler, self.label = handler, label

    def empty(self, as_of):
        if isinstance(self.handler, (Pyramid, MovingPercentile)):
            renamed = Pyramid({f"{self.label}/{x}": s for x, s in self.handler.intervals.items()})
            return renamed.empty(as_of)
        own = F.col("part").startswith(f"{self.label}/")
        if isinstance(self.handler, (ExpiryGauge, Buffer)):
            return F.coalesce(F.max(F.when(own, F.col("expiry"))), F.lit(0)) <= as_of
        if isinstance(self.handler, Totals):
            return F.coalesce(F.sum(F.when(own, F.col("count"))), F.lit(0)) == 0
        return self.handler.empty(as_of)


class Registry:
    """Type -> handler. Registered types replace defaults; an unknown type has no handler."""

    def __init__(self, more: dict[str, Handler] | None = None):
        self.handlers: dict[str, Handler] = {
            "TotalsCounter": Totals(),
            "CounterGroup": Group({"intervals": Pyramid(), "pct": Percentile(GROUP_SAMPLES)}, ("intervals",), "intervals"),
            "PercentileCounter": Percentile(),
            "PercentileGroup": MovingPercentile(),
            "Gauge": Gauge(),
            "ExpiryGauge": ExpiryGauge(),
            "Buffer": Buffer(),
        }
        for tab_type, handler in (more or {}).items():
            self.register(tab_type, handler)

    def register(self, tab_type: str, handler: Handler) -> None:
        if not isinstance(handler, Handler):
            raise TypeError(f"{tab_type}: not a handler")
        self.handlers[tab_type] = handler

    def __getitem__(self, tab_type: str) -> Handler:
        return self.handlers[tab_type]

    def only(self, types: list[str]) -> Registry:
        """The handlers of some types."""
        out = Registry()
        out.handlers = {t: h for t, h in self.handlers.items() if t in types}
        return out

    def kinds(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(k for h in self.handlers.values() for k in h.kinds))

    def known(self) -> Column:
        return F.col("tab_type").isin(*self.handlers)

    def room(self) -> int | None:
        """The largest room of a cell of the handlers, None where one doesn't tell."""
        rooms = [h.room() for h in self.handlers.values()]
        return None if None in rooms else max(rooms, default=0)

    def exploded(self, events: DataFrame) -> DataFrame:
        """Cells of the events of known types, not merged."""
        if not self.handlers:
            return events.sparkSession.createDataFrame([], CELL)
        events.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)  # larger methods, as many cells make, are never compiled by the JVM
        of_type = F.lit(None)
        for tab_type, h in self.handlers.items():
            # not by withField: it would make the whole cell again for each of its fields
            made = F.array(*[F.struct(F.lit(h.version).alias("version"), F.lit(label).alias("label"), c.alias("cell")) for label, c in h.labelled()])
            of_type = F.when(F.col("tab_type") == tab_type, made).otherwise(of_type)
        x = events.withColumn("_x", F.explode(of_type)).where("_x.cell is not null")
        own = {c: F.col(c) for c in ("name", "client", "tab_type")} | {"version": F.col("_x.version"), "part": F.concat("_x.label", "_x.cell.part")}
        return x.select(*[own.get(c, F.col(f"_x.cell.{c}")).alias(c) for c in COLUMNS])

    def fold(self, events: DataFrame, keys: tuple[str, ...] = ("name", "client"), as_of: int | None = None) -> DataFrame:
        """Cells at the given keys of all events of known types; as_of: those that a rendering as of this time shows."""
        cells = self.exploded(events)
        if as_of is not None:
            shown = reduce(lambda a, h: a & ((F.col("tab_type") != h[0]) | h[1].shown(as_of)), self.handlers.items(), F.lit(True))
            cells = cells.where((F.col("kind") != "sample") | shown)
        return merged(cells, *keys, kinds=self.kinds() or ("sum",), room=self.room())


#: Up to this many rows a group Spark limits each partition before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
LIMITED = 1000
#: Larger groups are first cut to their room in so many parts.
PARTS = 64


def merged(cells: DataFrame, *keys: str, kinds: tuple[str, ...] = Handler.kinds, room: int | None = None) -> DataFrame:
    """Cells (of some kinds) at the given keys (of name and client; tab_type always): equal cells are added, samples and tops cut to their room.

    Partial aggregation, or a limit on each partition, goes before each shuffle, so a key of many cells isn't gathered. That limit has to be
    a number, not a column: `room` if no cell has more; without it cells of more than LIMITED go a way of their own, by parts of their group.
    """
    place = list(dict.fromkeys([*keys, "tab_type", "version", "part", "at"]))

    def have(df: DataFrame, kind: str) -> DataFrame:  # a literal kind, so that who asks for another doesn't compute these
        known = {c: F.col(c) for c in df.columns} | {"kind": F.lit(kind)}
        return df.select(*[known.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in COLUMNS])

    def within_room(kind: str, *order: Column) -> list[DataFrame]:
        group = [*place, "room"]
        x = cells.where(F.col("kind") == kind).select(*group, "score", "value", "us", "expiry")
        cut = lambda df, most, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*group, *by).orderBy(*order))).where(most).drop("_r")
        fits = F.col("_r") <= F.col("room")
        small = room is not None and room <= LIMITED
        few = x if small else x.where(F.col("room") <= LIMITED)
        out = [cut(few, fits & (F.col("_r") <= F.lit(max(1, room) if small else LIMITED)))]
        if not small:
            many = x.where(F.col("room") > LIMITED).withColumn("_p", F.pmod(F.xxhash64("score", "us", "value"), F.lit(PARTS)))
            out.append(cut(cut(many, fits, "_p").drop("_p"), fits))
        return [have(df, kind) for df in out]

    out = []
    if "sum" in kinds:
        sums = cells.where("kind = 'sum'").groupBy(*place).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
        out.append(have(sums, "sum"))
    if "sample" in kinds:
        out += within_room("sample", F.col("score"))
    if "last" in kinds:
        late = F.max_by(F.struct("value", "us", "expiry", "score"), F.struct("expiry", "us", "score"))
        out.append(have(cells.where("kind = 'last'").groupBy(*place, "owner").agg(late.alias("x")).select(*place, "owner", "x.*"), "last"))
    if "top" in kinds:
        out += within_room("top", F.desc("expiry"), F.col("score"))
    return reduce(DataFrame.unionByName, out)


def rendered(cells: DataFrame, registry: Registry, as_of: int, *keys: str) -> DataFrame:
    """keys, tab_type, state (JSON) of merged cells."""
    made = [h.render(cells.where(F.col("tab_type") == t), as_of, [*keys, "tab_type"]).select(*keys, "tab_type", "state") for t, h in registry.handlers.items()]
    if not made:
        return cells.where("false").select(*keys, "tab_type", F.col("value").alias("state"))
    return reduce(DataFrame.unionByName, made)
