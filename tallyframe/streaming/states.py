"""Streams: tumbling and sliding counts, states kept by key with a lifetime, stored states, mirrored sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..engine import StateStore


def sliding_counts(stream: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """name, start (epoch seconds), count of windows that overlap; a window closes once the watermark passes it."""
    x = stream.withWatermark("ts", late).groupBy("name", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("count"))
    return x.select("name", F.unix_seconds("w.start").alias("start"), "count")


def once(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events sent again within the lateness allowed count once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _latest(pdf: pd.DataFrame) -> int:
    """The place of the latest event, of several the one with the lowest id; a sort of a few rows takes longer than all else of a group."""
    us, ids = pdf["us"].to_numpy(), pdf["event_id"].to_numpy()
    if us.dtype.kind != "i" or ids.dtype.kind != "i":  # nulls
        return int(np.lexsort((ids, -us.astype(float)))[0])
    last = (us == us.max()).nonzero()[0]
    return int(last[ids[last].argmin()])


def latest_values(stream: DataFrame, hours: int = 48, late: str = "1 day") -> DataFrame:
    """name, client, value, us, live: a gauge's value on each change, and live false once it has expired without a newer one.

    State is one value for each (name, client), dropped when the watermark passes its expiry. Events out of order don't replace newer ones.
    """
    schema = "name string, client string, value string, us long, live boolean"
    span = hours * 3_600_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, us = state.get
            state.remove()
            yield pd.DataFrame([(*key, value, us, False)], columns=["name", "client", "value", "us", "live"])
            return
        old = state.get if state.exists else (None, None)
        best = old
        for pdf in frames:
            i = _latest(pdf)
            if best[1] is None or int(pdf["us"].iat[i]) > best[1]:
                best = (str(pdf["value"].iat[i]), int(pdf["us"].iat[i]))
        if best != old:
            state.update(best)
            yield pd.DataFrame({"name": [key[0]], "client": [key[1]], "value": [best[0]], "us": [best[1]], "live": [True]})
        expires = best[1] // 1000 + span
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        else:
            state.remove()

    x = stream.withWatermark("ts", late).select("name", "client", "value", "us", "event_id", "ts")
    return x.groupBy("name", "client").applyInPandasWithState(run, schema, "value string, us long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_states(stream: DataFrame, store: StateStore, checkpoint: str, gc_every: int = 0, **trigger) -> StreamingQuery:
    """Merges each micro-batch of typed events into stored states. A batch that is run again after a failure is known by its number.

    gc_every: a collection after every so many batches, as of the batch's latest event.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if store.last_batch() >= number:
            return
        store.upsert(batch, batch=number)
        if gc_every and number % gc_every == gc_every - 1:
            now = batch.agg(F.max("us")).first()[0]
            if now is not None:
                store.gc(now)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def mirrored(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch to several sinks; one that fails makes the batch run again for all."""

    def write(batch: DataFrame, number: int) -> None:
        for sink in sinks:
            sink(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(query: StreamingQuery) -> list[dict]:
    """batch, rows, rows a second in and out, and state rows of each recent micro-batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "in": p.get("inputRowsPerSecond"), "out": p.get("processedRowsPerSecond"), "state": sum(s["numRowsTotal"] for s in p.get("stateOperators", []))} for p in query.recentProgress]
