"""The line protocol of event bodies: version, blank, then a client, blank, {name, event lines, blank} and a blank at the end."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BUNDLE_EVENTS, EVENT

VERSION = "1"


def lines_of(body):
    """Lines of a body: a string, or an iterable of pieces that may end anywhere."""
    if isinstance(body, str):
        yield from body.split("\n")
        return
    rest = ""
    for piece in body:
        *whole, rest = (rest + piece).split("\n")
        yield from whole
    yield rest


def inflated(pieces):
    """Text pieces of a zlib stream given in pieces; characters cut in two by a piece's end are put together."""
    import codecs

    stream, text = zlib.decompressobj(), codecs.getincrementaldecoder("utf-8")()
    for piece in pieces:
        yield text.decode(stream.decompress(piece))
    yield text.decode(stream.flush(), final=True)
    if not stream.eof:
        raise ValueError("the compressed body ends early")


def decode_lines(body):
    """(client, name, event line) of each event; a last bundle without its blank line still counts. Missing separators raise."""
    lines = iter(lines_of(body))
    if (found := next(lines, "")) != VERSION:
        raise ValueError(f"unknown protocol version {found!r}")
    if next(lines, ""):
        raise ValueError("no blank line after the version")
    client = name = None
    for line in lines:
        if client is None:
            if not line:
                continue  # the end of the body
            client = line
            if next(lines, ""):
                raise ValueError(f"no blank line after client {client!r}")
        elif name is None:
            name, client = (line, client) if line else (None, None)
        elif line:
            yield client, name, line
        else:
            name = None


def decode_body(body):
    """(client, name, tab_type, seconds, payload JSON) of each event."""
    for client, name, line in decode_lines(body):
        kind, seconds, payload = json.loads(line)
        yield client, name, kind, float(seconds), payload


def decode_bundles(body, most: int = BUNDLE_EVENTS):
    """(client, name, tab_type, [(seconds, payload JSON)]) in order of the body, at most `most` events each; the first event's type counts."""
    key, kind, events = None, None, []
    for client, name, own, seconds, payload in decode_body(body):
        if events and (key != (client, name) or len(events) == most):
            yield *key, kind, events
            kind, events = (None if key != (client, name) else kind), []
        key, kind = (client, name), kind or own
        events.append((seconds, payload))
    if events:
        yield *key, kind, events


def encode_body(rows) -> str:
    """The body of (client, name, tab_type, seconds, payload JSON) rows."""
    clients: dict = {}
    for client, name, kind, seconds, payload in rows:
        clients.setdefault(client, {}).setdefault(name, []).append(json.dumps([kind, seconds, payload]))
    out = [VERSION, ""]
    for client, names in clients.items():
        out += [client, ""]
        for name, events in names.items():
            out += [name, *events, ""]
        out.append("")
    return "\n".join(out)


def _of_body(body) -> pd.DataFrame:
    x = pd.DataFrame(list(decode_body(body)), columns=["client", "name", "tab_type", "ts", "payload"])
    x["ts"] = pd.to_datetime(x["ts"].astype("float64"), unit="s", utc=True)  # an instant, in any session's zone
    return x


def read_bodies(spark: SparkSession, path: str, compressed: bool = False, bad: str = "raise") -> DataFrame:
    """Events of all body files under a path; one file is one request, plain or zlib. bad: raise, or drop what can't be read."""
    source = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                try:
                    out = _of_body(inflated([content]) if compressed else content.decode())
                except (ValueError, zlib.error):
                    if bad == "raise":
                        raise
                else:
                    yield out

    return source.mapInPandas(run, EVENT)


def checked_bodies(bodies: DataFrame) -> DataFrame:
    """bodies (body string) with `problem`: why it can't be decoded, or null. Empty bodies are a problem too."""

    @F.pandas_udf("string")
    def problem(body: pd.Series) -> pd.Series:
        def of(text):
            try:
                return None if text and sum(1 for _ in decode_body(text)) else "no events"
            except (ValueError, TypeError) as e:
                return str(e)

        return body.map(of)

    return bodies.withColumn("problem", problem("body"))


def encode_clients(events: DataFrame, most: int = BUNDLE_EVENTS) -> DataFrame:
    """client, part, body: an EVENT table's rows in order of name and time as requests, each of at most `most` events of each name.

    Events are numbered within (client, name), so a client of many events is spread over parts, and a task gathers one part of it.
    """
    place = F.row_number().over(Window.partitionBy("client", "name").orderBy("ts", "payload")) - 1
    x = events.withColumn("_place", place).withColumn("part", F.expr(f"_place div {most}"))
    x = x.withColumn("_seconds", F.unix_micros("ts") / 1_000_000).select("client", "part", "name", "tab_type", "_seconds", "payload")

    def run(key, pdf):
        pdf = pdf.sort_values(["name", "_seconds"], kind="stable")
        rows = zip(pdf["client"], pdf["name"], pdf["tab_type"], pdf["_seconds"], pdf["payload"])
        return pd.DataFrame({"client": [key[0]], "part": [key[1]], "body": [encode_body(rows)]})

    return x.groupBy("client", "part").applyInPandas(run, "client string, part long, body string")
