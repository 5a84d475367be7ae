"""Scalar rules: payload values, shards, admission, load weights, checksums, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Queue lengths at which admission starts to fail and fails for all, shards, roles, decay of load weights.
ADMIT_ALL, ADMIT_NONE, AGENT_SHARDS, ROLES, KEPT_SHARE = 50_000, 2_000_000, 750, ("FRONTEND", "BACKEND"), 0.75


def payload_value(payload) -> Column:
    """A JSON payload as a number: the scalar itself or the first element of a list; null for anything else."""
    p = F.try_parse_json(payload)
    return F.coalesce(F.try_variant_get(p, "$[0]", "double"), F.try_variant_get(p, "$", "double"))


def payload_text(payload) -> Column:
    """A JSON payload's string or scalar, or the first element of a list, as text."""
    p = F.try_parse_json(payload)
    return F.coalesce(F.try_variant_get(p, "$[0]", "string"), F.try_variant_get(p, "$", "string"))


def admission(queued) -> Column:
    """The chance that an update is turned away: 0 up to a short queue, then linear to 1 at a full one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(queued) - ADMIT_ALL) / F.lit(ADMIT_NONE - ADMIT_ALL)))


def turned_away(queued, event_id) -> Column:
    """Whether an update is turned away, by a hash of its id, so that reruns agree."""
    return F.pmod(F.crc32(F.col(event_id).cast("string")), F.lit(1000)) / 1000 < admission(queued)


def skip_chance(servers) -> Column:
    """The chance with which each of some servers sits a recomputation out so that one takes part with a chance of 0.999."""
    return F.pow(F.lit(0.001), F.lit(1.0) / F.col(servers))


def agent_shard(client, name, shards: int = AGENT_SHARDS) -> Column:
    """md5 of client and name modulo the shards, 32 bits at a time, as the number is too large for a long."""
    digest, out = F.md5(F.concat(F.col(client), F.col(name))), F.lit(0).cast("long")
    for i in range(0, 32, 8):
        part = F.conv(F.substring(digest, i + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit((1 << 32) % shards) + part, F.lit(shards))
    return out


def vbucket(key, buckets: int = 64) -> Column:
    return F.pmod(F.crc32(key), F.lit(buckets))


def storage_shard(key, ends: list[int]) -> Column:
    """The shard that holds a key's bucket; ends: one past the last bucket of each shard, ascending."""
    b, out = vbucket(key, ends[-1]), F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        out = F.when(b < ends[i], i).otherwise(out)
    return out


def adler32(text) -> Column:
    """The zlib checksum of a text's bytes, by two sums."""
    hexed = F.hex(F.encode(F.col(text), "utf-8"))
    n = (F.length(hexed) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    byte = F.transform(at, lambda i: F.conv(F.substr(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    low = F.aggregate(byte, F.lit(1).cast("long"), lambda a, b: (a + b) % 65521)
    high = F.aggregate(F.transform(byte, lambda b, i: b * (n - i) % 65521), n.cast("long"), lambda a, b: (a + b) % 65521)
    return high % 65521 * 65536 + low


def smoothed(loads) -> Column:
    """An exponentially weighted mean of loads in order: each step keeps a share of what was."""
    return F.aggregate(loads, F.lit(None).cast("double"), lambda old, load: F.coalesce(load + (old - load) * KEPT_SHARE, load))


def roles(text: str) -> list[str]:
    """A comma list of roles; an unknown one raises."""
    out = [x.strip().upper() for x in text.split(",") if x.strip()]
    if bad := [x for x in out if x not in ROLES]:
        raise ValueError(f"unknown role {bad[0]}")
    return out


@dataclass
class Settings:
    """Settings of an engine; a file may hold any of them, and others raise."""

    folder: str = ""
    blacklist: list[str] = field(default_factory=list)
    roles: str = "FRONTEND,BACKEND"
    max_files_per_trigger: int = 1000
    late: str = "1 day"

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            return cls(**json.load(f))


# Rows of events from code: the shape of schema.EVENT, invalid names dropped.
def recorded(client: str, name: str, tab_type: str, value, ts) -> list[tuple]:
    import re

    from .windows import ALLOWED

    ok = not re.search(f"[^{ALLOWED}]", name) and not re.search(f"[^{ALLOWED}]", client)
    return [(client, name, tab_type, ts, json.dumps(value))] if ok else []


def counter(client, name, ts, value=1):
    return recorded(client, name, "CounterGroup", value, ts)


def percentile(client, name, ts, value=1):
    return recorded(client, name, "PercentileGroup", value, ts)


def gauge(client, name, ts, value, expiration=None):
    return recorded(client, name, "Gauge" if expiration is None else "ExpiryGauge", value if expiration is None else [value, expiration], ts)


def buffer(client, name, ts, value, expiration):
    return recorded(client, name, "Buffer", [value, expiration], ts)
