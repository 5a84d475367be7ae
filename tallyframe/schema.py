"""Interval specifications, percentile fractions and table shapes."""

#: Label -> (bucket width in seconds, buckets).
INTERVALS = {"1m": (1, 60), "10m": (10, 60), "1h": (30, 120), "1d": (900, 96)}
MOVING = {"1m": (15, 4), "10m": (150, 4), "1h": (900, 4), "1d": (21600, 4)}
COARSE = {"30d": (86400, 30)}
PER_MILLE = (250, 500, 750, 900, 950, 990, 999)
GAUGE_HOURS = 48
BUFFER_ROWS = 1000
#: Samples of an all-time percentile counter, alone and within a counter group, and of a moving one by label.
SAMPLES, GROUP_SAMPLES = 512, 200
MOVING_SAMPLES = {"1m": 64, "10m": 128, "1h": 128, "1d": 128}
BUNDLE_EVENTS = 50_000

EVENT = "client string, name string, tab_type string, ts timestamp, payload string"
#: One cell of a state. kind says how cells merge: sum, sample (lowest scores), last (latest expiry of an owner), top (latest expiries).
CELL = "name string, client string, tab_type string, version int, kind string, part string, at long, owner string, count long, total double, score string, value string, us long, expiry long, room int"
