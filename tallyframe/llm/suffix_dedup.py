"""Exact dedup of byte strings, by two-stage suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import cut_repeats

SHARD_BYTES = 1 << 20
#: A byte that no UTF-8 text holds.
END = 255


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; runs of one symbol follow what comes after the run."""
    differs = np.append(t[1:] != t[:-1], True)
    last = np.flatnonzero(differs)
    of_run = np.append(t[:-1] < t[1:], False)[last]
    return np.repeat(of_run, np.diff(last, prepend=-1))


def _direct(t: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Some suffixes in order of their first `depth` bytes: by the first two, then those that share them, a group at a time."""
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    strings = np.ndarray((len(t),), f"S{depth}", padded.data, strides=(1,))
    two = padded[which].astype(np.uint16) << 8 | padded[which + 1]
    order = np.argsort(two, kind="stable")
    which, two = which[order], two[order]
    cuts = np.flatnonzero(np.diff(two.astype(np.int32), prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(which))):
        if b - a > 1:
            part = which[a:b]
            which[a:b] = part[np.argsort(strings[part], kind="stable")]
    return which


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t (bytes) in order of at least their first `depth` symbols, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. A scan over the buckets of first symbols induces the others: a
    suffix larger than its successor stands, among those of its symbol, in the order of the successors, before the sorted ones. The
    scan goes bucket by bucket, each handing its predecessors on to the larger ones; within a bucket, runs of its symbol go step by step.
    """
    small = _smaller_than_next(t)
    direct = _direct(t, np.flatnonzero(small), depth)
    symbol = t[direct]
    starts = np.searchsorted(symbol, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    if len(t) and not small[-1]:
        waiting[int(t[-1])].append(np.array([len(t) - 1]))  # its successor is the empty suffix

    def before(suffixes: np.ndarray) -> np.ndarray:
        p = suffixes[suffixes > 0] - 1
        return p[~small[p]]

    for c in range(256):
        induced = waiting[c]
        wave = np.concatenate(induced) if induced else np.empty(0, np.int64)
        parts = [wave]
        while len(wave):
            p = before(wave)
            wave = p[t[p] == c]
            parts.append(wave)
        parts.append(direct[starts[c] : starts[c + 1]])
        whole = np.concatenate(parts)
        waiting[c] = []
        out.append(whole)
        p = before(whole)
        p = p[t[p] > c]
        if len(p):
            order = np.argsort(t[p], kind="stable")
            p = p[order]
            cut = np.flatnonzero(np.diff(t[p], prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(p))):
                waiting[int(t[p[a]])].append(p[a:b])
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order, up to `most`; eight bytes at a time."""
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)])
    block = np.ndarray((len(t) + most,), "<u8", padded.data, strides=(1,))
    length, rows = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(0, most, 8):
        x = block[order[rows] + k] ^ block[order[rows - 1] + k]
        length[rows] = k + np.where(x == 0, 8, (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64))
        rows = rows[x == 0]
    length[1:] = np.minimum(length[1:], len(t) - np.maximum(order[1:], order[:-1]))
    return np.minimum(length, most)


def _may_repeat(content: bytes, size: int) -> bool:
    """Whether a window may stand twice in a content: then what all its n <= size windows share would stand again, after the first n bytes."""
    n = len(content) - size + 1
    return n > size or n > 1 and content.find(content[n - 1 : size], n) >= 0


def earliest_places(contents: list, size: int):
    """Kernel of repeats: sorts the suffixes of shards of some SHARD_BYTES bytes (an anchor is never divided); windows with the same first
    `size` bytes stand together, and the smallest place among them is the earliest.

    A content that is the only one of its anchor and repeats no window has nothing to be sorted with: its windows' places are its own.
    """
    shard, held = [], 0
    for i, x in enumerate(contents):
        starts = not i or x[0] != contents[i - 1][0]
        if held > SHARD_BYTES and starts:
            yield from _of_shard(shard, size)
            shard, held = [], 0
        alone = starts and (i + 1 == len(contents) or contents[i + 1][0] != x[0]) and not _may_repeat(x[1], size)
        shard.append((x[1], x[2], alone))
        held += 0 if alone else len(x[1])
    if shard:
        yield from _of_shard(shard, size)


def _of_shard(shard: list, size: int):
    met = [x for x in shard if not x[2]]
    end = bytes([END])
    data = np.frombuffer(end.join([x[0] for x in met] + [b""]), np.uint8)
    ends = np.cumsum([len(x[0]) + 1 for x in met], dtype=np.int64) - 1
    starts = np.append(0, ends + 1)[: len(met)]
    of_window = np.zeros(len(data), np.int64)
    if len(met):
        order = suffix_array(data, size)
        owner = np.repeat(np.arange(len(met)), ends - starts + 1)
        order = order[order + size <= ends[owner[order]]]  # windows; what crosses an end holds its byte and equals no window
        group = np.cumsum(common_prefixes(data, order, size) < size) - 1
        place = np.array([x[1] for x in met])[owner[order]] + order - starts[owner[order]]
        if len(order):
            of_window[order] = np.minimum.reduceat(place, np.flatnonzero(np.diff(group, prepend=-1)))[group]
    spans = zip(starts.tolist(), ends.tolist())
    for content, first, alone in shard:
        if alone:
            yield first + np.arange(len(content) - size + 1)
        else:
            a, b = next(spans)
            yield of_window[a : b - size + 1]


def dedup_bytes(docs: DataFrame, size: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of each document.

    Removes bytes covered by a string of `size` bytes that starts earlier: in a smaller doc_id or earlier in the same document;
    see repeats. Null or empty text: no bytes. Null doc_id: the largest. Rows with equal doc_id and text share their
    places and come out alike; rows with equal doc_id and other texts are ordered by a hash of the text. An empty table gives no
    rows. Clashing or extra columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def row(values, text, spans):
        data = text.encode()
        parts, at = [], 0
        for a, b in spans.tolist():
            parts.append(data[at:a])
            at = b
        kept = b"".join([*parts, data[at:]])
        return values[0], len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept

    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return cut_repeats(source, ["doc_id"], "bytes", size, 32, True, earliest_places, row, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
