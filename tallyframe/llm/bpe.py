"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, ids_texts

NONE = 1 << 24


class ByteBPE:
    """Encoder over a rank file: one line `base64(token) rank` for each token.

    A match of the pattern is merged with a segment tree over its byte positions. The leaf of a position holds rank and
    position of the pair that starts there as one number (as many low bits as the match's length needs), an inner node the
    minimum of its two children, so the root is the leftmost pair of the lowest rank. A merge changes the pair at the
    position and the pair at its left neighbour and takes out the right one: three point updates of log(n) steps.
    Matches of up to 64 bytes are merged many at a time, each in a tree of its own, and kept with their ids and decoded bytes: at most two stores of cache_size and one text's
    matches each, the older of which goes when the newer is full.
    """

    def __init__(self, rank_path: str, pattern: str, cache_size: int = 1 << 17):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache_size, self.kept, self.older = cache_size, {}, {}
        self.texts = {i: str(i) for i in self.tokens}
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        parts = [(self.ranks[t[:c]] << 32 | self.ranks[t[c:]], r) for t, r in self.ranks.items() for c in range(1, len(t)) if t[:c] in self.ranks and t[c:] in self.ranks]
        self.pairs, self.merged = (np.array(x, np.int64) for x in zip(*sorted(parts))) if parts else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbouring tokens make, or NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """merge() of many matches of 2 to width bytes (a power of two), each with a segment tree of its own, a step of all at a time."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.arange(width)
        live = place < n[:, None]
        token = np.zeros((len(pieces), width + 1), np.int64)
        token[:, :width][live] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(np.arange(1, width + 2), (len(pieces), 1)), np.tile(np.arange(-1, width), (len(pieces), 1))
        tree = np.full((len(pieces), 2 * width), NONE * width)
        rows, at = np.nonzero(place < n[:, None] - 1)
        tree[rows, width + at] = self.pair_ranks(token[rows, at], token[rows, at + 1]) * width + at
        tree[:, width:][tree[:, width:] >= NONE * width] = NONE * width
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        rows = np.arange(len(pieces))
        while True:
            rows = rows[tree[rows, 1] < NONE * width]
            if not len(rows):
                break
            rank, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            k = after[rows, j]
            left = before[rows, i]
            token[rows, i], after[rows, i], before[rows, np.minimum(k, width)], live[rows, j] = rank, k, i, False
            right = np.where(k < n[rows], self.pair_ranks(rank, token[rows, np.minimum(k, width)]), NONE)
            own = np.where(left >= 0, self.pair_ranks(token[rows, np.maximum(left, 0)], rank), NONE)
            tree[rows, width + j] = NONE * width
            tree[rows, width + i] = np.where(right < NONE, right * width + i, NONE * width)
            has = left >= 0
            tree[rows[has], width + left[has]] = np.where(own < NONE, own * width + left, NONE * width)[has]
            for p in (j, i, np.where(has, left, i)):
                p = (p + width) >> 1
                while p[0]:
                    tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])
                    p >>= 1
        return np.split(token[:, :width][live], np.cumsum(live.sum(axis=1))[:-1])

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, get = len(piece), ranks.get
        if not n:
            return []
        shift = n.bit_length()
        mask, none, size = (1 << shift) - 1, 1 << (shift + 40), n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        end = list(range(1, n + 1))  # of the token that starts at a position
        before = list(range(-1, n - 1))  # start of the token to the left

        while tree[1] != none:
            i = tree[1] & mask
            j = end[i]
            k = end[i] = end[j]
            left, a, b = before[i], none, none
            if k < n:
                before[k] = i
                r = get(piece[i : end[k]])
                if r is not None:
                    a = r << shift | i
            if left >= 0:
                r = get(piece[left:k])
                if r is not None:
                    b = r << shift | left
            for p, value in ((j, none), (i, a), (left, b)) if left >= 0 else ((j, none), (i, a)):
                p += size
                while tree[p] != value:
                    tree[p] = value
                    if p == 1:
                        break
                    if tree[p ^ 1] < value:
                        value = tree[p ^ 1]
                    p >>= 1
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def entry(self, ids: list[int]) -> tuple[str, bytes, bytes]:
        return " ".join([self.texts[i] for i in ids]), struct.pack(f"<{len(ids)}i", *ids), b"".join([self.tokens[i] for i in ids])

    def learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes, bytes]]:
        """Decimal ids, ids as little-endian int32 and their decoded bytes of each match; a dict with all of them."""
        if len(self.kept) > self.cache_size:
            self.kept, self.older = {}, self.kept
        kept, long, fresh = self.kept, None, {}
        for piece in pieces.difference(kept):
            entry = self.older.get(piece)
            if entry is not None:
                kept[piece] = entry
                continue
            data = piece.encode()
            if data in self.ranks or len(data) > 64:
                entry = self.entry(self.merge(data))
                if len(data) > 64:
                    long = long or {}
                    long[piece] = entry
                else:
                    kept[piece] = entry
            else:
                fresh.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, group in fresh.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                for (piece, _), ids in zip(part, self.merge_many([d for _, d in part], width)):
                    kept[piece] = self.entry(ids.tolist())
        return kept if long is None else {**{p: kept[p] for p in pieces.difference(long)}, **long}

    def run(self, texts: list[str]):
        """Of each text: decimal ids joined by one space, ids as little-endian int32, and the bytes that these ids decode to."""
        found = [self.pattern.findall(text) for text in texts]
        known = self.learn(set().union(*found))
        for pieces in found:
            ids, raw, decoded = zip(*map(known.__getitem__, pieces)) if pieces else ((), (), ())
            yield " ".join(ids), b"".join(raw), b"".join(decoded)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.run([text]))[1], "<i4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(4)
def encoder(rank_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; only if keep_ids), ids_sha256, decoded_sha256 of every whole text.

    A null or empty text has no ids: both digests are those of nothing. Repeated rows each give a row, doc_id may
    be null, other columns are not read, an empty table gives no rows. No shuffle; a worker holds half a MB of texts or one text.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[("ids", pa.list_(pa.int32()))] * keep_ids, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = pa.schema(fields)

    def run(frames):
        bpe = encoder(rank_path, pattern)
        for doc_ids, texts in ids_texts(frames):
            n, raws, ids_sha, decoded_sha = [], [], [], []
            for ids, raw, decoded in bpe.run(texts):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    raws.append(raw)
            lists = []
            if keep_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raws), "<i4"), pa.int32()))]
            yield arrow_batch(out, doc_ids, n, *lists, ids_sha, decoded_sha)

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
