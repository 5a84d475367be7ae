"""Repeated windows of a fixed length over texts: what brings equal passages together under substring and suffix dedup.

A window's anchor is the lowest hash of the `gram`-symbol runs in it, so equal windows have equal anchors. Neighbouring windows mostly
share theirs, so a text has one run of windows for some 2 / (size - gram + 2) of its symbols.
  1. Texts are stored once, in blocks (files of a bounded number of rows), and every later step reads a block from the shared folder;
     texts are never shuffled. Each block sends its distinct anchors to buckets by hash, packed; a bucket tells the blocks which
     occur elsewhere too.
  2. Anchors that occur very often meet a second such exchange over the hashes of their single windows, so that the edges of a
     passage that very many documents share, which differ in each, are not sent on.
  3. Each block sends the distinct contents of its shared runs, real symbols with the earliest place of each in the block, to
     the anchor's bucket. There the operator's kernel (suffix automata or suffix sorting) finds by comparing symbols which
     windows start earlier, and answers one bit for each window.
  4. Each block removes what its answers cover.
Hashes only choose where symbols meet. A bucket holds what some MB of text send to it; copies within a block are sent once.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, arrow_batch, combine, gram_hash, joined, mix, shared_dir, slices, stored, word_hashes, words_of

BLOCK_ROWS, BUCKET_BYTES, LONGEST_RUN, OFTEN = 4096, 16 << 20, 4096, 512
#: Text at a time: the arrays of hashes made from it (8 bytes a symbol) should stay in a core's cache.
SLICE_BYTES = 1 << 18
ANSWER = "f long, kind int, payload binary"
ANSWERS = pa.schema([("f", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SENT = "bucket int, f long, payload binary"
SENDS = pa.schema([("bucket", pa.int32()), ("f", pa.int64()), ("payload", pa.binary())])


def packed(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def unpacked(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _pack_hashes(h: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted hashes as differences, bytes of one place together, and their counts."""
    step = np.diff(h, prepend=U64(0))
    return packed((step.view(np.uint8).reshape(-1, 8).T.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes()))


def _unpack_hashes(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, count = unpacked(payload)
    step = np.ascontiguousarray(np.frombuffer(step, np.uint8).reshape(8, -1).T).view(U64).ravel()
    return np.cumsum(step, dtype=U64), np.frombuffer(count, np.uint8)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Runs:
    """The runs of windows of some texts: text number, first and last window (symbols from the text's start) and anchor."""

    def __init__(self, texts: list[bytes], kind: str, size: int, gram: int):
        self.kind, self.size = kind, size
        self.data, self.offset = joined(texts)
        if kind == "bytes":
            padded = np.zeros(len(self.data) + 16, np.uint8)
            padded[: len(self.data)] = self.data
            self.block = np.ndarray((len(self.data) + 1,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
            n = max(0, len(self.data) - 15)
            grams = combine(self.block[:n], self.block[8 : 8 + n])
            grams = combine(grams[:-16], grams[16:]) if gram == 32 else grams if gram == 16 else gram_hash(self.data.astype(U64), gram)
            self.at, self.symbols = self.offset, None
            ends = self.at[1:] - 1
        else:
            self.starts, self.ends = words_of(self.data)
            self.symbols = word_hashes(self.data, self.starts, self.ends)
            grams = gram_hash(self.symbols, gram)
            self.at = np.searchsorted(self.starts, self.offset)
            ends = self.at[1:]
        single, span = grams, 1
        while span < size - gram + 1 and len(grams):
            step = min(span, size - gram + 1 - span)
            grams = np.minimum(grams[:-step], grams[step:])
            span += step
        n = len(grams)
        inside = np.ones(n, bool)
        for a, e in zip(self.at.tolist(), ends.tolist()):
            inside[max(a, e - size + 1) : e + 1 if kind == "bytes" else e] = False
        whole = np.flatnonzero(inside)
        low = grams[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1] + 1)
        first = np.flatnonzero(new)
        new |= (np.arange(len(whole)) - np.repeat(first, np.diff(np.append(first, len(whole))))) % LONGEST_RUN == 0
        first = np.flatnonzero(new)
        lo, hi = whole[first], whole[np.append(first[1:], len(whole)) - 1] if len(whole) else whole
        self.anchor = low[first]
        # Where a window's anchor is its first run of symbols and the next window has it too, it stands there twice; equal windows
        # of one run have such a place between their starts, however short the run is.
        again = np.flatnonzero((single[whole[:-1]] == low[:-1]) & ~new[1:])
        self.twice = np.zeros(len(first), bool)
        self.twice[np.searchsorted(first, again, side="right") - 1] = True
        self.text = np.searchsorted(self.at, lo, side="right") - 1
        self.lo, self.hi = lo - self.at[self.text], hi - self.at[self.text]

    def content(self, text: int, lo: int, hi: int) -> bytes:
        """The symbols of windows lo to hi of a text; words joined by a space."""
        a, b = int(self.at[text]) + lo, int(self.at[text]) + hi + self.size
        if self.kind == "bytes":
            return self.data[a:b].tobytes()
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())

    def windows(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at some symbols of all texts."""
        if self.kind == "bytes":
            values, steps = self.block, [*range(0, self.size - 7, 8), self.size - 8]
        else:
            values, steps = self.symbols, range(self.size)
        h = np.full(len(start), self.size, U64)
        for k in steps:
            h = combine(h, values[start + k])
        return h


class Plan:
    """One search: what the steps in the executors need."""

    def __init__(self, kind: str, size: int, gram: int, within: bool, buckets: int):
        self.kind, self.size, self.gram, self.within, self.buckets = kind, size, gram, within, buckets

    def read(self, path: str):
        """(rows, runs) of each slice of a block."""
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            for rb in slices(pq.ParquetFile(f).iter_batches(batch_size=1024), SLICE_BYTES, "text"):
                yield rb, Runs([(t or "").encode() for t in rb.column("text").to_pylist()], self.kind, self.size, self.gram)

    def counted(self, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and how often they occur; if not within documents, in how many texts."""
        order = np.lexsort((text, h))
        h, text = h[order], text[order]
        if not self.within and len(h):
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h = h[keep]
        return np.unique(h, return_counts=True)

    def anchors(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and their counts; a run in which its anchor stands twice may repeat a window by itself."""
        return self.counted(np.append(runs.anchor, runs.anchor[runs.twice]), np.append(runs.text, runs.text[runs.twice]))

    def split(self, f: int, parts: list[tuple[np.ndarray, np.ndarray]]):
        """Rows that send hashes to their buckets."""
        if parts:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(h)).astype(np.int64)
            bucket = self.bucket(h)
            order = np.argsort(bucket, kind="stable")
            h, count, bucket = h[order], count[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(h))):
                yield int(bucket[a]), f, _pack_hashes(h[a:b], count[a:b])

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """Mixed again: anchors are the lowest of many hashes, so that their own high bits are nearly all zero."""
        return (((mix(h) >> U64(32)) * U64(self.buckets)) >> U64(32)).astype(np.int64)

    def stretches(self, runs: Runs, shared: np.ndarray, often: np.ndarray, twice: np.ndarray | None):
        """text, lo, hi, anchor of the shared runs; of very frequent anchors only the stretches of windows that occur elsewhere too."""
        take = _among(runs.anchor, shared)
        common = take & _among(runs.anchor, often)
        if twice is not None and common.any():
            take &= ~common
        out = [(runs.text[take], runs.lo[take], runs.hi[take], runs.anchor[take])]
        if twice is not None and common.any():
            text, start = self.single(runs, common)
            hit = _among(runs.windows(start), twice)
            run = np.repeat(np.flatnonzero(common), (runs.hi - runs.lo + 1)[common])[hit]
            start, text = start[hit], text[hit]
            new = np.ones(len(start), bool)
            new[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(start)) - 1 if len(a) else a
            base = runs.at[text[a]]
            out.append((text[a], start[a] - base, start[b] - base, runs.anchor[run[a]]))
        return [np.concatenate(x) for x in zip(*out)]

    @staticmethod
    def single(runs: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and symbol (of all texts) of each window of some runs."""
        n = (runs.hi - runs.lo + 1)[which]
        text = np.repeat(runs.text[which], n)
        start = np.repeat((runs.lo + runs.at[runs.text])[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return text, start

    def contents(self, path: str, shared, often, twice):
        """By bucket the distinct contents of a block, each with its anchor and its earliest place; and of each slice its rows and
        (text, lo, hi, bucket, content number, place) of each stretch. A place is (doc_id, text hash, start), if not within
        documents doc_id alone."""
        seen: dict[bytes, tuple[int, int]] = {}
        lists = defaultdict(list)
        found = []
        for rb, runs in self.read(path):
            d, t = rb.column("__d").to_pylist(), rb.column("__t").to_pylist()
            text, lo, hi, anchor = self.stretches(runs, shared, often, twice)
            rows = []
            for i, a, b, h, k in zip(text.tolist(), lo.tolist(), hi.tolist(), anchor.tolist(), self.bucket(anchor).tolist()):
                content = runs.content(i, a, b)
                place = (d[i], t[i], a) if self.within else (d[i],)
                at = seen.get(content)
                if at is None:
                    seen[content] = at = (k, len(lists[k]))
                    lists[k].append([h, content, place])
                elif place < lists[k][at[1]][2]:
                    lists[k][at[1]][2] = place
                rows.append((i, a, b, *at, place))
            found.append((rb, rows))
        return lists, found


def _grouped(frames, key: str, *values: str):
    """Rows of an Arrow stream by a key: what one task holds, a few buckets or blocks."""
    out = defaultdict(list)
    for rb in frames:
        for k, *v in zip(rb.column(key).to_pylist(), *(rb.column(x).to_pylist() for x in values)):
            out[k].append(v)
    return out.items()


def _exchange(sent: DataFrame, plan: Plan, kind: int) -> DataFrame:
    """Tells each block which of the hashes it sent occur twice or more (kind), and which very often (kind + 1)."""

    def run(frames):
        for _, rows in _grouped(frames, "bucket", "f", "payload"):
            parts = [_unpack_hashes(payload) for _, payload in rows]
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(float))
            twice, often = h[count >= 2], h[count > OFTEN]
            for (f, _), (own, _) in zip(rows, parts):
                for k, known in ((kind, twice), (kind + 1, often)):
                    mine = own[_among(own, known)]
                    if len(mine):
                        yield arrow_batch(ANSWERS, [f], [k], [_pack_hashes(mine, np.ones(len(mine)))])

    return stored(sent.repartition(2 * plan.buckets, "bucket").mapInArrow(run, ANSWER))


def _by_block(tables: list[DataFrame], blocks: DataFrame, n: int, function, schema: str) -> DataFrame:
    """function(f, path, answers by kind) for each block."""
    rows = blocks.select("f", F.lit(-1).alias("kind"), F.encode("path", "utf-8").alias("payload"))
    for t in tables:
        rows = rows.unionByName(t)

    def run(frames):
        for f, got in _grouped(frames, "f", "kind", "payload"):
            answers = defaultdict(list)
            for kind, payload in got:
                answers[kind].append(payload)
            yield from function(f, answers[-1][0].decode(), answers)

    return rows.repartition(3 * n, "f").mapInArrow(run, schema)


def _known(payloads: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([_unpack_hashes(p)[0] for p in payloads])) if payloads else np.empty(0, U64)


def cut_repeats(docs: DataFrame, carried: list[str], kind: str, size: int, gram: int, within: bool, kernel, function, out: pa.Schema, schema: str) -> DataFrame:
    """function(carried values, text, spans) of each document as a row of `out`; spans: merged (start, end) of its symbols to remove.

    kernel(contents, size): contents are [anchor, bytes, place as a number] in order of the anchor; gives for each an array with the
    earliest place of each of its windows.
    A symbol goes if a window over it also starts at an earlier place.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    cols = [F.col(c) for c in carried] + [F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__d"), F.xxhash64("text").alias("__t")]
    docs.select(*cols).write.option("maxRecordsPerFile", BLOCK_ROWS).option("compression", "zstd").parquet(path)
    stored_docs = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), "text")
    blocks = stored(stored_docs.groupBy("path").agg(F.sum(F.octet_length("text")).alias("size")).select(F.xxhash64("path").alias("f"), "path", "size"))
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    plan = Plan(kind, size, gram, within, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    n = max(1, n)

    def anchors(f, path, answers):
        parts = [plan.anchors(runs) for _, runs in plan.read(path)]
        for row in plan.split(f, parts):
            yield arrow_batch(SENDS, *([x] for x in row))

    shared = _exchange(_by_block([], blocks, n, anchors, SENT), plan, 0)
    tables = [shared]
    if not shared.where("kind = 1").isEmpty():

        def windows(f, path, answers):
            often, parts = _known(answers[1]), []
            if len(often):
                for _, runs in plan.read(path):
                    common = _among(runs.anchor, often)
                    if common.any():
                        text, start = plan.single(runs, common)
                        parts.append(plan.counted(runs.windows(start), text))
            for row in plan.split(f, parts):
                yield arrow_batch(SENDS, *([x] for x in row))

        tables.append(_exchange(_by_block(tables, blocks, n, windows, SENT), plan, 2))
    exact = len(tables) > 1

    def known(answers):
        return _known(answers[0]), _known(answers[1]), _known(answers[2]) if exact else None

    def send(f, path, answers):
        lists, _ = plan.contents(path, *known(answers))
        for bucket, contents in lists.items():
            yield arrow_batch(SENDS, [bucket], [f], [packed(contents)])

    def judge(frames):
        for bucket, rows in _grouped(frames, "bucket", "f", "payload"):
            sent = [(f, unpacked(payload)) for f, payload in rows]
            # Places as numbers in their order: the document's rank, then the start.
            documents = sorted({place[:2] for _, contents in sent for _, _, place in contents})
            rank = {x: i for i, x in enumerate(documents)}
            width = 1 + max((place[2] + len(content) for _, contents in sent for _, content, place in contents), default=0) if within else 1
            distinct: dict[bytes, list] = {}
            answers = [[b""] * len(contents) for _, contents in sent]
            for (_, contents), bits in zip(sent, answers):
                for i, (anchor, content, place) in enumerate(contents):
                    place = rank[place[:2]] * width + (place[2] if within else 0)
                    have = distinct.setdefault(content, [anchor, content, place, []])
                    have[2] = min(have[2], place)
                    have[3].append((bits, i, place))
                contents.clear()
            ordered = sorted(distinct.values(), key=lambda x: x[0])
            del distinct, documents, rank
            for (_, _, _, copies), first in zip(ordered, kernel(ordered, size)):  # a shard's places at a time
                for bits, i, place in copies:
                    bits[i] = (first < (place + np.arange(len(first)) if within else place)).tobytes()
            for (f, _), bits in zip(sent, answers):
                yield arrow_batch(ANSWERS, [f], [9], [packed((bucket, bits))])
            del sent, answers, ordered  # before the next bucket

    verdicts = stored(_by_block(tables, blocks, n, send, SENT).repartition(2 * plan.buckets, "bucket").mapInArrow(judge, ANSWER))

    def finish(f, path, answers):
        bits = dict(map(unpacked, answers[9]))
        lists, found = plan.contents(path, *known(answers))
        for rb, rows in found:
            gone = defaultdict(list)
            for i, a, b, k, number, place in rows:
                if place > lists[k][number][2]:  # an earlier copy stands in this block
                    gone[i].append((a, b + size))
                else:
                    flags = np.frombuffer(bits[k][number], bool)
                    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
                    gone[i] += [(a + int(x), a + int(y) - 1 + size) for x, y in zip(edge[::2], edge[1::2])]
            carried_values = [rb.column(c).to_pylist() for c in carried]
            made = [function(values, text or "", merged(gone[i]) if i in gone else NONE) for i, (text, *values) in enumerate(zip(rb.column("text").to_pylist(), *carried_values))]
            yield arrow_batch(out, *zip(*made))

    return _by_block([*tables, verdicts], blocks, n, finish, schema)


NONE = np.empty((0, 2), np.int64)


def merged(spans: list[tuple[int, int]]) -> np.ndarray:
    """Sorted spans, overlapping or touching ones joined."""
    if not spans:
        return NONE
    x = np.array(sorted(spans), np.int64)
    reach = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    return np.column_stack([x[new, 0], reach[np.concatenate([new[1:], [True]])]])
