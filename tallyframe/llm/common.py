"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; in one process, as in tests, it may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tallyframe-{os.getpid()}"
    return f"{base.rstrip('/')}/tf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark drop the shuffle files of their plans."""
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """df stored, with a broadcast hint only if it is counted to have at most max_rows rows."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (multiply, xor-shift)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F) + U64(1))


def gram_hash(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n symbols, by doubling: log2(n) vector passes."""
    if len(symbols) < n:
        return np.empty(0, U64)
    h, size = symbols, 1
    while size < n:
        step = min(size, n - size)
        m = len(h) - step
        h = combine(h[:m], h[step : step + m])
        size += step
    return mix(h + U64(n))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: their 8-byte blocks mixed in one after another, from their length."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the block at each byte
    size = (ends - starts).astype(U64)
    h, left, rows = mix(size + U64(0xA0761D6478BD642F)), size.astype(np.int64), np.arange(len(starts))
    at = starts.copy()
    while len(rows):
        short = np.maximum(8 - left[rows], 0).astype(U64) * U64(8)
        h[rows] = combine(h[rows], blocks[at[rows]] << short >> short)
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    return h


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a newline after each, and the offset of each text and of the end."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def slices(frames, limit: int = 1 << 19, column: str = "text"):
    """Cuts Arrow batches so that each piece holds few texts or few bytes (or one long text): bounds a worker's memory."""
    for rb in frames:
        sizes = pc.fill_null(pc.binary_length(rb.column(rb.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
            yield rb.slice(at, stop - at)
            at = stop


def ids_texts(frames, limit: int = 1 << 19, id_column: str = "doc_id"):
    """Lists of ids (exact, null as None) and of texts (null as empty) of each slice."""
    for rb in slices(frames, limit):
        yield rb.column(rb.schema.get_field_index(id_column)).to_pylist(), [t or "" for t in rb.column(rb.schema.get_field_index("text")).to_pylist()]


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
