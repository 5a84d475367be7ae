"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, shared_dir, stored

BLOCK, STRIP, NODES = 4096, 256, 2
LOCAL = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as long; rows with null, non-finite or no components go.

    So do vectors whose squares sum to 2^62 or more, since products of two of them need not fit a long; all others' do.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    usable = vectors.where("vec_id is not null").where(x.isNotNull() & (F.size(x) > 0)).where(~bad)
    long = F.aggregate(F.transform(x, lambda e: F.pow(F.abs(e.cast("double")) * F.lit(float(scale)) + 1, F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    return usable.where(long < float(1 << 62)).select(F.col("vec_id").cast("long"), F.transform(whole, lambda e: e.cast("long")).alias("v"))


def _blocks(vectors: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
    """vectors as files of at most BLOCK rows in the shared folder, each slice of dimensions in a column of its own; number (name) and path of each."""
    folder, spark = shared_dir(vectors.sparkSession), vectors.sparkSession
    cut = F.ceil(F.size("v") / NODES).cast("int")
    parts = [F.slice("v", F.lit(1) + j * cut, cut).alias(f"v{j}") for j in range(NODES)]
    vectors.repartition(max(1, -(-n // BLOCK))).select("vec_id", F.size("v").alias("dim"), *parts).write.option("maxRecordsPerFile", BLOCK).parquet(folder)
    paths = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias(f"{name}_path")).distinct()
    numbered = stored(paths.withColumn(name, (F.row_number().over(Window.orderBy(f"{name}_path")) - 1).cast("long")))  # a row a file
    return numbered, numbered.count()


class Slice:
    """One node's part of a block: by dimension the rows' places, ids and components of one slice."""

    def __init__(self, path: str, j: int):
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            t = pq.read_table(f, columns=["vec_id", "dim", f"v{j}"]).combine_chunks()
        ids, dims = t.column("vec_id").to_numpy(), t.column("dim").to_numpy()
        lists = t.column(f"v{j}").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.by_dim = {}
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            width = int(at[rows[0] + 1] - at[rows[0]])
            self.by_dim[d] = ids[rows], flat[at[rows][:, None] + np.arange(width)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products: float where every partial sum is exactly held, else integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _strips(q: Slice, c: Slice):
    """dim, first query, query ids, candidate ids and partial scores of some queries at a time with a block's candidates."""
    for d in q.by_dim.keys() & c.by_dim.keys():
        (qi, qv), (ci, cv) = q.by_dim[d], c.by_dim[d]
        for at in range(0, len(qi), STRIP):
            yield d, at, qi[at : at + STRIP], ci, _products(qv[at : at + STRIP], cv)


def _missing(q: Slice, c: Slice, d: int, at: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The partial scores of single entries from the other node."""
    return (q.by_dim[d][1][at + rows] * c.by_dim[d][1][columns]).sum(axis=1)


def _best(qi, ci, score, k: int):
    """The k best entries of each query, ties to the smaller id."""
    order = np.lexsort((ci, -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.flatnonzero(np.diff(qi, prepend=qi[:1] - 1))
    keep = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi)))) < k
    return qi[keep], ci[keep], score[keep]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products; queries are the rows with vec_id divisible by `every`.

    The dimensions are cut into two slices, one a node, so that a node's scores are partial. Candidates and queries lie in blocks of
    at most 4,096 in the shared folder, a column for each slice; a task has one block of each and reads the slices that it needs.
      1. Each node lists the best partial scores of each query in each block; these candidates' missing parts are fetched, and
         the k-th best of their whole scores is a safe cutoff, as k candidates reach it.
      2. The cutoff goes to all blocks of candidates. An entry that reaches it has at least half of it in one node, so each node
         collects its entries from that uniform share on. A query with fewer than k candidates has no cutoff and collects all.
      3. Missing parts of the entries collected are fetched; whole scores that reach the cutoff are ranked, ties to the smaller id,
         at most k of a query from a block.
    Rows without a usable vector or id take no part (see quantised); vectors of unequal lengths aren't compared. A query row whose
    vec_id is repeated counts once, with its smallest vector; candidates with the query's id are left out, and other repeated
    rows each count. An empty table gives no rows; extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors))
    n = rows.count()
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    c_blocks, n_c = _blocks(rows, n, "c")
    q_blocks, n_q = _blocks(queries, queries.count(), "q")
    few = max(1, -(-2 * k // max(1, n_c)))
    cells = spark.range(n_c * n_q).select((F.col("id") % max(1, n_c)).alias("c"), F.floor(F.col("id") / max(1, n_c)).alias("q"))
    cells = stored(cells.join(c_blocks, "c").join(q_blocks, "q").select("q", "q_path", "c_path"))
    spread = max(1, min(n_c * n_q, 4096))

    def gather(frames):
        for rb in frames:
            for number, q_path, c_path in zip(*(rb.column(x).to_pylist() for x in ("q", "q_path", "c_path"))):
                nodes = [(Slice(q_path, j), Slice(c_path, j)) for j in range(NODES)]
                lists: dict = {}
                for j, (q, c) in enumerate(nodes):
                    other = nodes[1 - j]
                    for d, at, qi, ci, s in _strips(q, c):
                        own = qi[:, None] == ci
                        s = np.where(own, -np.inf, s)  # to choose by; the scores are summed again as integers
                        top = np.argpartition(-s, min(few, len(ci)) - 1, axis=1)[:, :few]
                        r = np.repeat(np.arange(len(qi)), top.shape[1])
                        top = top.ravel()
                        ok = ~own[r, top]
                        r, top = r[ok], top[ok]
                        whole = (q.by_dim[d][1][at + r] * c.by_dim[d][1][top]).sum(axis=1) + _missing(*other, d, at, r, top)
                        lists.setdefault((d, at), []).append((r, top, whole, qi))
                for parts in lists.values():
                    qi = parts[0][3]
                    r, top, whole = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    _, once = np.unique(r * (top.max(initial=0) + 1) + top, return_index=True)  # listed by both nodes
                    if len(once):
                        yield arrow_batch(LOCAL, np.full(len(once), number), qi[r[once]], whole[once])

    local = cells.repartition(spread).mapInArrow(gather, "q long, query_id long, score long")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cut = local.withColumn("r", F.row_number().over(of_query)).where(F.col("r") <= k).where(F.col("r") == k)
    cut = stored(cut.groupBy("q").agg(F.collect_list("query_id").alias("ids"), F.collect_list("score").alias("floors")))  # of one block's queries

    def collect(frames):
        for rb in frames:
            for ids, floors, q_path, c_path in zip(*(rb.column(x).to_pylist() for x in ("ids", "floors", "q_path", "c_path"))):
                floor_of = dict(zip(ids or [], floors or []))
                nodes = [(Slice(q_path, j), Slice(c_path, j)) for j in range(NODES)]
                for j, (q, c) in enumerate(nodes):
                    other = nodes[1 - j]
                    for d, at, qi, ci, s in _strips(q, c):
                        floors_ = np.array([floor_of.get(x, -(1 << 62)) for x in qi.tolist()], np.int64)
                        cutoff = np.array([x in floor_of for x in qi.tolist()])
                        share = -(-floors_ // NODES)
                        take = (s >= share[:, None]) & cutoff[:, None] if j else (s >= share[:, None]) | ~cutoff[:, None]
                        r, col = np.nonzero(take & (qi[:, None] != ci))
                        rest = _missing(*other, d, at, r, col)
                        whole = s[r, col].astype(np.int64) + rest
                        keep = (whole >= floors_[r]) | ~cutoff[r]
                        if j:
                            keep &= rest < share[r]  # else the first node has collected it
                        if keep.any():
                            yield arrow_batch(FOUND, *_best(qi[r[keep]], ci[col[keep]], whole[keep], k))

    found = cells.join(cut, "q", "left").repartition(spread).mapInArrow(collect, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
