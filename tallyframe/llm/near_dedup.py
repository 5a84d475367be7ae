"""MinHash near-dedup with confirmed links and connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, U64, arrow_batch, discard, gram_hash, ids_texts, joined, mix, slices, small_side, stored, word_hashes, words_of

BANDS, ROWS, WIDTH = 64, 8, 5
BINS = BANDS * ROWS
BITS = 2 * BINS
LONGS = [f"b{i}" for i in range(BITS // 64)]
#: Two sets at similarity 0.75 differ in an eighth of the bits on average, 128 of 1024, standard deviation 12.6; beyond this, a pair is left out.
FAR_BITS = 166


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, at = joined([t.encode() for t in texts])
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends = words_of(data)
    symbols = word_hashes(data, starts, ends)
    grams = gram_hash(symbols, WIDTH)
    bounds = np.searchsorted(starts, at)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(grams[a : b - WIDTH + 1]))
        else:
            out.append(gram_hash(symbols[a:b], b - a) if b > a else np.empty(0, U64))
    return out


def _donors(bins: int, tries: int = 1024) -> np.ndarray:
    """The bins that an empty bin asks in turn: random, the same for all texts."""
    x = mix(np.arange(1, bins * tries + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (x % U64(bins)).astype(np.int32).reshape(bins, tries)


DONORS = _donors(BINS)
PLACE = np.arange(BINS, dtype=U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One permutation, split into bins; each empty bin takes the value of the first full one among its donors."""
    x = np.sort(mix(shingles + U64(0x51ED270B)))
    of = ((x >> U64(32)) * U64(BINS)) >> U64(32)
    first = np.searchsorted(of, PLACE)
    at = np.minimum(first, len(x) - 1)
    full, out = of[at] == PLACE, x[at]
    empty = np.flatnonzero(~full)
    for tries in (8, 64, DONORS.shape[1]):
        if not len(empty):
            return out
        hit = full[DONORS[empty, :tries]]
        pick = hit.argmax(axis=1)
        found = hit[np.arange(len(empty)), pick]
        out[empty[found]] = x[first[DONORS[empty[found], pick[found]]]]
        empty = empty[~found]
    out[empty] = x[0]  # after 1,024 tries: a bin of a set with three full bins comes to this with a chance of 0.3 %
    return out


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the signature, and two bits for each bin, as longs: of two sets these bits agree with a chance of (1 + similarity) / 2."""
    sig = signature(shingles)
    two = mix(sig + PLACE)
    bits = np.packbits(np.concatenate([two >> U64(63), two >> U64(62) & U64(1)]).astype(np.uint8)).view(np.int64)
    rows = sig.reshape(BANDS, ROWS)
    key = rows[:, 0]
    for r in range(1, ROWS):
        key = mix(key) + rows[:, r]
    return np.unique(mix(key + PLACE[:BANDS])).view(np.int64), bits


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and other columns, stored) with 100 * intersection >= 75 * union on the full sets; the sets go to the pairs."""
    near = F.broadcast if pairs.count() <= 100_000 else (lambda df: df)  # 32 bytes a row
    x = sets.join(near(pairs), F.col("s") == F.col("a")).select(*pairs.columns, F.col("sh").alias("x"), F.lit(None).cast("array<long>").alias("y"))
    y = sets.join(near(pairs), F.col("s") == F.col("b")).select(*pairs.columns, F.lit(None).cast("array<long>").alias("x"), F.col("sh").alias("y"))
    both = x.unionByName(y).groupBy(*pairs.columns).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = both.select(*pairs.columns, F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.where("100 * i >= 75 * (n - i)").select(*pairs.columns)


def links(keys: DataFrame, sets: DataFrame, steps: tuple[int, ...] = (1, 16, 256)) -> DataFrame:
    """Confirmed links (a, b) that connect what the buckets connect; keys: k (bucket), ks (all buckets of the set that others share),
    s (set), n (its size) and its bits.

    Each round emits stars: some members of each bucket, the centres, against its members of other components (c, by the links
    confirmed so far). Pairs whose bits are too far apart for similarity 0.75 are left out within that join, and so are pairs
    that share a lower bucket, where they are compared; so a pair costs a few instructions and only likely links are emitted, once. A centre isn't one again, as all its pairs there are compared or
    within one component, and the bucket ends when its members are of one component or all were centres. The first centre of all
    buckets follows one order, so that buckets of one group share it; later ones are of the components that have the fewest
    members in the bucket, one of each, in numbers of `steps` (the last again and again). Every round takes a centre out of
    each bucket that goes on, so the rounds end without a limit.
    """
    open_rows, found, round_ = stored(keys.withColumn("c", F.col("s")).withColumn("free", F.lit(True))), [], 0
    member = F.struct(F.xxhash64("s").alias("order"), "s", "n", "ks", *LONGS)
    far = reduce(lambda x, y: x + y, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"z{b}"))) for b in LONGS])
    while True:
        of_component = open_rows.groupBy("k", "c").agg(F.count("*").alias("share"), F.min(F.when(F.col("free"), member)).alias("m")).where("m is not null")
        bucket = Window.partitionBy("k")
        of_component = of_component.withColumn("several", F.min("c").over(bucket) < F.max("c").over(bucket)).where("several")  # with a member to go
        few = bucket.orderBy("share" if round_ else F.lit(0), "m.order", "c")
        lead = of_component.withColumn("r", F.row_number().over(few)).where(F.col("r") <= steps[min(round_, len(steps) - 1)])
        lead = stored(lead.select("k", F.col("m.s").alias("z"), F.col("m.n").alias("zn"), F.col("m.ks").alias("zks"), F.col("c").alias("zc"), *[F.col(f"m.{b}").alias(f"z{b}") for b in LONGS]))
        n_lead = lead.count()
        if not n_lead:
            break
        near = F.broadcast if n_lead <= 30_000 else (lambda df: df)  # some 200 to 600 bytes a row
        star = open_rows.join(near(lead), "k").where("c <> zc and 100 * least(n, zn) >= 75 * greatest(n, zn)").where(far <= FAR_BITS)
        star = star.where(F.array_min(F.array_intersect("ks", "zks")) == F.col("k"))
        pairs = stored(star.select(F.least("s", "z").alias("a"), F.greatest("s", "z").alias("b"), F.least("c", "zc").alias("low"), F.greatest("c", "zc").alias("high")))
        good = stored(_confirmed(pairs, sets))
        found.append(good.select("a", "b"))
        tried = lead.select("k", F.col("z").alias("s"), F.lit(False).alias("still"))
        rest = open_rows.join(near(tried), ["k", "s"], "left").withColumn("free", F.coalesce("still", "free")).drop("still")
        if not good.isEmpty():
            roots = components(good.select(F.col("low").alias("a"), F.col("high").alias("b"))).withColumnRenamed("s", "c")
            rest = rest.join(small_side(roots), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")
        if round_ == 0:  # most buckets end here
            live = rest.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("k")
            rest = rest.join(live, "k")
        rest, before, round_ = stored(rest), open_rows, round_ + 1
        discard(before, lead, pairs)
        open_rows = rest
    return stored(reduce(DataFrame.unionByName, found).distinct()) if found else stored(keys.select(F.col("s").alias("a"), F.col("s").alias("b")).where("false"))


def _few_components(edges: DataFrame) -> DataFrame:
    """components() of few edges, by union-find in one task."""
    out = pa.schema([("s", pa.int64()), ("root", pa.int64())])

    def run(frames):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        for rb in frames:
            for u, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                a, b = sorted((top(u), top(v)))
                up[b] = a
        rows = [(x, top(x)) for x in up if top(x) != x]
        if rows:
            yield arrow_batch(out, *zip(*rows))

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "s long, root long")


def components(edges: DataFrame, in_one_task: int = 100_000) -> DataFrame:
    """s, root from edges (a, b): alternating large and small stars until nothing changes; up to in_one_task counted edges, union-find in a task."""
    edges, last = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), None
    if edges.count() <= in_one_task:
        return stored(_few_components(edges))
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        before, edges = edges, stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(before, large)
        if now == last:
            return edges.select(F.col("u").alias("s"), F.col("v").alias("root"))
        last = now


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _of_rows(docs: DataFrame, row: F.Column) -> DataFrame:
    """doc_id, t (row: a hash that tells rows of one doc_id apart), n, component_id, kept of every row."""
    ids = docs.select(F.col("doc_id").cast("long"), row.alias("t"), "text")
    first = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(frames):
        for rb in slices(frames):
            sets = shingle_sets([t or "" for t in rb.column(2).to_pylist()])
            made = [sketch(x) if len(x) else ([], []) for x in sets]
            yield arrow_batch(first, rb.column(0), rb.column(1), [len(x) for x in sets], [_set_id(x) if len(x) else None for x in sets], [k for k, _ in made], [b for _, b in made])

    sets = stored(ids.mapInArrow(run, "doc_id long, t long, n long, s long, keys array<long>, bits array<long>"))
    name = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "t")
    reps = stored(sets.where("s is not null").groupBy("s").agg(F.min(name).alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    keys = reps.select(F.explode("keys").alias("k"), "s")
    shared = stored(keys.groupBy("k").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("k"))
    met = stored(keys.join(shared, "k"))
    keys = met.groupBy("s").agg(F.collect_list("k").alias("ks")).join(reps.select("s", "n", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(LONGS)]), "s")
    keys = keys.withColumn("k", F.explode("ks"))

    # Full sets of one document of each class that shares a bucket, from its text: sets are larger than texts.
    wanted = reps.join(met.select("s").distinct(), "s", "left_semi").select("low.d", "low.t", F.col("s").alias("want"))
    texts = ids.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "t", "text").join(wanted, ["d", "t"]).select("want", "text")
    again_schema = pa.schema([("s", pa.int64()), ("sh", pa.list_(pa.int64()))])

    def again(frames):
        for want, texts_ in ids_texts(frames, id_column="want"):
            kept = [(w, x.view(np.int64)) for w, x in zip(want, shingle_sets(texts_)) if len(x) and _set_id(x) == w]
            if kept:
                yield arrow_batch(again_schema, *zip(*kept))

    full = stored(texts.mapInArrow(again, "s long, sh array<long>"))
    roots = components(links(keys, full))
    discard(full, met, shared)
    of_set = stored(reps.select("s", "low").join(roots, "s", "left").select("s", "low", F.coalesce("root", "s").alias("root")))
    of_set = of_set.join(of_set.groupBy("root").agg(F.min("low").alias("least")), "root").select("s", "least")
    out = sets.select("doc_id", "t", "n", "s").join(of_set, "s", "left")
    alone = F.col("least").isNull()
    return out.select(
        "doc_id",
        "t",
        "n",
        F.when(alone, F.col("doc_id")).otherwise(F.nullif(F.col("least.d"), F.lit(NULL_ID))).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(name == F.col("least")).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Words are lower-cased (A-Z); a set is the distinct 5-word shingles, or the whole text if shorter. Equal sets form a class
    (by a 64-bit hash); one set of each class is compared. Null or empty texts: n_shingles 0, a component of their own, kept. Null
    doc_ids come last: a component of such documents only has a null component_id. kept: the document of the smallest
    doc_id of its component, and of rows of one (or no) doc_id the one of the lowest text hash, so rows of the same doc_id and
    text are kept or not together. An empty table gives no rows; extra columns are not read.
    """
    return _of_rows(docs, F.xxhash64("text")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that near_duplicates keeps, one for each component; of rows equal in all columns one stays. Column names may be any."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    keep = _of_rows(docs, row).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__d"), F.col("t").alias("__t")).distinct()
    keyed = docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__t", row)
    return keyed.join(keep, ["__d", "__t"], "left_semi").dropDuplicates(["__d", "__t"]).drop("__d", "__t")
