"""Language ID: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import BYTE_VALUE, U64, gram_hash, joined

LETTER = regex.compile(r"\p{L}")
BUCKETS = 4096
#: Typical subwords that a text's familiarity is averaged with, so that short texts aren't judged by a few subwords.
PRIOR = 20


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each subword (3 bytes of lower-cased text, spaces for white space; a text ends in one), its text's number, and
    whether it is of letters (a-z and bytes above 127) and white space only. No subword reaches into the next text."""
    data, at = joined(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    data = np.where((data >= 9) & (data <= 13), 32, data).astype(np.uint8)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    h = gram_hash(BYTE_VALUE[data], 3)
    inside = owner[: len(h)] == owner[len(owner) - len(h) :]
    letters = (data >= 128) | (data >= 97) & (data <= 122) | (data == 32)
    letters = letters[:-2] & letters[1:-1] & letters[2:] if len(data) > 2 else np.zeros(0, bool)
    return (h % U64(BUCKETS)).astype(np.int32)[inside], owner[: len(h)][inside], letters[inside]


def averages(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over each text's subwords."""
    bucket, owner, _ = features(texts)
    count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return np.column_stack([np.bincount(owner, weights=table[bucket, j], minlength=len(texts)) / count for j in range(table.shape[1])])


class Model:
    """languages, scores by bucket (embedding times softmax weights), bias, temperature; known is each bucket's log-likelihood in
    a language over that in uniform noise, typical its mean in each language's training texts, and texts of a familiarity below
    reject are rejected."""

    def __init__(self, languages, table, bias, temperature=1.0, reject=-np.inf, known=None, typical=None):
        self.languages, self.table, self.bias, self.temperature, self.reject = languages, table, bias, temperature, reject
        self.known = np.zeros_like(table) if known is None else known
        self.typical = np.zeros(len(languages)) if typical is None else typical

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of the languages, and the text's familiarity as one of the likeliest language."""
        z = (averages(texts, self.table) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = z.argmax(axis=1)
        bucket, owner, ok = features(texts)
        bucket, owner = bucket[ok], owner[ok]
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner, weights=self.known[bucket, best[owner]], minlength=len(texts))
        return z / z.sum(axis=1, keepdims=True), (total + self.typical[best] * PRIOR) / (n + PRIOR)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return self.judged(texts)[0]


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 30, rate: float = 2.0, batch: int = 64, rejected: float = 0.001, seed: int = 7) -> Model:
    """Stochastic gradient descent in numpy; the fifth that isn't trained on sets the temperature and the rejection cutoff.

    The softmax only compares the languages learned, so unlearned ones score high too. Rejection is by familiarity: the mean
    log-likelihood of the text's subwords of letters under the predicted language's subword frequencies. reject is the familiarity under
    which at most the share `rejected` of right predictions on that fifth falls; with less than 20 such texts only texts
    without a letter are rejected.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, langs)
    raw = [t.encode() for t in texts]
    x = np.zeros((len(raw), BUCKETS), np.float32)
    for i, t in enumerate(raw):
        b, _, _ = features([t])
        x[i] = np.bincount(b, minlength=BUCKETS) / max(1, len(b))
    order = rng.permutation(len(raw))
    held, train = order[: len(raw) // 5], order[len(raw) // 5 :]
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), batch):
            i = rng.permutation(train)[:batch] if len(train) <= batch else train[at : at + batch]
            a = x[i] @ e
            z = a @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            ga = p @ w.T
            w -= step * (a.T @ p)
            bias -= step * p.sum(axis=0)
            e -= step * 50 * (x[i].T @ ga)  # a bucket has a small share of each text
        rng.shuffle(train)
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for i in train:
        b, _, ok = features([raw[i]])
        b = b[ok]
        counts[:, y[i]] += np.bincount(b, minlength=BUCKETS) * (min(len(b), 2000) / max(1, len(b)))  # no long text outweighs the others
    known = np.log(BUCKETS * counts / counts.sum(axis=0))
    typical = ((counts - 0.5) * known).sum(axis=0) / np.maximum((counts - 0.5).sum(axis=0), 1)
    model = Model(languages, (e @ w).astype(np.float64), bias.astype(np.float64), known=known, typical=typical)
    if len(held) >= 20:
        z = x[held] @ e @ w + bias
        best = (np.inf, 1.0)
        for t in np.geomspace(0.02, 10, 41):
            l = z / t - (z / t).max(axis=1, keepdims=True)
            best = min(best, (float(-(l[np.arange(len(held)), y[held]] - np.log(np.exp(l).sum(axis=1))).mean()), float(t)))
        model.temperature = best[1]
        p, familiar = model.judged([raw[i] for i in held])
        right = p.argmax(axis=1) == y[held]
        if right.any():
            model.reject = float(np.quantile(familiar[right], rejected, method="lower"))
    return model


def train(docs: DataFrame, max_rows: int = 4000, max_chars: int = 20_000_000) -> Model:
    """Fits on at most max_rows labelled rows, those of the lowest hash among doc_ids with crc32(doc_id) mod 3 <> 1.

    Whole texts are used; the driver holds max_rows rows, and of these only up to max_chars characters in hash order (one text at least).
    The rows are chosen by hash and length before any text moves: hashes under a share of their range that holds some
    1.5 times max_rows of the counted rows. Null texts, labels and ids take no part; without rows the model knows no language.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null and pmod(crc32(cast(doc_id as string)), 3) <> 1")
    hashed = usable.select("text", "lang", F.xxhash64(F.lit("fit"), F.col("doc_id").cast("string"), "text").alias("h"))
    n = usable.select("lang").count()
    reach = min(2**63 - 1, 2**64 * (3 * max_rows // 2 + 1000) // max(1, n) - 2**63)
    sizes = hashed.where(F.col("h") <= reach).select("h", F.length("text").alias("n")).orderBy("h", "n").limit(max_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > max_chars and last is not None:
            break
        last = r["h"]
    if last is None:
        return fit([], [])
    rows = hashed.where(F.col("h") <= last).select("h", "text", "lang").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["h"], r["text"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with lang_pred, score (calibrated probability) and rejected (too unlike the training texts, or no letter).

    Null texts and texts without a letter: `und`, score 0, rejected. A text's result doesn't depend on its neighbours; repeated rows come
    out alike; an empty table gives no rows. Only text is read for the prediction; the model is a few hundred KB.
    Columns of these three names in docs are replaced. No shuffle.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = sent.value
        for rb in frames:
            texts = rb.column(rb.schema.get_field_index("text")).to_pylist()
            pred, score, low = [], [], []
            at, held = 0, 0
            for i, t in enumerate([*texts, None]):
                held += len(t or "")
                if held > 2 << 20 or i == len(texts):
                    part = texts[at : i + 1] if i < len(texts) else texts[at:]
                    at, held = i + 1, 0
                    if part:
                        p, familiar = m.judged([(x or "").encode() for x in part])
                        for x, row, f in zip(part, p, familiar):
                            ok = x is not None and LETTER.search(x) is not None
                            pred.append(m.languages[int(row.argmax())] if ok else "und")
                            score.append(float(row.max()) if ok else 0.0)
                            low.append(pred[-1] == "und" or bool(f < m.reject))
            cols = [*rb.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rb.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)
