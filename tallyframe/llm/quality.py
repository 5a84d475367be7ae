"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_side, stored

#: Cutoffs that each rule may take: a document above the rule's cutoff is rejected.
GRID = {
    "symbol_rate": (0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_line_rate": (0.02, 0.05, 0.1, 0.2, 0.3),
    "repeat_rate": (0.1, 0.2, 0.3, 0.4),
    "mean_word_chars": (8.0, 10.0, 12.0, 15.0, 20.0),
}
#: The order of testing, from no rule to the strictest cutoffs of all: each step tightens one rule, all rules in turn.
STEPS = [(r, c) for _, _, r, c in sorted((k, i, r, c) for i, (r, cs) in enumerate(GRID.items()) for k, c in enumerate(cs[::-1]))]


def _let(value, body):
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words):
    def grams(w):
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))

    def covered(t):
        same = lambda i, k: F.coalesce(F.get(t, i)["g"] == F.get(t, i + k)["g"], F.lit(False))
        starts = F.transform(t, lambda x, i: F.when(same(i, -1) | same(i, 1), F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(F.flatten(F.filter(starts, lambda x: x.isNotNull()))))

    return _let(words, lambda w: F.when(F.size(w) >= 3, _let(grams(w), covered)).otherwise(0))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    x = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("text"))
    x = x.select(
        "doc_id",
        "stratum",
        F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).cast("long").alias("n_repeat_words"),
    )
    return x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rates():
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "dup_line_rate": F.col("n_dup_lines") / n, "repeat_rate": F.col("n_repeat_words") / n, "mean_word_chars": F.col("word_chars") / n}


def _at_most(k, n, rate: float):
    """P(Binomial(n, rate) <= k) by summing its terms; called only where k <= rate * n."""
    odds = F.lit(rate / (1 - rate))
    start = n * F.log(F.lit(1 - rate))
    step = lambda s, i: _let(s["l"] + F.log((n - i + 1) / i * odds), lambda l: F.struct(l.alias("l"), (s["p"] + F.exp(l)).alias("p")))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.struct(start.alias("l"), F.exp(start).alias("p")), step, lambda s: s["p"])


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """stratum and the cutoff of each rule (null: none holds), from labelled documents.

    Fixed-sequence testing along STEPS: a step holds the cutoffs of all rules so far and is certified if the exact (Clopper-Pearson)
    upper bound on the share of good labelled documents that they reject together is at most risk, at error / strata. No further
    correction is due, since the order is fixed beforehand and the first step that fails ends the sequence; later steps reject more, so
    they fail too. So with probability 1 - error, each stratum loses at most `risk` of its good documents to all rules together. 217
    good documents suffice with 4 strata if none is rejected. The steps are fixed beforehand, so every labelled document serves. A
    document with several labels counts as good only if all say so; null labels don't count.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    rates = _rates()
    step = F.least(*[F.when(rates[r] > c, i) for i, (r, c) in enumerate(STEPS)])  # that first rejects the document
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi").select("stratum", step.alias("step"))
    strata = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("step") <= i).alias(f"k{i}") for i in range(len(STEPS))]))
    level = error / max(1, strata.count())
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(STEPS)]))
    tests = strata.select("stratum", "n", rows.alias("x")).select("stratum", "n", "x.*")
    sure = tests.where(F.when(F.col("k") <= risk * F.col("n"), _at_most(F.col("k"), F.col("n"), risk) <= level).otherwise(False))
    return sure.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID])


def quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """metrics() of every document with kept: false if base_failed or above a cutoff certified for its stratum.

    Null or empty text: no words, so base_failed. Null lang is a stratum. A stratum without enough good labels has no cutoffs. Rows of
    equal doc_id each get a row. Texts are read once; what follows uses the stored counts. Extra columns are not read.
    """
    measured = stored(metrics(docs))
    cuts = small_side(thresholds(measured, labels, risk, error).withColumnRenamed("stratum", "s"))
    x = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    above = F.lit(False)
    for r, rate in _rates().items():
        above = above | F.coalesce(rate > F.col(f"cut_{r}"), F.lit(False))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return x.select(*cols, (~F.col("base_failed") & ~above).alias("kept"))
