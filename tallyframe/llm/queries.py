"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, langid, license_scan, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_output, topk
from .common import documents


def op1_token_output(spark, sf_dir):
    return token_output.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_license_scan(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_words(documents(spark, sf_dir)).drop("text")


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir)).drop("kept")


def op7_exact_top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    x = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    held = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)")
    return x.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_byte_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def base_quality_counts(spark, sf_dir):
    """The counts and the base rule under op3, which SQL can express."""
    return quality.metrics(documents(spark, sf_dir)).drop("stratum")


def base_license_places(spark, sf_dir):
    """The exact phrases under op4, which SQL can express; -1 for no place."""
    return license_scan.scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").na.fill(-1)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_mix_sources, op3_quality_rules, op4_license_scan, op5_substring_dedup, op6_suffix_dedup, op7_exact_top_k, op8_near_dedup, op9_language_id, op10_byte_bpe, base_quality_counts, base_license_places)}

W = r"'[^\x20\x09-\x0D]+'"
ORACLES = {
    "op2_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {W}))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS n FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, n) FROM l WHERE level <= cap::DOUBLE / w) * w, cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM p""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {W}) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS m FROM p),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM g, range(0, 13) t(j) WHERE m < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
y AS (SELECT x.doc_id, count(*) AS n, count(c.k) AS gone, coalesce(string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE c.k IS NULL), '') AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON w.doc_id = y.doc_id""",
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {W}) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "base_quality_counts": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {W}) AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(0, 3) t(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {W})) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m""",
    "base_license_places": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) t(phrase, label)),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT doc_id, i - 1 AS place, label FROM p JOIN b ON ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase),
x AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, coalesce(lo, -1)::BIGINT AS first_word, coalesce(hi, -1)::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN x ON w.doc_id = x.doc_id""",
}
