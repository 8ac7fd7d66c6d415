"""One query per operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard_join, language_id, lm_score, packing, secret_scan, substring_dedup, topk_search, toxicity
from .common import crc_of_id, table


def _held(mod: int, value: int):
    return F.pmod(crc_of_id(), F.lit(mod)) == value


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~_held(3, 1)).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", _held(3, 1).alias("held_out"), "lang_pred", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that ``labels`` marks as of good quality; background: all others. Each is scored by models without itself."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    models = lm_score.train(lm_score.with_target(table(spark, sf_dir, "documents"), good))
    return lm_score.score(models, held_out=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    return secret_scan.digest(findings)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~_held(5, 0)))
    found = toxicity.score(docs, lexicon)
    return found.select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk_search, op2_language_id, op3_html_text, op4_substring_dedup, op5_jaccard_join, op6_decontaminate, op7_packing, op8_lm_score, op9_secret_scan, op10_toxicity)}


_TOPK_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(generate_series(1, len(c.v)), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i+19], ' ') ORDER BY doc_id, i) AS rn FROM p),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM k WHERE rn > 1),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM w WHERE len(ws) > 0),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT x.* FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.j = c.j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""

_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= 0.8),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
cls AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
cp AS (SELECT a, least(a, min(b)) AS copy_id FROM links WHERE same GROUP BY a),
reps AS (SELECT doc_id, coalesce(copy_id, doc_id) AS copy_id FROM w LEFT JOIN cp ON cp.a = w.doc_id),
cnt AS (SELECT l.a, count(*) AS n_links, count(DISTINCT r.copy_id) FILTER (NOT l.same) AS n_text_links FROM links l JOIN reps r ON r.doc_id = l.b GROUP BY l.a)
SELECT reps.doc_id, coalesce(cls.class_id, reps.doc_id) AS class_id, reps.copy_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links
FROM reps LEFT JOIN cls ON cls.a = reps.doc_id LEFT JOIN cnt ON cnt.a = reps.doc_id
"""


def _secret_sql() -> str:
    parts, base = [], {r.kind for r in secret_scan.BASE}
    for i, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS place, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, "
            f"{f"regexp_extract_all(t, '{pattern}', {r.lead})" if r.lead else 'CAST([] AS VARCHAR[])'} AS ld, string_split_regex(t, '{pattern}') AS p, {r.least} AS least FROM d"
        )
    kinds = ", ".join(f"'{k}'" for k in sorted(base))
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.BASE)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM r WHERE len(m) > 0),
s AS (SELECT doc_id, place, kind, length(m[i]) AS l, length(g[i]) AS gl, coalesce(length(ld[i]), 0) AS skip, least,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start FROM i),
f AS (SELECT doc_id, place, kind, CAST(start + skip AS BIGINT) AS start, kind || ':' || CAST(start + skip AS BIGINT) || ':' || CAST(start + l AS BIGINT) AS span FROM s WHERE gl >= least),
a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, place) AS spans, string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({kinds})) AS base FROM f GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": _TOPK_SQL,
        "op4_substring_dedup": _SUBSTRING_SQL,
        "op5_jaccard_join": _JACCARD_SQL,
        "op6_decontaminate": decontaminate.ORACLE_SQL,
        "op9_secret_scan": _secret_sql(),
    }
