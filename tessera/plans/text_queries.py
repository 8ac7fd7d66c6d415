"""String, JSON and classifier rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .catalogue import query, read

_SUFFIXES = ["tion", "ment", "ung"]


@query("q_text_flags", """
WITH w AS (SELECT source, unnest(string_split(trim(text), ' ')) AS w FROM documents WHERE text IS NOT NULL)
SELECT w AS word, lower(trim(w)) AS low, regexp_full_match(w, '\\p{L}+') AS alpha, lower(trim(w)) IN ('the', 'de', 'der') AS seed,
  ((lower(w) LIKE '%tion' AND length(w) > 4) OR (lower(w) LIKE '%ment' AND length(w) > 4) OR (lower(w) LIKE '%ung' AND length(w) > 3)) AS suffix, starts_with(source, 'src1') AS from_one, CAST(length(w) AS BIGINT) AS n_chars, count(*) AS n FROM w GROUP BY ALL""")
def text_flags(spark, d):
    """Every distinct word of all texts, and how often it occurs."""
    w = read(spark, d, "documents").where("text is not null").select("source", F.explode(F.split(F.trim("text"), " ")).alias("word"))
    n = w.groupBy("word", F.startswith("source", F.lit("src1")).alias("from_one")).agg(F.count("*").alias("n"))
    f = text.word_flags(F.col("word"), ["the", "de", "der"], _SUFFIXES)
    return n.select("word", F.lower(F.trim("word")).alias("low"), text.is_alpha(F.col("word")).alias("alpha"), f["seed"].alias("seed"), f["suffix"].alias("suffix"), "from_one", F.length("word").cast("long").alias("n_chars"), "n")


@query("q_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(greatest(0, least(1, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50)), 6) AS confidence FROM events")
def json_extract(spark, d):
    k = F.from_json("props", "k long")["k"]
    return read(spark, d, "events").select("event_id", k.alias("k"), F.round(text.clamp01(k / 50), 6).alias("confidence"))


#: First match wins.
_ERRORS = [("collision", ("duplicate", "thth")), ("provider", ("timeout", "token", "on the")), ("model", ("invalid", "and "))]


@query("q_error_classifier", """
SELECT CASE WHEN contains(lower(text), 'duplicate') OR contains(lower(text), 'thth') THEN 'collision' WHEN contains(lower(text), 'timeout') OR contains(lower(text), 'token') OR contains(lower(text), 'on the') THEN 'provider'
  WHEN contains(lower(text), 'invalid') OR contains(lower(text), 'and ') THEN 'model' ELSE 'other' END AS kind, role, count(*) AS n FROM conversations GROUP BY 1, 2""")
def error_classifier(spark, d):
    return read(spark, d, "conversations").groupBy(text.first_match(F.col("text"), _ERRORS, "other").alias("kind"), "role").agg(F.count("*").alias("n"))


@query("q_stratum", "SELECT CASE WHEN p_type IS NULL OR p_type = '' THEN 'unknown' ELSE list_extract(string_split(replace(p_type, ' ', '-'), '-'), -1) END AS stratum, count(*) AS n FROM part GROUP BY 1")
def stratum(spark, d):
    return read(spark, d, "part").groupBy(text.stratum_of(F.replace("p_type", F.lit(" "), F.lit("-")), "unknown").alias("stratum")).agg(F.count("*").alias("n"))


@query("q_model_ids", "SELECT c_mktsegment || ':' || c_name AS spec, split_part(c_mktsegment || ':' || c_name, ':', 1) AS provider, split_part(c_name, '#', 1) AS lineage FROM customer")
def model_ids(spark, d):
    c = read(spark, d, "customer").select("c_name", text.model_id(F.col("c_mktsegment"), F.col("c_name")).alias("spec"))
    return c.select("spec", text.split_model_id(F.col("spec"))[0].alias("provider"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("lineage"))
