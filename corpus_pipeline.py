"""A training corpus from ``documents``: language ID, near-duplicate join, decontamination, secret scan, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from tessera.llm.common import crc_of_id, discard, joined_with, materialise, table

#: Ids up to which a stage's decisions are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Share of a document that may be in no learned language: a text that is mostly (more than half) in none is rejected.
MOST_UNLEARNED = 0.5
#: Scans of the secrets stage: redacted texts are scanned again until nothing is found.
SCANS = 4


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids``; rows with a null id stay, rows that share an id go together."""
    ids = materialise(ids.select("doc_id").distinct(), "rejected")
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), "doc_id", "left_anti").select(*docs.columns)
    return joined_with(docs, ids, "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts to which no language can be given: null ones, those without a letter, those mostly in no learned language.

    The mixture decides: beside the languages chosen for a document stands a uniform model, and the share it takes, less two
    standard errors, must not be above ``MOST_UNLEARNED``. Texts that mix learned languages stay, however long. If no language
    was learned, every document stays. Documents with a null id stay: no decision can name them.
    """
    model = language_id.train(docs.where(F.pmod(crc_of_id(), F.lit(3)) != 1).select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    found = language_id.identify(docs, model)
    return _without(docs, found.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("unlearned") > MOST_UNLEARNED)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays; empty texts and null ids are in no group and stay."""
    return _without(docs, jaccard_join.jaccard_classes(docs).where("class_id <> doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item; null and empty texts, and rows with a null id, stay."""
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def _redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with a marker in the place of what ``found`` (doc_id, blob, found) names; n_chars, if there, follows."""
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    named = docs.withColumn("_text_blob", blob)
    places = found.groupBy("doc_id", "blob").agg(F.min("found").alias("_secrets_found")).select(F.col("doc_id").alias("_path"), F.col("blob").alias("_of"), "_secrets_found")
    on = named["doc_id"].eqNullSafe(F.col("_path")) & (F.col("_text_blob") == F.col("_of"))
    joined = named.join(F.broadcast(places), on, "left") if found.count() <= BROADCAST_ROWS else joined_with(named, places, on, "left")
    text = F.when(F.col("_secrets_found").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("_secrets_found")))
    # named apart: in one list with "text", the lambdas of the second use would see the redacted text
    done = joined.withColumn("_redacted_text", text)
    changed = {"text": F.col("_redacted_text")} | ({"n_chars": F.when(F.col("_secrets_found").isNull(), F.col("n_chars")).otherwise(F.length("_redacted_text")).cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a marker in the place of every secret; no document goes, whatever its id or text.

    Redacted texts are new versions of their paths: they are scanned against the ledger of the scans before, which takes only
    blobs that are not in it, until nothing is found.
    """
    now, ledger = docs, None
    for _ in range(SCANS):
        findings, ledger = secret_scan.scan(now, ledger)
        found = materialise(findings.where("found is not null"), "secrets")
        if not found.limit(1).count():
            return now
        now = materialise(_redacted(now, found), "redacted")
    return now


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces of every document that is left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]

#: Language ID, the join's components and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
