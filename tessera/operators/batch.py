"""Batches of scheduled games: consecutive failures, abort, what is skipped, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcomes(games: DataFrame, unit: str, order: str, ok: str, limit: int) -> DataFrame:
    """``games`` with streak (failures in a row up to here) and status: completed, errored, or skipped after ``limit`` failures in a row of its unit."""
    so_far = Window.partitionBy(unit).orderBy(order)
    runs = games.withColumn("_won", F.count_if(F.col(ok)).over(so_far))
    streaks = runs.withColumn("streak", F.count_if(~F.col(ok)).over(Window.partitionBy(unit, "_won").orderBy(order)))
    end = F.min(F.when(F.col("streak") >= limit, F.col(order))).over(Window.partitionBy(unit))
    status = F.when(F.col(order) > end, "skipped").when(F.col(ok), "completed").otherwise("errored")
    return streaks.withColumn("status", status).withColumn("streak", F.when(F.col("status") != "skipped", F.col("streak"))).drop("_won")


def report(judged: DataFrame, unit: str) -> DataFrame:
    """Per unit: scheduled, attempted, completed, errored, skipped, and whether it was aborted."""
    n = lambda s: F.count_if(F.col("status") == s)
    return judged.groupBy(unit).agg(F.count("*").alias("scheduled"), (F.count("*") - n("skipped")).alias("attempted"), n("completed").alias("completed"), n("errored").alias("errored"), n("skipped").alias("skipped"), (n("skipped") > 0).alias("aborted"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are wanted and not there."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def pool(words: DataFrame, target: str, congruent: bool) -> DataFrame:
    """Candidates to bridge to a target word: neutral words, or those of the target's category; the target itself never."""
    own = words.where(F.lower("word") == target.lower()).select(F.col("category").alias("_c")).distinct()
    rest = words.where(F.lower("word") != target.lower())
    return rest.join(own, F.col("category") == F.col("_c"), "left_semi") if congruent else rest.where("category = 'neutral'")


def thin(rows: DataFrame, k: int) -> DataFrame:
    """One row (size, thin): whether a pool has fewer than ``k`` words."""
    return rows.agg(F.count("*").alias("size")).select("size", (F.col("size") < k).alias("thin"))


def backoff(calls: DataFrame, base: float = 15.0, retries: int = 3) -> DataFrame:
    """``calls`` (retry_index) with the seconds waited before each, base times two to the retry, and whether it is the last that may be."""
    i = F.col("retry_index")
    return calls.withColumn("waited", F.when(i > 0, F.lit(base) * F.pow(F.lit(2.0), i - 1)).otherwise(F.lit(0.0))).withColumn("last", i >= retries)
