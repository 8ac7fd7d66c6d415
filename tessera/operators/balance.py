"""Covariate balance: effect sizes, association, propensity matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_group(rows: DataFrame, treated: Column, value: str, *by: str) -> DataFrame:
    """Counts, means and sample variances of the two groups per key."""
    a, b = F.when(treated, F.col(value)), F.when(~treated, F.col(value))
    return rows.groupBy(*by).agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")
    )


def effect_sizes(stats: DataFrame, *by: str, decimals: int = 6) -> DataFrame:
    """smd (root of the mean variance, which is also the simply pooled deviation) and cohen_d (n-weighted pooled); null for groups under two or without spread."""
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2)
    diff = F.col("ma") - F.col("mb")
    mean_var = (F.col("va") + F.col("vb")) / 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0))
    smd = F.when(ok & (mean_var > 0), diff / F.sqrt(mean_var))
    d = F.when(ok & (pooled > 0), diff / F.sqrt(pooled))
    return stats.select(*by, "na", "nb", F.round(smd, decimals).alias("smd"), F.round(d, decimals).alias("cohen_d"))


def cramers_v(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row, column v: chi-square over observed levels, empty cells included; null with fewer than two levels of either."""
    cells = rows.groupBy(x, y).agg(F.count("*").alias("o"))
    nx, ny = cells.groupBy(x).agg(F.sum("o").alias("nx")), cells.groupBy(y).agg(F.sum("o").alias("ny"))
    grid = nx.crossJoin(ny).join(cells, [x, y], "left").crossJoin(cells.agg(F.sum("o").alias("n")))  # levels, not rows
    e = F.col("nx") * F.col("ny") / F.col("n")
    s = grid.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, F.lit(2)) / e).alias("chi2"), F.countDistinct(x).alias("r"), F.countDistinct(y).alias("c"), F.max("n").alias("n"))
    k = F.least("r", "c") - 1
    return s.select(F.when(k > 0, F.round(F.sqrt(F.col("chi2") / F.col("n") / F.nullif(k, F.lit(0))), 6)).alias("v"))


def pearson(x: str, y: str) -> Column:
    """Correlation; null for fewer than two rows or without spread."""
    return F.when(F.count(F.col(x) + F.col(y)) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def mann_whitney_u(rows: DataFrame, treated: str, value: str, *by: str) -> DataFrame:
    """U of the treated group with average ranks."""
    from pyspark.sql import Window

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"), F.count_if(F.col(treated)).alias("ct"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("r", F.coalesce(F.sum("c").over(w), F.lit(0)) + (F.col("c") + 1) / 2)  # one row per distinct value
    out = ranked.groupBy(*by).agg(F.sum(F.col("r") * F.col("ct")).alias("rank_sum"), F.sum("ct").alias("na"), F.sum(F.col("c") - F.col("ct")).alias("nb"))
    return out.select(*by, "na", "nb", (F.col("rank_sum") - F.col("na") * (F.col("na") + 1) / 2).alias("u"))


def propensity(features: np.ndarray, treated: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Probabilities of an L2 logistic model on features standardised by population deviation (Newton; free intercept)."""
    sd = features.std(0)
    x = np.column_stack((np.ones(len(features)), (features - features.mean(0)) / np.where(sd > 0, sd, 1)))
    w, pen = np.zeros(x.shape[1]), np.ones(x.shape[1]) / c
    pen[0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-12 * np.eye(len(w)), x.T @ (p - treated) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return 1 / (1 + np.exp(-x @ w))


def caliper_match(logit_minor: list[float], logit_major: list[float], caliper: float) -> list[tuple[int, int]]:
    """Greedy nearest pairs without replacement, the minority in order; ties take the lowest index; beyond the caliper nothing."""
    free = set(range(len(logit_major)))
    out = []
    for i, x in enumerate(logit_minor):
        near = min(free, key=lambda j: (abs(logit_major[j] - x), j), default=None)
        if near is not None and abs(logit_major[near] - x) <= caliper:
            free.remove(near)
            out.append((i, near))
    return out


def _matched(pool: pd.DataFrame, caliper_sd: float):
    """(pool in order, logits, places of the pairs, words that no partner was near enough for, words beyond the smaller group, imputed frequencies)."""
    pool = pool.sort_values("text").reset_index(drop=True)
    floor = pool.freq.min()
    x = np.column_stack((pool.freq.fillna(0.0 if pd.isna(floor) else floor), pool.length, pool.polysemy)).astype(float)
    p = np.clip(propensity(x, pool.treated.to_numpy(float)), 1e-12, 1 - 1e-12)
    logit = np.log(p / (1 - p))
    a, b = np.flatnonzero(pool.treated), np.flatnonzero(~pool.treated.astype(bool))
    minor, major = (a, b) if len(a) <= len(b) else (b, a)
    pairs = [(int(minor[i]), int(major[j])) for i, j in caliper_match(logit[minor].tolist(), logit[major].tolist(), caliper_sd * logit.std())]
    return pool, logit, pairs, len(minor) - len(pairs), len(major) - len(minor), int(pool.freq.isna().sum())


def match_by(words: DataFrame, caliper_sd: float = 0.2) -> DataFrame:
    """Matched pairs per specification: words hold specification, text, treated, freq, length, polysemy.

    Missing frequencies take the pool's smallest one. A pool is one specification's words (a hundred or so), so it fits a task.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        own, logit, pairs, *_ = _matched(pool, caliper_sd)
        return pd.DataFrame([(own.specification[0], own.text[i], own.text[j], abs(logit[i] - logit[j])) for i, j in pairs], columns=["specification", "minor", "major", "gap"])

    return words.groupBy("specification").applyInPandas(run, "specification string, minor string, major string, gap double")


def match_report(words: DataFrame, caliper_sd: float = 0.2) -> DataFrame:
    """(specification, pairs, caliper_drops, excess, imputed) of ``match_by``: what stayed out, and why."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        own, _, pairs, drops, excess, imputed = _matched(pool, caliper_sd)
        return pd.DataFrame([(own.specification[0], len(pairs), drops, excess, imputed)], columns=["specification", "pairs", "caliper_drops", "excess", "imputed"])

    return words.groupBy("specification").applyInPandas(run, "specification string, pairs long, caliper_drops long, excess long, imputed long")


def logit(p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return math.log(p / (1 - p))
