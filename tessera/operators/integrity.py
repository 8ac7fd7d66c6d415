"""Declared constraints as queries: references, keys, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row (reference, orphans): child rows whose key no parent has; null keys are not orphans.

    Child keys collapse to counts before the join.
    """
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")).select(F.lit(name).alias("reference"), "orphans")


def duplicates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row (relation, violations): keys held by more than one row."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return many.agg(F.count("*").alias("violations")).select(F.lit(name).alias("relation"), "violations")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, in one pass; a null condition is no violation, as in SQL."""
    one = rows.agg(*[F.count_if(~c).alias(k) for k, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def board_problems(boards: DataFrame) -> DataFrame:
    """(board_id, problem) of boards with cards array<struct<text, llm_perspective_role, human_perspective_role>>.

    Rules: 25 distinct words; nine agents a face, three shared; three assassins a face, one shared; one card each way
    that is an assassin on one face and an agent on the other.
    """
    n = lambda cond: F.size(F.filter("cards", cond))
    a, b = "llm_perspective_role", "human_perspective_role"
    rules = {
        "words": F.size(F.array_distinct(F.transform("cards", lambda c: F.lower(c["text"])))) == 25,
        "agents": (n(lambda c: c[a] == "agent") == 9) & (n(lambda c: c[b] == "agent") == 9) & (n(lambda c: (c[a] == "agent") & (c[b] == "agent")) == 3),
        "assassins": (n(lambda c: c[a] == "assassin") == 3) & (n(lambda c: c[b] == "assassin") == 3) & (n(lambda c: (c[a] == "assassin") & (c[b] == "assassin")) == 1),
        "cross": (n(lambda c: (c[a] == "assassin") & (c[b] == "agent")) == 1) & (n(lambda c: (c[a] == "agent") & (c[b] == "assassin")) == 1),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in rules.items()]))
    return boards.select("board_id", F.explode(found).alias("problem"))
