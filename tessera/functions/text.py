"""Scalar rules on words, ids, errors and replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stratum_of(specification: Column, default: str) -> Column:
    """Last part after a hyphen; a missing specification has a default that differs by metric."""
    return F.when(F.coalesce(specification, F.lit("")) == "", F.lit(default)).otherwise(F.substring_index(specification, "-", -1))


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def usable(x: Column) -> Column:
    """Neither null nor non-finite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """Name of the first rule of which the lower-cased text holds a word."""
    low = F.lower(text)
    chain = None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(other)


def strip_fence(text: Column) -> Column:
    """JSON fences of Markdown are unwrapped where they stand; what is around them stays, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```json(.*?)```", "$1"), r"^\s+|\s+$", "")


def normalise_digest(digest: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(digest)), "^sha256[:-]", "")


def model_id(provider: Column, model: Column) -> Column:
    return F.concat_ws(":", provider, model)


def split_model_id(spec: Column) -> tuple[Column, Column]:
    """Provider and model around the first colon."""
    parts = F.split(spec, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def lineage_key(model: Column) -> Column:
    """The model family: what stands before the first hyphen of the last path part, in lower case."""
    return F.lower(F.get(F.split(F.element_at(F.split(model, "/"), -1), "-"), F.lit(0)))


def word_flags(word: Column, seeds: list[str], suffixes: list[str]) -> Column:
    """struct(seed, suffix): membership in a list, and a suffix that is not the whole word."""
    low = F.lower(F.trim(word))
    suffix = reduce(lambda a, b: a | b, [F.endswith(low, F.lit(s)) & (F.length(low) > len(s)) for s in suffixes], F.lit(False))
    return F.struct(low.isin(*seeds).alias("seed"), suffix.alias("suffix"))


def _component(part: Column, whole: Column, english: Column | None) -> Column:
    """Whether ``whole`` is ``part`` with a known word before or behind it; any rest counts if no words are given."""
    known = (lambda rest: F.lit(True)) if english is None else (lambda rest: F.array_contains(english, rest))
    n = F.length(part)
    behind, before = F.startswith(whole, part) & known(F.substring(whole, n + 1, F.length(whole))), F.endswith(whole, part) & known(F.substring(whole, F.lit(1), F.length(whole) - n))
    return (n > 0) & (n < F.length(whole)) & (behind | before)


def clue_problem(clue: Column, board: Column, history: Column, lemmas_clue: Column, lemmas_board: Column, english: Column | None = None) -> Column:
    """Why a clue is not legal: on the board, repeated (case-sensitive), same lemma, part of a board word in any of its forms, around one; null if legal.

    ``board`` holds the visible words and ``lemmas_board`` their lemmas, in lower case; ``english`` the words that make a rest a word.
    """
    low = F.lower(F.trim(clue))
    forms = F.array_union(F.coalesce(lemmas_clue, F.expr("cast(array() as array<string>)")), F.array(low))
    part = F.exists(board, lambda w: F.exists(forms, lambda f: _component(f, w, english)))
    around = F.exists(board, lambda w: _component(w, low, english))
    return F.when(F.array_contains(board, low), "on_board").when(F.array_contains(history, clue), "repeated").when(F.arrays_overlap(lemmas_clue, lemmas_board), "lemma").when(part, "component").when(around, "compound")


#: Fixed value: what marks a digest that no registry knows.
UNAVAILABLE = ("", "unknown", "unavailable")


def digest_gate(pinned: Column, served: Column) -> Column:
    """The served digest if it equals the pinned one; one that is missing, unknown or another is an error."""
    p, s = normalise_digest(F.coalesce(pinned, F.lit(""))), normalise_digest(F.coalesce(served, F.lit("")))
    return F.when(p.isin(*UNAVAILABLE) | s.isin(*UNAVAILABLE), F.raise_error(F.lit("digest not available"))).when(p != s, F.raise_error(F.concat(F.lit("digest mismatch: "), p, F.lit(" "), s))).otherwise(s)


def names_evaluated(model: Column, evaluated: list[str]) -> Column:
    """Whether an arbiter's id holds the name of an evaluated model."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(model), F.lit(e.lower())) for e in evaluated], F.lit(False))


def degenerate_reason(words: Column, clue: Column, count: Column) -> Column:
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, "empty_list").when(F.trim(F.coalesce(clue, F.lit(""))) == "", "blank_clue").when(count < 1, "count_below_one")


#: Outcome and the role that ended the game.
RESULT_ROLES = {"victory": "agent", "victory_sd": "agent", "loss_assassin": "assassin", "loss_assassin_sd": "assassin", "loss_civilian_sd": "civilian"}
WINS = ("victory", "victory_sd")


def result_role(result: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RESULT_ROLES.items() for x in kv])
    return F.coalesce(m[result], F.raise_error(F.concat(F.lit("unknown result "), F.coalesce(result, F.lit("NULL")))))


def is_win(result: Column) -> Column:
    return result.isin(*WINS)
