"""Writes with the reference's guarantees: insert if absent, cascade delete, board files, game flush."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(rows: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new, one each, and one row (inserted, skipped)."""
    distinct = rows.dropDuplicates(keys)
    new = distinct.join(existing.select(*keys), keys, "left_anti")
    counts = distinct.agg(F.count("*").alias("n")).crossJoin(new.agg(F.count("*").alias("inserted"))).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))  # single rows
    return new, counts


def ingest_frame(new: DataFrame, stored: DataFrame, identity: list[str], key: str = "frame_id") -> DataFrame:
    """New rows of content-addressed frames; a stored frame of the same id but another identity is an error."""
    mine = F.struct(*identity)
    theirs = F.struct(*[F.col(f"_{c}").alias(c) for c in identity])
    joined = new.join(stored.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in identity], F.lit(True).alias("_stored")), key, "left")
    stale = F.when(F.col("_stored") & ~mine.eqNullSafe(theirs), F.raise_error(F.concat(F.lit("stale frame "), F.col(key)))).otherwise(F.coalesce("_stored", F.lit(False)))
    return joined.where(~stale).select(*new.columns)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each table before and after rows that hold a doomed key are gone; deleting again changes nothing."""
    ids = doomed.select(F.col(key).alias("_doomed")).distinct()
    return {name: (rows, rows.join(ids, F.col(col) == F.col("_doomed"), "left_anti")) for name, (rows, col) in tables.items()}


#: Which table refers to which, and by what column: deleting a run deletes down these.
REFERENCES = (
    ("game", "run_id", "run", "run_id"), ("game_seat", "game_id", "game", "game_id"), ("turn", "game_id", "game", "game_id"), ("llm_call", "game_id", "game", "game_id"),
    ("clue", "turn_id", "turn", "turn_id"), ("clue_target", "clue_id", "clue", "clue_id"), ("reveal_event", "turn_id", "turn", "turn_id"),
    ("guess_proposal", "turn_id", "turn", "turn_id"), ("guess_proposal_item", "guess_proposal_id", "guess_proposal", "guess_proposal_id"),
)


def delete_run(tables: dict[str, DataFrame], run_id: str) -> tuple[int, dict[str, DataFrame]]:
    """How many games a run has, and every table without the run and what hangs on it; a run that is not there changes nothing."""
    doomed = {"run": tables["run"].where(F.col("run_id") == run_id).select("run_id")}
    left = dict(tables) | {"run": tables["run"].where(~F.col("run_id").eqNullSafe(F.lit(run_id)))}
    for child, column, parent, key in REFERENCES:
        if child in tables:
            ids = doomed[parent].select(F.col(key).alias(column)).distinct()
            doomed[child] = tables[child].join(ids, column, "left_semi")
            left[child] = tables[child].join(ids, column, "left_anti").select(*tables[child].columns)
    return doomed["game"].count() if "game" in doomed else 0, left


def mint_run(spark, run_id: str, master_seed: int, temperature: float | None, snapshot: dict, templates: dict[str, str], notes: str | None = None) -> DataFrame:
    """One row of the run table: seed unsigned, registry snapshot as JSON, version of the prompts by their fingerprint."""
    import json

    from ..functions import codec

    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(str(master_seed % 2**64)).cast("decimal(20,0)").alias("master_seed"), F.lit(temperature).cast("double").alias("temperature"), F.lit(None).cast("string").alias("regime_label"), F.lit(None).cast("string").alias("code_version"),
        F.lit(codec.fingerprint(templates)).alias("prompt_template_version"), F.lit(json.dumps(snapshot, sort_keys=True)).alias("model_registry_snapshot"), F.current_timestamp().alias("created_at"), F.lit(notes).cast("string").alias("notes"),
    )
    return row


def board_documents(cards: DataFrame, boards: DataFrame) -> DataFrame:
    """(board_id, json): board files, card texts upper-cased and bystanders named civilians, with source, sets and covariates where the cards have them; 25 cards a board."""
    role = lambda c: F.when(F.col(c) == "bystander", "civilian").otherwise(F.col(c)).alias(c)
    more = [c for c in ("source", "weat_set") if c in cards.columns]
    measured = [c for c in ("subtlex_freq", "length", "wordnet_polysemy") if c in cards.columns]
    card = F.struct(F.col("card_id").alias("id"), F.upper("text").alias("text"), role("human_perspective_role"), role("llm_perspective_role"), "category", *more, *([F.struct(*measured).alias("covariates")] if measured else []))
    grouped = cards.groupBy("board_id").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    return boards.join(grouped, "board_id").select("board_id", F.to_json(F.struct(*boards.columns, "cards")).alias("json"))


def seal(boards: DataFrame, frame_id: str, col: str = "measurement_frame_id") -> DataFrame:
    """Boards that name their frame; sealing twice is harmless, sealing with another frame is an error."""
    clash = F.col(col).isNotNull() & (F.col(col) != frame_id)
    return boards.withColumn(col, F.when(clash, F.raise_error(F.concat(F.lit("sealed with "), F.col(col)))).otherwise(F.lit(frame_id)))


def game_tables(games: DataFrame) -> dict[str, DataFrame]:
    """Child tables of one nested game record each: the record is the unit of commit, the rest is derived.

    ``games`` hold game_id, board_id, seats, turns (turn_number, clue_giver_seat, phase, clue, reveals, proposals with
    kind, guesser_seat and items). Items of play proposals are linked to reveals by their place.
    """
    turns = games.select("game_id", "board_id", F.explode("turns").alias("t"))
    base = ["game_id", F.col("t.turn_number").alias("turn_number")]
    proposals = turns.select(*base, "board_id", F.col("t.phase").alias("phase"), F.posexplode("t.proposals").alias("proposal", "p"))
    items = proposals.select("game_id", "turn_number", "board_id", "phase", "proposal", "p.kind", "p.guesser_seat", F.posexplode("p.items").alias("position", "i")).select("*", "i.word", "i.confidence").drop("i")
    return {
        "game": games.drop("seats", "turns"),
        "game_seat": games.select("game_id", F.posexplode("seats").alias("seat_index", "model_ref")),
        "turn": turns.select(*base, "t.clue_giver_seat", "t.phase"),
        "clue": turns.where("t.clue is not null").select(*base, "t.clue.*"),
        "reveal_event": turns.select(*base, "board_id", F.posexplode("t.reveals").alias("position_in_turn", "r")).select("*", "r.*").drop("r"),
        "guess_proposal": proposals.select("game_id", "turn_number", "proposal", "p.kind", "p.guesser_seat"),
        "guess_proposal_item": items,
    }


def link_items(items: DataFrame, reveals: DataFrame, cards: DataFrame) -> DataFrame:
    """Items with resolved_card_id (case-insensitive, null off the board) and the place of their reveal.

    In normal play the n-th item takes the turn's n-th reveal, in sudden death the acting seat's n-th one; measurements take none.
    """
    from pyspark.sql import Window

    per_seat = F.row_number().over(Window.partitionBy("game_id", "turn_number", "acting_seat").orderBy("position_in_turn")) - 1
    r = reveals.withColumn("_nth", per_seat).select("game_id", "turn_number", "position_in_turn", "acting_seat", "_nth").alias("r")
    i = items.alias("i")
    same = (F.col("i.game_id") == F.col("r.game_id")) & (F.col("i.turn_number") == F.col("r.turn_number")) & (F.col("i.kind") == "play")
    place = F.when(F.col("i.phase") == "sudden_death", (F.col("r.acting_seat") == F.col("i.guesser_seat")) & (F.col("r._nth") == F.col("i.position"))).otherwise(F.col("r.position_in_turn") == F.col("i.position"))
    linked = i.join(r, same & place, "left").select("i.*", "r.position_in_turn")
    words = cards.select(F.col("board_id"), F.lower("text").alias("_key"), F.col("card_id").alias("resolved_card_id"))
    return linked.withColumn("_key", F.lower("word")).join(words, ["board_id", "_key"], "left").drop("_key")

