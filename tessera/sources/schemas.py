"""Schemas of the game log, and typed reads of its parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SEED = "decimal(20,0)"
TABLES: dict[str, str] = {
    "run": f"run_id string, master_seed {_SEED}, temperature double, regime_label string, code_version string, prompt_template_version string, model_registry_snapshot string, created_at timestamp, notes string",
    "measurement_frame": "frame_id string, encoder_name string, encoder_revision string, encoder_pooling string, encoder_normalize boolean, gender_axis array<float>, axis_construction string, generator_version string, created_at timestamp",
    "extraction_recipe": "recipe_id string, model_name string, model_revision string, precision string, layer int, pooling string, template string",
    "board": f"board_id string, measurement_frame_id string, type string, category string, specification string, seed {_SEED}, grid_rows short, grid_cols short, arbiters string, dilemma string, keycard_audit string",
    "word_card": "id long, board_id string, card_id int, text string, llm_perspective_role string, human_perspective_role string, category string, source string, weat_set array<string>, subtlex_freq double, length int, wordnet_polysemy int",
    "game": f"game_id string, run_id string, board_id string, derived_seed {_SEED}, start_player int, game_status string, result string, timer_tokens_final int, started_at timestamp, completed_at timestamp",
    "game_seat": "game_id string, seat_index int, model_ref string, provider string, precision string, requested_temperature double, requested_seed decimal(20,0)",
    "turn": "turn_id long, game_id string, turn_number int, clue_giver_seat int, phase string",
    "llm_call": "id long, game_id string, turn_id long, seat_index int, role string, retry_index int, provider string, model_ref string, latency_ms int, prompt_tokens int, completion_tokens int, raw_payload string, rendered_prompt string",
    "clue": "clue_id long, turn_id long, llm_call_id long, clue_word string, count int, reasoning string, targets_raw string",
    "clue_target": "clue_id long, position int, word string, card_id int, giver_role string, revealed_at_clue boolean",
    "reveal_event": "id long, turn_id long, position_in_turn int, card_id int, acting_seat int, result_role string, ended_turn boolean, ended_game boolean, time_marker_placed boolean, timer_tokens_after int",
    "guess_proposal": "guess_proposal_id long, turn_id long, llm_call_id long, guesser_seat int, kind string, reasoning string, stop_reason string",
    "guess_proposal_item": "id long, guess_proposal_id long, position int, word string, confidence double, resolved_card_id int, reveal_event_id long",
    "embedding_mpnet": "frame_id string, text string, kind string, embedding array<float>",
    "embedding_llama": "recipe_id string, text string, embedding array<float>",
    "embedding_mistral": "recipe_id string, text string, embedding array<float>",
    "word_load": "frame_id string, text string, rho double, rho_weat double, computed_at timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A log table with its declared types; unknown names are an error."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """The same table in a live database; with a numeric key and bounds, read in parts."""
    if name not in TABLES:
        raise KeyError(name)
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
