"""Skill on control boards from the log: wins (TV), accuracy of guesses (PA), agents per clue (EP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import inference
from ..operators.staging import staged
from . import log as L


def games(log: L.Log, master_seed: int) -> DataFrame:
    """(game_id, result, win) of completed games on control boards."""
    own = L.completed_games(log, master_seed).join(log["board"].where(F.col("type") == L.CONTROL).select("board_id"), "board_id", "left_semi")
    return own.select("game_id", "result", F.coalesce(text.is_win(F.col("result")), F.lit(False)).alias("win"))


def results(games_: DataFrame) -> DataFrame:
    return games_.groupBy(F.coalesce("result", F.lit("<NULL>")).alias("result")).agg(F.count("*").alias("n_games"))


def played_cards(log: L.Log, games_: DataFrame) -> DataFrame:
    """(game_id, model, agent) of play items on normal turns that met a reveal, under the guesser's model."""
    turns = log["turn"].where(F.col("phase") == L.NORMAL).select("turn_id", "game_id").join(games_.select("game_id"), "game_id", "left_semi")
    props = log["guess_proposal"].where(F.col("kind") == L.PLAY).select("guess_proposal_id", "turn_id", F.col("guesser_seat").alias("seat_index")).join(turns, "turn_id")
    items = log["guess_proposal_item"].where("reveal_event_id is not null").select("guess_proposal_id", F.col("reveal_event_id").alias("id"))
    met = props.join(items, "guess_proposal_id").join(log["reveal_event"].select("id", (F.col("result_role") == "agent").alias("agent")), "id")
    return met.join(L.seats(log), ["game_id", "seat_index"]).select("game_id", "model", "agent")


def clues_given(log: L.Log, games_: DataFrame) -> DataFrame:
    """(game_id, model, agents) of normal clues with the agents revealed on their turn, 0 if none."""
    turns = log["turn"].where(F.col("phase") == L.NORMAL).select("turn_id", "game_id", F.col("clue_giver_seat").alias("seat_index")).join(games_.select("game_id"), "game_id", "left_semi")
    agents = log["reveal_event"].where("result_role = 'agent'").groupBy("turn_id").agg(F.count("*").alias("agents"))
    given = turns.join(log["clue"].select("turn_id"), "turn_id").join(L.seats(log), ["game_id", "seat_index"])
    return given.join(agents, "turn_id", "left").select("game_id", "model", F.coalesce("agents", F.lit(0)).alias("agents"))


def intervals(log: L.Log, master_seed: int, replicates: int = inference.REPLICATES) -> DataFrame:
    """(metric, key, name, ...): tv by pairing (the two models in order) and by model on any seat, pa and ep by model; each key draws from its own games."""
    own = games(log, master_seed)
    seated = own.select("game_id", "win").join(L.seats(log), "game_id")
    pairing = seated.groupBy("game_id").agg(F.array_join(F.array_sort(F.collect_list("model")), " + ").alias("key"), F.max(F.col("win").cast("int")).alias("num"))
    model = seated.select("game_id", F.col("model").alias("key"), F.col("win").cast("int").alias("num")).distinct()
    pa = played_cards(log, own).groupBy("game_id", F.col("model").alias("key")).agg(F.count_if("agent").alias("num"), F.count("*").alias("den"))
    ep = clues_given(log, own).groupBy("game_id", F.col("model").alias("key")).agg(F.sum("agents").alias("num"), F.count("*").alias("den"))
    parts = [(pairing.withColumn("den", F.lit(1)), "tv_pairing", "tv"), (model.withColumn("den", F.lit(1)), "tv_model", "tv"), (pa, "pa", "pa"), (ep, "ep", "ep")]
    sums = None
    for rows, metric, cell in parts:
        one = rows.select(F.lit(metric).alias("metric"), "key", F.lit(cell).alias("cell"), "game_id", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den"))
        sums = one if sums is None else sums.unionByName(one)
    sums = staged(sums, "skill-sums")
    return inference.cluster_bootstrap(sums, sums.select("metric", "key", "game_id"), "game_id", ("metric", "key"), ["tv", "pa", "ep"], replicates)


def diagnostics(log: L.Log, master_seed: int) -> DataFrame:
    """Per model: games, clues, played cards, agents among them, agents revealed on own clues."""
    own = games(log, master_seed)
    n = own.join(L.seats(log), "game_id").groupBy("model").agg(F.countDistinct("game_id").alias("n_games"))
    cards = played_cards(log, own).groupBy("model").agg(F.count("*").alias("n_played_cards"), F.count_if("agent").alias("n_agent_cards"))
    given = clues_given(log, own).groupBy("model").agg(F.count("*").alias("n_clues"), F.sum("agents").alias("n_agents_on_own_clues"))
    return n.join(cards, "model", "left").join(given, "model", "left").na.fill(0)
