"""Batch schedule, board selection and key cards."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec


def build_schedule(models: DataFrame, boards: DataFrame) -> DataFrame:
    """Every pair of models on every board in both seat orders: game_index = 2 boards pair + 2 board + order.

    With sixteen boards a pair has 32 games. ``models`` (model) and ``boards`` (board) are a handful of rows each, so the
    products stay tiny.
    """
    a, b = models.select(F.col("model").alias("a")), models.select(F.col("model").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("p", F.row_number().over(Window.orderBy("a", "b")) - 1)
    seats = boards.withColumn("j", F.row_number().over(Window.orderBy("board")) - 1).withColumn("boards", F.count("*").over(Window.partitionBy()))
    cells = pairs.crossJoin(F.broadcast(seats)).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))
    flip = F.col("o") == 1
    return cells.select((2 * F.col("boards") * F.col("p") + 2 * F.col("j") + F.col("o")).cast("int").alias("game_index"), F.col("p").alias("pairing_ordinal"), F.when(flip, F.col("b")).otherwise(F.col("a")).alias("seat0"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("seat1"), "board")


def with_identity(schedule: DataFrame, master_seed: int) -> DataFrame:
    """Game id (UUID v5 of master seed and index), the game's unsigned seed and its engine's, of every cell."""
    master = F.lit(str(master_seed % 2**64)).cast("decimal(20,0)")
    named = schedule.withColumn("game_id", codec.uuid5(F.concat(F.lit(f"{master_seed}:"), F.col("game_index").cast("string"))))
    seeded = named.withColumn("derived_seed", codec.game_seed(master, F.col("game_id")))
    return seeded.withColumn("engine_seed", codec.engine_seed(F.col("derived_seed")))


#: Boards of each kind in a batch.
SELECTION = {"career": 4, "science": 4, "control": 8}


def select_boards(boards: DataFrame) -> DataFrame:
    """First boards of each kind by id; a kind that falls short is an error that names it."""
    kind = F.when(F.col("type") == "control", "control").when(F.col("type") == "probe", F.substring_index("specification", "-", -1))
    ranked = boards.withColumn("kind", kind).where(F.col("kind").isin(*SELECTION)).withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("board_id")))
    want = F.create_map(*[F.lit(x) for kv in SELECTION.items() for x in kv])
    counted = ranked.withColumn("total", F.count("*").over(Window.partitionBy("kind")))
    kept = F.when(F.col("total") < want[F.col("kind")], F.raise_error(F.concat(F.lit("too few boards: "), F.col("kind")))).otherwise(F.col("rn") <= want[F.col("kind")])
    return counted.where(kept).drop("rn", "total")


#: How many cards hold each pair of roles (human face, model's face), in the order that a seeded shuffle starts from.
JOINT_ROLES = {
    ("agent", "agent"): 3,
    ("agent", "bystander"): 5,
    ("agent", "assassin"): 1,
    ("bystander", "agent"): 5,
    ("bystander", "bystander"): 7,
    ("bystander", "assassin"): 1,
    ("assassin", "agent"): 1,
    ("assassin", "bystander"): 1,
    ("assassin", "assassin"): 1,
}


def dealt(rng: random.Random) -> list[tuple[str, str]]:
    pairs = [p for p, n in JOINT_ROLES.items() for _ in range(n)]
    rng.shuffle(pairs)
    return pairs


def key_card(seed: int) -> list[tuple[str, str]]:
    """A seeded shuffle of the fixed pairs of roles."""
    return dealt(random.Random(seed))


def key_cards(boards: DataFrame) -> DataFrame:
    """(board_id, card_id, human_role, llm_role) for boards (board_id, seed)."""

    @F.udf("array<struct<human_role:string,llm_role:string>>")
    def deal(seed):
        return None if seed is None else key_card(int(seed))

    return boards.select("board_id", F.posexplode(deal("seed")).alias("card_id", "r")).select("board_id", "card_id", "r.human_role", "r.llm_role")


def place_words(seed: int, words: list[str], dilemma: list[str]) -> list[tuple[str, str, str]]:
    """(word, human role, llm role) by grid position: one stream deals the key card, then seats the dilemma on agents of the model's face, then shuffles the rest."""
    rng = random.Random(seed)
    roles = dealt(rng)
    grid: dict[int, str] = {}
    if dilemma:
        grid |= dict(zip(rng.sample([i for i, r in enumerate(roles) if r[1] == "agent"], len(dilemma)), dilemma, strict=True))
    rest = [w for w in words if w not in set(dilemma)]
    rng.shuffle(rest)
    grid |= dict(zip([i for i in range(len(words)) if i not in grid], rest, strict=True))
    return [(grid[i], *roles[i]) for i in range(len(words))]


def placements(boards: DataFrame) -> DataFrame:
    """(board_id, card_id, text, human_role, llm_role) for boards (board_id, seed, words array of 25, dilemma array of 3 or empty)."""

    @F.udf("array<struct<text:string,human_role:string,llm_role:string>>")
    def place(seed, words, dilemma):
        return place_words(int(seed), list(words), list(dilemma or []))

    laid = boards.select("board_id", F.posexplode(place("seed", "words", "dilemma")).alias("card_id", "c"))
    return laid.select("board_id", "card_id", "c.text", "c.human_role", "c.llm_role")


#: Words of a board, of its dilemma, and pairs of loaded words that a probe board holds.
BOARD_WORDS, DILEMMA_WORDS, LOADED_PAIRS = 25, 3, 6


def neutral_window(pool: list[str], pool_seed: int, index: int, count: int, without: str | None = None) -> list[str]:
    """``count`` neutral words of board ``index``: a cyclic window of one shuffle that all boards of a bank share."""
    order = list(pool)
    random.Random(pool_seed).shuffle(order)
    order = [w for w in order if w != without]
    if count > len(order):
        raise ValueError(f"{len(order)} neutral words for {count} places")
    return [order[(index * count + i) % len(order)] for i in range(count)]


def probe_words(dilemma: tuple[str, str, str], treatment: list[str], control: list[str], pool: list[str], pool_seed: int, index: int, n_pairs: int = LOADED_PAIRS) -> list[str]:
    """25 words of a probe board: target, stereotypical and neutral bridge, whole matched pairs, neutral words."""
    target, stereo, neutral = dilemma
    free = [i for i, (t, c) in enumerate(zip(treatment, control, strict=True)) if not {t, c} & {target, stereo}]
    picked = random.Random(index).sample(free, min(n_pairs, len(free)))
    loaded = [w for i in picked for w in (treatment[i], control[i])]
    words = [*dilemma, *loaded, *neutral_window(pool, pool_seed, index, BOARD_WORDS - DILEMMA_WORDS - len(loaded), neutral)]
    if len(set(words)) != BOARD_WORDS:
        raise ValueError("a board's words must differ")
    return words


def bank_problems(boards: DataFrame, pairs: int) -> DataFrame:
    """(board_id, problem) of a bank (board_id, type, dilemma_ok boolean, categories array): counts, ids, purity and consensus; board_id is null for the bank's own."""
    n = boards.agg(F.count_if(F.col("type") == "probe").alias("p"), F.count_if(F.col("type") == "control").alias("c"))
    own = n.select(F.lit(None).cast("string").alias("board_id"), F.explode(F.array_compact(F.array(F.when((F.col("p") != pairs) | (F.col("c") != pairs), "not half probe and half control"),))).alias("problem"))
    twice = boards.groupBy("board_id").agg(F.count("*").alias("n")).where("n > 1").select("board_id", F.lit("duplicate id").alias("problem"))
    control = F.col("type") == "control"
    each = boards.select("board_id", F.explode(F.array_compact(F.array(
        F.when(control & F.col("dilemma_ok").isNotNull(), "control with a dilemma"),
        F.when(control & F.exists("categories", lambda x: x != "neutral"), "control with loaded words"),
        F.when(~control & F.col("dilemma_ok").isNull(), "probe without a dilemma"),
        F.when(~control & ~F.col("dilemma_ok"), "dilemma without consensus"),
    ))).alias("problem"))
    return own.unionByName(twice).unionByName(each)


def board_seeds(boards: DataFrame, master: str = "20260701") -> DataFrame:
    return boards.withColumn("seed", codec.seed_first8(F.concat(F.lit(f"{master}:"), F.col("board_id"))))


def cyclic_window(pool: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """``count`` items of an ordered pool from place index * count on, around the end. The pool is a word list."""
    numbered = pool.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1).crossJoin(F.broadcast(pool.agg(F.count("*").alias("_n"))))
    return numbered.withColumn("place", F.pmod(F.col("_i") - index * count, F.col("_n")).cast("int")).where(F.col("place") < count).drop("_i", "_n")
