"""A game log made of the driver's tables, in SQL that Spark and DuckDB read alike, so that log queries can be held against SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..flows.log import Log
from ..functions import vectors as v
from ..operators.staging import staged
from .catalogue import read

MASTER, FRAME = 2026, "f1"
#: Loads and similarities are rounded: engines add products in different orders.
DECIMALS = 9
_BASE = ("embeddings", "lineitem", "orders", "supplier")


def _numbers(n: int) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({i})' for i in range(n))}) AS t(i))"


def _role(p: str) -> str:
    return f"CASE WHEN {p} < 9 THEN 'agent' WHEN {p} < 12 THEN 'assassin' ELSE 'civilian' END"


def _word(s: str, c: str) -> str:
    """The word on card ``c`` of board ``s``; four words of the list have no vector."""
    return f"('W' || (({s} * 7 + {c} * 13) % (nw + 4)))"


def _card(s: str, p: str) -> str:
    """The card whose role on the model's face has place ``p``."""
    return f"(({p} + 25 - {s} % 25) % 25)"


_NW, _NB = "(SELECT count(*) AS nw FROM @embeddings)", "(SELECT count(*) AS nb FROM @supplier)"
_TURNS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q FROM @lineitem GROUP BY l_orderkey, l_linenumber)"
#: Lines with the board of their order.
_LINES = f"(SELECT t.*, l_orderkey * 10 + l_linenumber AS turn_id, o_custkey % nb AS s, nw FROM {_TURNS} t JOIN @orders ON o_orderkey = l_orderkey CROSS JOIN {_NB} b CROSS JOIN {_NW} w)"
TABLES: dict[str, str] = {
    "run": "SELECT 'r1' AS run_id, CAST(2026 AS DECIMAL(20, 0)) AS master_seed UNION ALL SELECT 'r2', CAST(7 AS DECIMAL(20, 0))",
    "board": f"""SELECT 'b' || s_suppkey AS board_id, CASE WHEN s_suppkey % 5 < 2 THEN 'control' WHEN s_suppkey % 15 = 4 THEN NULL ELSE 'probe' END AS type,
CASE WHEN s_suppkey % 5 < 2 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'gender-career' ELSE 'gender-science' END AS specification,
CASE WHEN s_suppkey % 5 < 2 OR s_suppkey % 13 = 12 THEN NULL ELSE '{{"target":"' || {_word("s_suppkey", _card("s_suppkey", "0"))} || '","neutral_bridge":"' || {_word("s_suppkey", _card("s_suppkey", "1"))} || '","stereotypical_bridge":"' || {_word("s_suppkey", _card("s_suppkey", "2"))} || '"}}' END AS dilemma
FROM @supplier CROSS JOIN {_NW} w""",
    "word_card": f"""SELECT 'b' || s AS board_id, c AS card_id, {_word("s", "c")} AS text, {_role("((c + s) % 25)")} AS llm_perspective_role, {_role("((c * 7 + s) % 25)")} AS human_perspective_role,
CASE WHEN k % 17 = 0 THEN NULL WHEN k % 3 = 0 THEN 'male' WHEN k % 3 = 1 THEN 'female' ELSE 'neutral' END AS category
FROM (SELECT s_suppkey AS s, i AS c, nw, (s_suppkey * 7 + i * 13) % (nw + 4) AS k FROM @supplier CROSS JOIN {_numbers(25)} n CROSS JOIN {_NW} w) x""",
    "game": f"""SELECT 'g' || o_orderkey AS game_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'r2' ELSE 'r1' END AS run_id, 'b' || (o_custkey % nb) AS board_id, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'completed' END AS game_status,
CASE o_orderkey % 6 WHEN 0 THEN 'victory' WHEN 1 THEN 'victory_sd' WHEN 2 THEN 'loss_civilian_sd' WHEN 3 THEN 'loss_assassin_sd' WHEN 4 THEN 'loss_assassin' END AS result FROM @orders CROSS JOIN {_NB} b""",
    "game_seat": f"SELECT 'g' || o_orderkey AS game_id, i AS seat_index, 'm' || ((o_custkey + i * (1 + o_orderkey % 3)) % 4) AS model_ref FROM @orders CROSS JOIN {_numbers(2)} n",
    "turn": f"SELECT turn_id, 'g' || l_orderkey AS game_id, l_linenumber AS turn_number, l_linenumber % 2 AS clue_giver_seat, CASE WHEN l_linenumber >= 6 THEN 'sudden_death' ELSE 'normal' END AS phase FROM {_LINES} x",
    "clue": f"SELECT turn_id AS clue_id, turn_id, 'W' || (pk % nw) AS clue_word FROM {_LINES} x WHERE q >= 3 AND l_linenumber < 6",
    "clue_target": f"SELECT turn_id AS clue_id, i AS position, {_word('s', _card('s', '((sk + i * 2) % 9)'))} AS word FROM {_LINES} x CROSS JOIN {_numbers(3)} n WHERE q >= 3 AND l_linenumber < 6",
    "reveal_event": f"""SELECT turn_id AS id, turn_id, c AS card_id, 1 - l_linenumber % 2 AS acting_seat, CASE WHEN l_linenumber % 2 = 0 THEN {_role("((c + s) % 25)")} ELSE {_role("((c * 7 + s) % 25)")} END AS result_role, l_linenumber >= 6 AS ended_game
FROM (SELECT *, pk * 3 % 25 AS c FROM {_LINES} y) x""",
    "guess_proposal": f"""SELECT turn_id * 4 + i AS guess_proposal_id, turn_id, CASE WHEN i = 2 THEN l_linenumber % 2 ELSE 1 - l_linenumber % 2 END AS guesser_seat, CASE WHEN i = 0 THEN 'play' ELSE 'measurement' END AS kind
FROM {_LINES} x CROSS JOIN {_numbers(3)} n WHERE i < 2 OR l_linenumber >= 6""",
    "guess_proposal_item": f"""SELECT turn_id * 4 + j AS guess_proposal_id, i AS position, CASE WHEN i = 9 THEN 'zz' || (pk % 3) ELSE {_word("s", "((pk + i * (2 + l_linenumber)) % 25)")} END AS word,
CASE WHEN (pk + i) % 23 = 0 THEN NULL ELSE CAST((pk * 31 + i * 17 + sk * 7) % 20 AS DOUBLE) / 20 END AS confidence, CAST(NULL AS BIGINT) AS reveal_event_id
FROM {_LINES} x CROSS JOIN {_numbers(10)} n CROSS JOIN (SELECT i + 1 AS j FROM {_numbers(2)} m0) m WHERE j = 1 OR l_linenumber >= 6
UNION ALL SELECT turn_id * 4, i, {_word("s", "((pk * 3 + i) % 25)")}, NULL, CASE WHEN i = 0 THEN turn_id END FROM {_LINES} x CROSS JOIN {_numbers(2)} n""",
}


def _named(sql: str, suffix: str) -> str:
    for t in _BASE:
        sql = sql.replace(f"@{t}", t + suffix)
    return sql


class _Standin(Log):
    """Tables that are worked out when they are asked for: all but a few are narrow over the lines, which are written once."""

    def __init__(self, spark, d):
        super().__init__({})
        self._spark, self._d = spark, d
        self._suffix = "_" + hashlib.sha256(d.encode()).hexdigest()[:12]
        for t in _BASE:
            read(spark, d, t).createOrReplaceTempView(t + self._suffix)

    def lines(self) -> None:
        """Writes the lines unless the session has them."""
        if not self._spark.catalog.tableExists(f"lines{self._suffix}"):
            self._lines()

    def _lines(self) -> None:
        # dealt by order, lines are grouped and meet their order without another shuffle
        lines = read(self._spark, self._d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
        lines.createOrReplaceTempView(f"dealt{self._suffix}")
        sql = _named(_LINES.replace("@lineitem", f"dealt{self._suffix}"), self._suffix)
        staged(self._spark.sql(f"SELECT * FROM {sql} x"), "log-lines").createOrReplaceTempView(f"lines{self._suffix}")

    def __getitem__(self, name: str):
        if name not in self._tables:
            self._tables[name] = self._made(name)
        return self._tables[name]

    def _made(self, name: str):
        if name in TABLES:
            if _LINES in TABLES[name]:
                self.lines()
            return self._spark.sql(_named(TABLES[name].replace(_LINES, f"lines{self._suffix}"), self._suffix))
        e = read(self._spark, self._d, "embeddings").select("vec_id", "label", v.doubles("embedding").alias("v")).repartition(6)  # one small file, and work on its vectors
        if name == "embedding_mpnet":
            return staged(e.select(F.lit(FRAME).alias("frame_id"), F.concat(F.lit("W"), F.col("vec_id").cast("string")).alias("text"), v.normalised("v").alias("embedding")), f"log-{name}")
        if name == "measurement_frame":
            return staged(v.axis(e, "v", F.col("label") < 5).select(F.lit(FRAME).alias("frame_id"), F.col("axis").alias("gender_axis")), f"log-{name}")
        raise KeyError(name)


_MADE: dict[tuple[str, str], Log] = {}


def standin(spark, d) -> Log:
    """The log over the tables in ``d``, one for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE:
        _MADE[key] = _Standin(spark, d)
    return _MADE[key]


#: The same tables as common table expressions, with words' unit vectors (w), loads (ld), completed games of the run (cg) and typed boards (tb).
CTES = ",\n".join(f"{name} AS MATERIALIZED ({_named(sql, '')})" for name, sql in TABLES.items()) + f""",
e0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x0 AS (SELECT label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e0),
a0 AS (SELECT list(dx ORDER BY i) AS d FROM (SELECT i, avg(x) FILTER (label < 5) - avg(x) FILTER (label >= 5) AS dx FROM x0 GROUP BY i)),
w AS MATERIALIZED (SELECT 'w' || vec_id AS word, list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS v FROM e0),
ld AS MATERIALIZED (SELECT word, round(list_dot_product(v, list_transform(d, lambda z: z / sqrt(list_dot_product(d, d)))), {DECIMALS}) AS rho FROM w CROSS JOIN a0),
cg AS MATERIALIZED (SELECT game_id, board_id, result FROM game JOIN run USING (run_id) WHERE master_seed = {MASTER} AND game_status = 'completed'),
tb AS MATERIALIZED (SELECT board_id, type AS board_type, coalesce(split_part(specification, '-', -1), 'unknown') AS stratum FROM board WHERE type IN ('probe', 'control')),
cd AS MATERIALIZED (SELECT board_id, card_id, lower(text) AS word, category, llm_perspective_role AS r0, human_perspective_role AS r1 FROM word_card),
tg AS MATERIALIZED (SELECT DISTINCT turn_id, lower(word) AS word FROM clue JOIN clue_target USING (clue_id))"""
