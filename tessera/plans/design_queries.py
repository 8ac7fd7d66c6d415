"""Board design and word lists, over the stand-in log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..flows import log as L
from ..functions import vectors as v
from ..operators import design
from .catalogue import query, read
from .standin import CTES, DECIMALS, standin

_FACES = "SELECT board_id, 'llm_perspective_role' AS face, llm_perspective_role AS role, category, text FROM word_card UNION ALL SELECT board_id, 'human_perspective_role', human_perspective_role, category, text FROM word_card"


@query("q_role_counts", f"WITH {CTES}, f AS ({_FACES}) SELECT board_id, face, role, count(*) AS n FROM f GROUP BY ALL")
def role_counts(spark, d):
    return design.role_counts(standin(spark, d)["word_card"])


@query("q_joint_roles", f"WITH {CTES} SELECT board_id, llm_perspective_role, human_perspective_role, count(*) AS n FROM word_card GROUP BY ALL")
def joint_roles(spark, d):
    return design.joint_roles(standin(spark, d)["word_card"])


@query("q_role_gender", f"""
WITH {CTES}, dw AS (SELECT board_id, lower(unnest([json_extract_string(dilemma, '$.target'), json_extract_string(dilemma, '$.neutral_bridge'), json_extract_string(dilemma, '$.stereotypical_bridge')])) AS word FROM board WHERE type = 'probe' AND dilemma IS NOT NULL),
f AS ({_FACES}), k AS (SELECT * FROM f WHERE category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dw WHERE dw.board_id = f.board_id AND dw.word = lower(f.text))),
c AS (SELECT board_id, face, role, category, count(*) AS o FROM k GROUP BY ALL), r AS (SELECT board_id, face, role, sum(o) AS nr FROM c GROUP BY ALL), g AS (SELECT board_id, face, category, sum(o) AS ng FROM c GROUP BY ALL),
n AS (SELECT board_id, face, sum(nr) AS n, count(*) AS lr FROM r GROUP BY ALL), h AS (SELECT board_id, face, count(*) AS lg FROM g GROUP BY ALL),
x AS (SELECT r.board_id, r.face, sum(power(coalesce(o, 0) - nr * ng / n, 2) / (nr * ng / n)) AS chi, max(n) AS n FROM r JOIN g ON g.board_id = r.board_id AND g.face = r.face JOIN n ON n.board_id = r.board_id AND n.face = r.face LEFT JOIN c ON c.board_id = r.board_id AND c.face = r.face AND c.role = r.role AND c.category = g.category GROUP BY ALL),
y AS (SELECT x.board_id, x.face, CASE WHEN least(lr, lg) > 1 THEN sqrt(chi / x.n / (least(lr, lg) - 1)) END AS v FROM x JOIN n USING (board_id, face) JOIN h USING (board_id, face))
SELECT board_id, round(max(v) FILTER (face = 'llm_perspective_role'), 6) AS v_llm, round(max(v) FILTER (face = 'human_perspective_role'), 6) AS v_human, bool_and(coalesce(round(v, 6) < 0.3, true)) AS independent FROM y GROUP BY 1""")
def role_gender(spark, d):
    log = standin(spark, d)
    words = L.dilemma_boards(log).select("board_id", F.explode(F.array("target", "neutral", "stereo")).alias("word"))
    return design.role_gender(L.cards(log), words)


@query("q_frame_words", f"""
WITH {CTES}, b AS (SELECT DISTINCT lower(text) AS word FROM word_card), c AS (SELECT DISTINCT lower(clue_word) AS word FROM clue JOIN turn USING (turn_id) JOIN game USING (game_id) JOIN board USING (board_id))
SELECT coalesce(b.word, c.word) AS word, b.word IS NOT NULL AS on_board, c.word IS NOT NULL AS as_clue, w.word IS NOT NULL AS embedded FROM b FULL JOIN c ON b.word = c.word LEFT JOIN w ON w.word = coalesce(b.word, c.word)""")
def frame_words(spark, d):
    """Distinct words of boards and of clues given on them, and whether the frame has a vector for each."""
    log = standin(spark, d)
    b = L.cards(log).select("word").distinct().withColumn("on_board", F.lit(True))
    games = log["turn"].select("turn_id", "game_id").join(log["game"].select("game_id", "board_id"), "game_id").join(log["board"].select("board_id"), "board_id")
    c = log["clue"].select("turn_id", F.lower("clue_word").alias("word")).join(games, "turn_id").select("word").distinct().withColumn("as_clue", F.lit(True))
    known = log["embedding_mpnet"].select(F.lower("text").alias("word")).distinct().withColumn("embedded", F.lit(True))
    return b.join(c, "word", "full_outer").join(known, "word", "left").na.fill(False)


@query("q_incoherent_boards", f"""
WITH {CTES}, c AS (SELECT board_id, count(*) FILTER (category IN ('male', 'female')) AS poled, count(*) AS n, count(DISTINCT lower(text)) AS ws FROM word_card GROUP BY 1), b AS (SELECT board.*, poled, n, ws FROM board LEFT JOIN c USING (board_id))
SELECT board_id, unnest(list_filter([CASE WHEN type = 'probe' AND dilemma IS NULL THEN 'probe without a dilemma' END, CASE WHEN type = 'probe' AND specification IS NULL THEN 'probe without a specification' END, CASE WHEN type = 'probe' AND coalesce(poled, 0) = 0 THEN 'probe without a poled card' END,
  CASE WHEN type = 'control' AND dilemma IS NOT NULL THEN 'control with a dilemma' END, CASE WHEN type = 'control' AND specification IS NOT NULL THEN 'control with a specification' END, CASE WHEN coalesce(n, 0) <> 25 THEN 'not 25 cards' END, CASE WHEN coalesce(ws, 0) <> coalesce(n, 0) THEN 'words not distinct' END], lambda x: x IS NOT NULL)) AS problem FROM b""")
def incoherent_boards(spark, d):
    log = standin(spark, d)
    return design.incoherent(log["board"], log["word_card"])


@query("q_covariate_verdicts", """
WITH u AS (SELECT p_brand, 'p_size' AS covariate, p_partkey % 3 = 0 AS t, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_brand, 'p_retailprice', p_partkey % 3 = 0, p_retailprice FROM part),
s AS (SELECT p_brand, covariate, count(x) FILTER (t) AS na, count(x) FILTER (NOT t) AS nb, avg(x) FILTER (t) AS ma, avg(x) FILTER (NOT t) AS mb, var_samp(x) FILTER (t) AS va, var_samp(x) FILTER (NOT t) AS vb FROM u GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN na >= 2 AND nb >= 2 AND va + vb > 0 THEN round((ma - mb) / sqrt((va + vb) / 2), 6) END AS smd FROM s)
SELECT p_brand, covariate, smd, coalesce(abs(smd) <= 0.1, false) AS smd_ok FROM e""")
def covariate_verdicts(spark, d):
    """The tests' p values have no SQL; a test holds them against published ones."""
    p = read(spark, d, "part")
    return design.covariate_verdicts(p, F.col("p_partkey") % 3 == 0, ["p_size", "p_retailprice"], "p_brand").select("p_brand", "covariate", "smd", "smd_ok")


@query("q_frequency_oov", f"""
WITH {CTES}, f AS (SELECT 'w' || p_partkey AS word, p_retailprice AS zipf FROM part WHERE p_size < 40)
SELECT c.word, count(*) AS n_cards, max(zipf) AS zipf, max(zipf) IS NULL AS oov FROM cd c LEFT JOIN f ON f.word = c.word GROUP BY 1""")
def frequency_oov(spark, d):
    f = read(spark, d, "part").where("p_size < 40").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"), F.col("p_retailprice").alias("zipf"))
    found, _ = design.frequency_lookup(L.cards(standin(spark, d)), f)
    return found.groupBy("word").agg(F.count("*").alias("n_cards"), F.max("zipf").alias("zipf")).withColumn("oov", F.col("zipf").isNull())


@query("q_axis_diagnostics", f"""
WITH {CTES}, e AS (SELECT vec_id, v FROM e0), mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM x0 GROUP BY i)), ax AS (SELECT list_transform(d, lambda z: z / sqrt(list_dot_product(d, d))) AS a FROM a0),
l AS (SELECT vec_id % 2 = 0 AS male, list_dot_product(v, a) AS raw, list_dot_product(v, a) - list_dot_product(m, a) AS cen FROM e CROSS JOIN ax CROSS JOIN mu),
k AS (SELECT round(corr(raw, cen), 6) AS correlation FROM l), g AS (SELECT 'raw' AS geometry, male, raw AS x FROM l UNION ALL SELECT 'centred', male, cen FROM l)
SELECT geometry, count(*) AS n, round(avg(x) FILTER (male), 6) AS mean_male, round(avg(x) FILTER (NOT male), 6) AS mean_female, round(avg(x) FILTER (male) - avg(x) FILTER (NOT male), 6) AS gap, max(correlation) AS correlation FROM g CROSS JOIN k GROUP BY 1""")
def axis_diagnostics(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", v.doubles("embedding").alias("v"))
    words = e.select("v", F.when(F.col("vec_id") % 2 == 0, "male").otherwise("female").alias("pole"))
    return design.axis_diagnostics(words, v.axis(e, "v", F.col("label") < 5), v.mean_vector(e, "v"))


@query("q_proposal_order", f"WITH {CTES} SELECT guess_proposal_id, position, CAST(row_number() OVER (PARTITION BY guess_proposal_id ORDER BY position) - 1 AS INTEGER) AS place, first_value(lower(word)) OVER (PARTITION BY guess_proposal_id ORDER BY position) = lower(word) AS like_first FROM guess_proposal_item WHERE confidence IS NOT NULL")
def proposal_order(spark, d):
    from pyspark.sql import Window

    items = standin(spark, d)["guess_proposal_item"].where("confidence is not null")
    first = F.first(F.lower("word")).over(Window.partitionBy("guess_proposal_id").orderBy("position"))
    return design.next_in_turn(items, "guess_proposal_id", "position").select("guess_proposal_id", "position", "place", (first == F.lower("word")).alias("like_first"))
