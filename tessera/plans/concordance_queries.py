"""Banding, concordance, clue metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import banding, clues, concordance
from .catalogue import query, read


@query("q_tercile_cuts_global", "SELECT round(quantile_cont(l_extendedprice, 1.0/3), 6) AS c33, round(quantile_cont(l_extendedprice, 2.0/3), 6) AS c66 FROM lineitem")
def cuts_global(spark, d):
    return banding.cuts(read(spark, d, "lineitem"), "l_extendedprice").select(F.round("c33", 6).alias("c33"), F.round("c66", 6).alias("c66"))


@query("q_tercile_cuts_by_type", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 1.0/3), 6) AS c33, round(quantile_cont(l_extendedprice, 2.0/3), 6) AS c66 FROM lineitem GROUP BY 1")
def cuts_by_type(spark, d):
    return banding.cuts(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").select("l_returnflag", F.round("c33", 6).alias("c33"), F.round("c66", 6).alias("c66"))


@query("q_tercile_bands", """
WITH c AS (SELECT l_returnflag AS f, quantile_cont(l_discount, 1.0/3) AS a, quantile_cont(l_discount, 2.0/3) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, CASE WHEN l_discount < a THEN 1 WHEN l_discount < b THEN 2 ELSE 3 END AS band, count(*) AS n FROM lineitem JOIN c ON f = l_returnflag GROUP BY 1, 2""")
def bands(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_discount")
    return banding.banded(rows, "l_discount", "l_returnflag").groupBy("l_returnflag", "band").agg(F.count("*").alias("n"))


@query("q_tau_quantile", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.10), 6) AS tau FROM customer GROUP BY 1")
def tau_quantile(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.expr("percentile(c_acctbal, 0.10D)"), 6).alias("tau"))


_CARDS_SQL = """
c0 AS (SELECT l_orderkey, o_orderpriority AS model, o_orderstatus AS board_type, l_discount AS conf, l_tax - 0.04 AS rho, (o_orderkey % 7 - 3) / 10.0 AS p, l_extendedprice AS sim FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c1 AS (SELECT *, abs(p) AS abs_p, CASE WHEN abs(rho) <= 0.005 THEN 'neutral' WHEN rho * p > 0 THEN 'C+' WHEN rho * p < 0 THEN 'C-' ELSE 'excluded' END AS grp FROM c0 WHERE abs(p) > 0.05),
cut AS (SELECT board_type, quantile_cont(sim, 1.0/3) AS a, quantile_cont(sim, 2.0/3) AS b FROM c1 WHERE grp IN ('C+', 'C-') GROUP BY 1),
c2 AS (SELECT c1.*, CASE WHEN sim < a THEN 1 WHEN sim < b THEN 2 ELSE 3 END AS band FROM c1 JOIN cut USING (board_type) WHERE grp IN ('C+', 'C-'))"""


def _classified(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("conf"), (F.col("l_tax") - 0.04).alias("rho"), F.col("l_extendedprice").alias("sim"))
    turns = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("board_type"), ((F.col("o_orderkey") % 7 - 3) / 10.0).alias("p")).where(concordance.admissible(F.col("p")))
    cards = items.join(turns, F.col("l_orderkey") == F.col("o_orderkey"))
    return cards.withColumn("abs_p", F.abs("p")).withColumn("grp", concordance.congruence(F.col("rho"), F.col("p"), 0.005))


@query("q_cit_cells", f"""
WITH {_CARDS_SQL},
pr AS (SELECT i.model, i.board_type, i.band AS bi, j.band AS bj, i.abs_p * abs(i.rho - j.rho) AS w, sign(i.conf - j.conf) AS s FROM c2 i JOIN c2 j ON i.l_orderkey = j.l_orderkey AND i.grp = 'C+' AND j.grp = 'C-'),
lv AS (SELECT model, board_type, 0 AS band, w, s FROM pr UNION ALL SELECT model, board_type, bi, w, s FROM pr WHERE bi = bj)
SELECT model, board_type, band, count(*) AS n_pairs, round(CASE WHEN sum(w) <> 0 THEN 0.5 * (1 + sum(w * s) / sum(w)) END, 6) AS cit, round(sum(w), 6) AS weight_total FROM lv GROUP BY 1, 2, 3""")
def cit_cells(spark, d):
    cards = banding.banded(_classified(spark, d).where("grp in ('C+', 'C-')"), "sim", "board_type")
    return concordance.pair_cells(cards, ["l_orderkey"], ["model", "board_type"]).drop("weighting")


@query("q_cit_funnel", f"""
WITH {_CARDS_SQL.split("cut AS")[0].rstrip().rstrip(",")}
SELECT model, count(*) AS candidates, count(*) FILTER (grp = 'neutral') AS neutral, count(*) FILTER (grp = 'C+') AS n_cplus, count(*) FILTER (grp = 'C-') AS n_cminus, count(*) FILTER (grp = 'excluded') AS excluded, count(DISTINCT l_orderkey) AS n_turns FROM c1 GROUP BY 1""")
def cit_funnel(spark, d):
    g = F.col("grp")
    return _classified(spark, d).groupBy("model").agg(
        F.count("*").alias("candidates"), F.count_if(g == "neutral").alias("neutral"), F.count_if(g == "C+").alias("n_cplus"), F.count_if(g == "C-").alias("n_cminus"), F.count_if(g == "excluded").alias("excluded"), F.countDistinct("l_orderkey").alias("n_turns")
    )


@query("q_concsd_cells", """
WITH c AS (SELECT l_orderkey, l_linestatus AS unit, o_orderpriority AS model, l_discount AS conf, l_tax - 0.04 AS rho, abs((o_orderkey % 7 - 3) / 10.0) AS abs_p, CASE WHEN (l_tax - 0.04) * (o_orderkey % 7 - 3) > 0 THEN 'C+' WHEN (l_tax - 0.04) * (o_orderkey % 7 - 3) < 0 THEN 'C-' END AS grp, l_extendedprice AS sim_max, l_quantity AS sim_mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs((o_orderkey % 7 - 3) / 10.0) > 0.05),
v AS (SELECT *, 'max' AS variant, sim_max AS sim FROM c UNION ALL SELECT *, 'mean', sim_mean FROM c),
cut AS (SELECT variant, quantile_cont(sim, 1.0/3) AS a, quantile_cont(sim, 2.0/3) AS b FROM v WHERE grp IS NOT NULL GROUP BY 1),
x AS (SELECT v.*, CASE WHEN sim < a THEN 1 WHEN sim < b THEN 2 ELSE 3 END AS band FROM v JOIN cut USING (variant) WHERE grp IS NOT NULL),
pr AS (SELECT i.model, i.variant, i.band AS bi, j.band AS bj, i.abs_p * abs(i.rho - j.rho) AS w, sign(i.conf - j.conf) AS s FROM x i JOIN x j ON i.l_orderkey = j.l_orderkey AND i.unit = j.unit AND i.variant = j.variant AND i.grp = 'C+' AND j.grp = 'C-'),
lv AS (SELECT model, variant, 0 AS band, w, s FROM pr UNION ALL SELECT model, variant, bi, w, s FROM pr WHERE bi = bj),
wt AS (SELECT model, variant, 'load' AS weighting, band, w, s FROM lv UNION ALL SELECT model, variant, 'equal', band, 1.0, s FROM lv)
SELECT model, variant, weighting, band, count(*) AS n_pairs, round(CASE WHEN sum(w) <> 0 THEN 0.5 * (1 + sum(w * s) / sum(w)) END, 6) AS conc, round(sum(w), 6) AS weight_total FROM wt GROUP BY 1, 2, 3, 4""")
def concsd_cells(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("unit"), F.col("l_discount").alias("conf"), (F.col("l_tax") - 0.04).alias("rho"), F.col("l_extendedprice").alias("sim_max"), F.col("l_quantity").alias("sim_mean"))
    turns = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), ((F.col("o_orderkey") % 7 - 3) / 10.0).alias("p")).where(concordance.admissible(F.col("p")))
    cards = items.join(turns, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("grp", concordance.congruence(F.col("rho"), F.col("p"), 0.0)).where("grp in ('C+', 'C-')").withColumn("abs_p", F.abs("p"))
    variants = cards.select("*", F.expr("stack(2, 'max', sim_max, 'mean', sim_mean) as (variant, sim)"))
    b = banding.banded(variants, "sim", "variant")
    return concordance.pair_cells(b, ["l_orderkey", "unit"], ["model", "variant"], ("load", "equal")).withColumnRenamed("cit", "conc")


@query("q_history_polarity", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) + 1e-9, 6) AS polarity FROM events""")
def history_polarity(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return concordance.history_polarity(e, "user_id", "at", "value").select("event_id", F.round(F.col("polarity") + 1e-9, 6).alias("polarity"))  # off exact halves, which engines round apart


@query("q_unrevealed_before", """
SELECT event_id FROM events t WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = t.user_id AND r.event_type = t.event_type AND r.ts < t.ts)""")
def unrevealed_before(spark, d):
    # the earliest reveal per card decides: one aggregate instead of a range anti-join
    w = Window.partitionBy("user_id", "event_type")
    return read(spark, d, "events").select("event_id", "ts", F.min("ts").over(w).alias("first")).where("ts <= first").select("event_id")


@query("q_unrevealed_before_antijoin", """
SELECT event_id FROM events t WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = t.user_id AND r.event_type = t.event_type AND r.ts < t.ts)""")
def unrevealed_antijoin(spark, d):
    e = read(spark, d, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    t = e.select("event_id", "user_id", "event_type", "ts").alias("t")
    r = first.alias("r")
    on = (F.col("t.user_id") == F.col("r.user_id")) & (F.col("t.event_type") == F.col("r.event_type")) & (F.col("r.first") < F.col("t.ts"))
    return t.join(r, on, "left_anti").select("event_id")


@query("q_dilemma_eligible", "SELECT user_id, count(DISTINCT event_type) AS n_kinds FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 3) GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def dilemma_eligible(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type")
    wanted = F.broadcast(e.distinct().select("event_type").distinct().orderBy("event_type").limit(3))  # three words
    return e.join(wanted, "event_type", "left_semi").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_kinds")).where("n_kinds = 3")


def _outcomes(spark, d):
    flags = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("t"), F.bool_or(F.col("l_returnflag") == "A").alias("n"), F.bool_or(F.col("l_linestatus") == "O").alias("s"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("stratum"))
    return o.join(flags, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("y", clues.dilemma_outcome(F.col("t"), F.col("n"), F.col("s")))


@query("q_iae", """
WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS t, bool_or(l_returnflag = 'A') AS n, bool_or(l_linestatus = 'O') AS s FROM lineitem GROUP BY 1),
y AS (SELECT o_orderpriority, nullif(o_orderstatus, 'P') AS stratum, CASE WHEN t AND s AND NOT n THEN 1 WHEN t AND n AND NOT s THEN 0 END AS y FROM orders JOIN f ON l_orderkey = o_orderkey)
SELECT o_orderpriority, CASE WHEN grouping(stratum) = 1 THEN 'pooled' ELSE coalesce(stratum, '<NULL>') END AS stratum, count(*) AS n, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0,
  round(count(*) FILTER (y = 1) / nullif(count(*) FILTER (y IS NOT NULL), 0), 6) AS iae, round(count(*) FILTER (y IS NULL) / count(*), 6) AS none_rate
FROM y GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, stratum))""")
def iae(spark, d):
    return clues.iae(_outcomes(spark, d), "o_orderpriority", "stratum")


_PAIRS_SQL = """
cd AS (SELECT o_custkey, o_orderkey, l_suppkey % 40 AS w, l_returnflag <> 'N' AS g, p_brand AS cat, o_orderstatus AS stratum, l_extendedprice AS sim FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
pr AS (SELECT a.o_custkey, a.stratum, a.w AS word_a, b.w AS word_b, bool_or(a.g AND b.g) AS grouped, bool_or(a.cat = b.cat) AS congruent FROM cd a JOIN cd b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey AND a.stratum = b.stratum AND a.w < b.w GROUP BY 1, 2, 3, 4)"""


def _pairs(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 40).alias("w"), (F.col("l_returnflag") != "N").alias("g"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("stratum"))
    p = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("cat"))
    cards = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return clues.word_pairs(cards, ["o_custkey", "stratum"], "o_orderkey", "w", "g", "cat")


@query("q_pair_grouping", f"WITH {_PAIRS_SQL} SELECT stratum, congruent, grouped, count(*) AS n FROM pr GROUP BY 1, 2, 3")
def pair_grouping(spark, d):
    return _pairs(spark, d).groupBy("stratum", "congruent", "grouped").agg(F.count("*").alias("n"))


@query("q_tac_tai", f"""
WITH {_PAIRS_SQL}, b AS (SELECT *, c_mktsegment AS model, CAST(word_a % 3 + 1 AS INTEGER) AS band FROM pr JOIN customer ON c_custkey = o_custkey)
SELECT model, CASE WHEN grouping(stratum) = 1 THEN 'pooled' ELSE stratum END AS stratum, CASE WHEN grouping(band) = 1 THEN 0 ELSE band END AS band,
  count(*) FILTER (congruent) AS n_congruent, count(*) FILTER (NOT congruent) AS n_incongruent,
  round(count(*) FILTER (congruent AND grouped) / nullif(count(*) FILTER (congruent), 0), 6) AS tac, round(count(*) FILTER (NOT congruent AND grouped) / nullif(count(*) FILTER (NOT congruent), 0), 6) AS tai,
  round(count(*) FILTER (congruent AND grouped) / nullif(count(*) FILTER (congruent), 0) - count(*) FILTER (NOT congruent AND grouped) / nullif(count(*) FILTER (NOT congruent), 0), 6) AS gap
FROM b GROUP BY GROUPING SETS ((model), (model, stratum), (model, band), (model, stratum, band))""")
def tac_tai(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    pairs = _pairs(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("band", (F.col("word_a") % 3 + 1).cast("int"))
    return clues.tac_tai(pairs, "model", "stratum")


@query("q_divergent_duplicates", """
SELECT l_orderkey, l_suppkey % 5 AS word, CASE WHEN count(DISTINCT l_discount) = 1 THEN min(l_discount) END AS confidence, count(DISTINCT l_discount) > 1 AS divergent FROM lineitem GROUP BY 1, 2""")
def divergent(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).cast("string").alias("word"), "l_discount")
    out = concordance.resolve_rankings(items, "l_orderkey", "word", "l_discount")
    return out.select("l_orderkey", F.col("word_key").cast("long").alias("word"), "confidence", "divergent")
