"""Skill family: accuracy, wins, efficiency, reach, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query, read


@query("q_guess_accuracy", """
SELECT c_mktsegment, count(*) AS n_guesses, count(*) FILTER (l_returnflag = 'R') AS n_agents, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def guess_accuracy(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("agent"))
    # items collapse to one row per order before the joins
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("agent").alias("a"))
    games = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    seats = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = per_order.join(games, F.col("l_orderkey") == F.col("o_orderkey")).join(seats, F.col("o_custkey") == F.col("c_custkey"))
    out = j.groupBy("c_mktsegment").agg(F.sum("n").alias("n_guesses"), F.sum("a").alias("n_agents"))
    return out.withColumn("accuracy", F.round(F.col("n_agents") / F.col("n_guesses"), 6))


def _games(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("win"))
    return o.join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))


@query("q_win_rate_pairing", """
SELECT least(o_orderpriority, c_mktsegment) || ' + ' || greatest(o_orderpriority, c_mktsegment) AS pairing, count(*) AS n_games, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS win_rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def win_rate_pairing(spark, d):
    g = _games(spark, d).withColumn("pairing", F.array_join(F.array_sort(F.array("o_orderpriority", "c_mktsegment")), " + "))
    return g.groupBy("pairing").agg(F.count("*").alias("n_games"), F.round(F.avg(F.col("win").cast("int")), 6).alias("win_rate"))


@query("q_win_rate_model", """
WITH s AS (SELECT o_orderkey, o_orderpriority AS model, o_orderstatus FROM orders UNION SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT model, count(*) AS n_games, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM s GROUP BY model""")
def win_rate_model(spark, d):
    # a model that sits on both seats counts the game once
    seats = _games(spark, d).select("o_orderkey", "win", F.explode(F.array_distinct(F.array("o_orderpriority", "c_mktsegment"))).alias("model"))
    return seats.groupBy("model").agg(F.count("*").alias("n_games"), F.round(F.avg(F.col("win").cast("int")), 6).alias("win_rate"))


@query("q_clue_efficiency", """
WITH a AS (SELECT l_orderkey, count(*) AS agents FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderpriority, count(*) AS n_clues, CAST(sum(coalesce(agents, 0)) AS BIGINT) AS n_agents, round(sum(coalesce(agents, 0)) / count(*), 6) AS efficiency
FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1""")
def clue_efficiency(spark, d):
    a = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("agents"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = o.groupBy("o_orderpriority").agg(F.count("*").alias("n_clues"), F.sum(F.coalesce("agents", F.lit(0))).alias("n_agents"))
    return out.withColumn("efficiency", F.round(F.col("n_agents") / F.col("n_clues"), 6))


@query("q_agents_per_turn", """
WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(n, 0) AS agents, count(*) AS n_turns FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1""")
def agents_per_turn(spark, d):
    a = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = read(spark, d, "orders").select("o_orderkey").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy(F.coalesce("n", F.lit(0)).alias("agents")).agg(F.count("*").alias("n_turns"))


@query("q_result_histogram", "SELECT coalesce(nullif(o_orderstatus, 'P'), '<NULL>') AS result, count(*) AS n FROM orders GROUP BY 1")
def result_histogram(spark, d):
    return read(spark, d, "orders").groupBy(F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("<NULL>")).alias("result")).agg(F.count("*").alias("n"))


@query("q_reach", """
SELECT c_mktsegment, count(DISTINCT c_custkey) AS completed, count(DISTINCT o_custkey) AS reached
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def reach(spark, d):
    # distinct keys first: the join then carries one row per customer
    hit = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment").distinct()
    return c.join(hit, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("c_custkey").alias("completed"), F.count("o_custkey").alias("reached"))


@query("q_seat_counts", "SELECT event_type, CAST(user_id % 2 AS INTEGER) AS seat, count(*) AS n FROM events GROUP BY 1, 2")
def seat_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).cast("int").alias("seat")).agg(F.count("*").alias("n"))


@query("q_power_rule", "SELECT p_brand, count(*) AS n_admissible, CASE WHEN count(*) >= 20 THEN 'PRIMARY' ELSE 'EXPLORATORY' END AS power FROM part WHERE p_size > 5 GROUP BY 1")
def power_rule(spark, d):
    out = read(spark, d, "part").where("p_size > 5").groupBy("p_brand").agg(F.count("*").alias("n_admissible"))
    return out.withColumn("power", F.when(F.col("n_admissible") >= 20, "PRIMARY").otherwise("EXPLORATORY"))


@query("q_metric_by_type_scaffold", """
WITH m AS (SELECT DISTINCT o_orderpriority AS model FROM orders), t AS (SELECT DISTINCT l_returnflag AS board_type FROM lineitem),
g AS (SELECT o_orderpriority, l_returnflag, count(*) AS n, avg(l_discount) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49 AND o_totalprice > 300000 GROUP BY 1, 2)
SELECT model, board_type, coalesce(n, 0) AS n, round(v, 6) AS metric FROM m CROSS JOIN t LEFT JOIN g ON o_orderpriority = model AND l_returnflag = board_type""")
def metric_by_type_scaffold(spark, d):
    o, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    scaffold = o.select(F.col("o_orderpriority").alias("model")).distinct().crossJoin(F.broadcast(items.select(F.col("l_returnflag").alias("board_type")).distinct()))  # two small dimensions
    g = items.where("l_quantity > 49").join(o.where("o_totalprice > 300000"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("model"), F.col("l_returnflag").alias("board_type")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("v"))
    return scaffold.join(g, ["model", "board_type"], "left").select("model", "board_type", F.coalesce("n", F.lit(0)).alias("n"), F.round("v", 6).alias("metric"))


@query("q_report_cells", """
SELECT o_orderpriority AS model, count(*) AS n, coalesce(printf('%.4f', round(avg(CASE WHEN o_orderstatus = 'X' THEN NULL WHEN o_orderpriority LIKE '1%' THEN NULL ELSE (CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) END), 4)), '-') AS cell FROM orders GROUP BY 1""")
def report_cells(spark, d):
    shown = F.when(F.startswith("o_orderpriority", F.lit("1")), None).otherwise((F.col("o_orderstatus") == "F").cast("double"))
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"), F.coalesce(F.format_string("%.4f", F.nvl(F.round(F.avg(shown), 4), F.lit(None).cast("double"))), F.lit("-")).alias("cell")).withColumn("cell", F.when(F.col("cell") == "null", "-").otherwise(F.col("cell")))


@query("q_win_loss_by_status_pivot", """
SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def win_loss_pivot(spark, d):
    j = read(spark, d, "orders").select("o_custkey", "o_orderstatus").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).select("c_mktsegment", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))
