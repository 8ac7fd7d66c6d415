"""Ingest, integrity, replay and schedule shapes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import integrity
from ..sources import sinks
from ..streaming import windows
from .catalogue import query, read


@query("q_ingest_if_absent", "SELECT count(*) AS inserted, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS skipped FROM part WHERE p_partkey % 3 <> 0")
def ingest_if_absent(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    new, counts = sinks.insert_if_absent(p, p.where("p_partkey % 3 = 0"), ["p_partkey"])
    return counts


@query("q_provenance_merge", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS sources, count(DISTINCT c_mktsegment) > 4 AS conflict FROM customer GROUP BY 1""")
def provenance_merge(spark, d):
    g = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return g.select("c_nationkey", F.array_join("s", "; ").alias("sources"), (F.size("s") > 4).alias("conflict"))


@query("q_exclusion_reasons", """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49.9) THEN 'stoplist' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) THEN 'already_loaded' END AS reason FROM part)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, min(p_partkey) AS first_part FROM r GROUP BY 1""")
def exclusion_reasons(spark, d):
    items = read(spark, d, "lineitem")
    flags = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_quantity") > 49.9).alias("stop"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("loaded"))
    r = read(spark, d, "part").select("p_partkey").join(flags, "p_partkey", "left")  # both lists in one pass
    reason = F.when(F.coalesce("stop", F.lit(False)), "stoplist").when(F.coalesce("loaded", F.lit(False)), "already_loaded").otherwise("kept")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("q_candidate_counts", """
SELECT count(*) AS raw, count(*) FILTER (p_size > 5) AS playable, count(*) FILTER (p_size > 5 AND p_partkey % 7 <> 0) AS after_stoplist, count(*) FILTER (p_size > 5 AND p_partkey % 7 <> 0 AND p_retailprice > 1000) AS final FROM part""")
def candidate_counts(spark, d):
    a, b, c = F.col("p_size") > 5, F.col("p_partkey") % 7 != 0, F.col("p_retailprice") > 1000
    return read(spark, d, "part").agg(F.count("*").alias("raw"), F.count_if(a).alias("playable"), F.count_if(a & b).alias("after_stoplist"), F.count_if(a & b & c).alias("final"))


@query("q_consecutive_failures", """
WITH f AS (SELECT user_id, event_id, value < 10 AS bad, sum(CASE WHEN value < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM f WHERE bad)
SELECT user_id, max(run) AS longest, min(event_id) FILTER (run = 3) AS aborted_at FROM r GROUP BY 1""")
def consecutive_failures(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") < 10).alias("bad"))
    island = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = e.withColumn("island", island).where("bad").withColumn("run", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("event_id")))
    return r.groupBy("user_id").agg(F.max("run").cast("long").alias("longest"), F.min(F.when(F.col("run") == 3, F.col("event_id"))).alias("aborted_at"))


@query("q_integrity_orphans", """
SELECT 'lineitem.l_orderkey' AS reference, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans FROM lineitem UNION ALL
SELECT 'orders.o_custkey', count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders UNION ALL
SELECT 'labels.doc_id', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels""")
def integrity_orphans(spark, d):
    t = lambda n: read(spark, d, n)
    checks = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, c, parent, p in checks:
        one = integrity.orphans(t(child), c, t(parent), p, f"{child}.{c}")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_unique_violations", """
SELECT 'lineitem' AS relation, count(*) AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
SELECT 'documents.text', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def unique_violations(spark, d):
    return integrity.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem").unionByName(integrity.duplicates(read(spark, d, "documents"), ["text"], "documents.text"))


@query("q_check_ranges", "SELECT 'l_discount' AS rule, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS violations FROM lineitem UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) FROM orders")
def check_ranges(spark, d):
    a = integrity.violations(read(spark, d, "lineitem"), {"l_discount": F.col("l_discount").between(0, 1)})
    return a.unionByName(integrity.violations(read(spark, d, "orders"), {"o_orderstatus": F.col("o_orderstatus").isin("F", "O", "P")}))


@query("q_seed_derivation", "SELECT p_partkey, CAST(CAST('0x' || substr(sha256('20260701:' || p_partkey), 1, 16) AS UBIGINT) AS VARCHAR) AS board_seed FROM part")
def seed_derivation(spark, d):
    name = F.concat(F.lit("20260701:"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select("p_partkey", codec.seed_first8(name).cast("string").alias("board_seed"))


_SEED = "CAST('0x' || right(sha256({}), 16) AS UBIGINT)"
_BYTES = "unhex(printf('%016x', {}))"


@query("q_game_identity", f"""
WITH h AS (SELECT o_orderkey AS game_index, sha1(unhex('6ba7b8149dad11d180b400c04fd430c8') || encode('2026:' || o_orderkey)) AS h FROM orders),
i AS (SELECT game_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%x', (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) | 8) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS game_id FROM h),
g AS (SELECT *, {_SEED.format(_BYTES.format("CAST(2026 AS UBIGINT)") + " || encode(game_id)")} AS g FROM i)
SELECT game_index, game_id, CAST(g AS VARCHAR) AS derived_seed, CAST({_SEED.format(_BYTES.format("g") + " || encode('engine')")} AS VARCHAR) AS engine_seed,
  CAST({_SEED.format(_BYTES.format("g") + " || encode('seat1') || " + _BYTES.format("CAST(3 AS UBIGINT)"))} AS VARCHAR) AS play_seed, CAST({_SEED.format(_BYTES.format("g") + " || encode('meas0') || " + _BYTES.format("CAST(3 AS UBIGINT)"))} AS VARCHAR) AS measurement_seed
FROM g""")
def game_identity(spark, d):
    """Ids and the four kinds of seeds of games numbered by order keys; calls of turn 3, seat 1 (play) and seat 0 (measurement)."""
    from .schedule import with_identity

    g = with_identity(read(spark, d, "orders").select(F.col("o_orderkey").alias("game_index")), 2026)
    seed, turn = F.col("derived_seed"), F.lit(3)
    return g.select("game_index", "game_id", seed.cast("string").alias("derived_seed"), F.col("engine_seed").cast("string").alias("engine_seed"), codec.turn_seed(seed, "seat", F.lit(1), turn).cast("string").alias("play_seed"), codec.turn_seed(seed, "meas", F.lit(0), turn).cast("string").alias("measurement_seed"))


@query("q_schedule_cross", """
WITH p AS (SELECT x.r_regionkey AS a, y.r_regionkey AS b, row_number() OVER (ORDER BY x.r_regionkey, y.r_regionkey) - 1 AS p FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey),
b AS (SELECT n_nationkey AS board, row_number() OVER (ORDER BY n_nationkey) - 1 AS j, count(*) OVER () AS n FROM nation), o AS (SELECT unnest([0, 1]) AS o)
SELECT CAST(2 * n * p + 2 * j + o AS INTEGER) AS game_index, CASE WHEN o = 0 THEN a ELSE b END AS seat0, CASE WHEN o = 0 THEN b ELSE a END AS seat1, board FROM p CROSS JOIN b CROSS JOIN o""")
def schedule_cross(spark, d):
    """All regions as models, all nations as boards."""
    from .schedule import build_schedule

    models, boards = read(spark, d, "region").select(F.col("r_regionkey").alias("model")), read(spark, d, "nation").select(F.col("n_nationkey").alias("board"))
    return build_schedule(models, boards).select("game_index", "seat0", "seat1", "board")


@query("q_cyclic_window", """
WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, CAST(((i - 3 * 5) % n + n) % n AS INTEGER) AS place FROM p WHERE ((i - 3 * 5) % n + n) % n < 5""")
def cyclic_window(spark, d):
    w = Window.partitionBy("p_brand")
    p = read(spark, d, "part").select("p_brand", "p_partkey").withColumn("i", F.row_number().over(w.orderBy("p_partkey")) - 1).withColumn("n", F.count("*").over(w))
    return p.withColumn("place", F.pmod(F.col("i") - 15, F.col("n")).cast("int")).where("place < 5").select("p_brand", "p_partkey", "place")


@query("q_cascade_delete_remaining", """
WITH k AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 1)
SELECT 'orders' AS relation, (SELECT count(*) FROM orders) - count(*) AS deleted, count(*) AS remaining FROM k UNION ALL
SELECT 'lineitem', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM k)), count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM k)) FROM lineitem""")
def cascade_delete(spark, d):
    orders = read(spark, d, "orders")
    doomed = orders.where("o_custkey % 10 = 1").select("o_orderkey")
    left = sinks.cascade_delete({"orders": (orders, "o_orderkey"), "lineitem": (read(spark, d, "lineitem"), "l_orderkey")}, doomed, "o_orderkey")
    out = None
    for name, (before, after) in left.items():
        one = after.agg(F.count("*").alias("remaining")).crossJoin(before.agg(F.count("*").alias("all"))).select(F.lit(name).alias("relation"), (F.col("all") - F.col("remaining")).alias("deleted"), "remaining")  # single rows
        out = one if out is None else out.unionByName(one)
    return out


@query("q_event_windows_batch", """
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    return windows.hourly(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("q_user_sessions_batch", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, count(DISTINCT sid) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "ts", "event_id")
    new = F.coalesce((F.lag("ts").over(w) < F.col("ts") - F.expr("interval 30 minutes")).cast("int"), F.lit(1))
    return e.withColumn("new", new).groupBy("user_id").agg(F.sum("new").cast("long").alias("sessions"), F.count("*").alias("events"))


@query("q_batch_report", """
WITH e AS (SELECT event_type, CASE WHEN value < 1 THEN 'collision' WHEN value < 3 THEN 'provider' WHEN value < 5 THEN 'model' END AS kind FROM events)
SELECT event_type, count(*) AS attempted, count(*) FILTER (kind IS NULL) AS completed, count(*) FILTER (kind = 'collision') AS collision, count(*) FILTER (kind = 'provider') AS provider, count(*) FILTER (kind = 'model') AS model FROM e GROUP BY 1""")
def batch_report(spark, d):
    kind = F.when(F.col("value") < 1, "collision").when(F.col("value") < 3, "provider").when(F.col("value") < 5, "model")
    e = read(spark, d, "events").select("event_type", kind.alias("kind"))
    return e.groupBy("event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("kind").isNull()).alias("completed"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("collision", "provider", "model")])


@query("q_last_attempt", "SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS attempts FROM conversations GROUP BY 1")
def last_attempt(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("attempts"))


@query("q_set_operations", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT lower(p_brand) FROM part UNION SELECT lower(c_mktsegment) FROM customer) UNION ALL
SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'intersection', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_operations(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    words = read(spark, d, "part").select(F.lower("p_brand").alias("w")).union(c.select(F.lower("c_mktsegment"))).distinct()
    sets = {"union": words, "difference": c.select("c_custkey").distinct().join(o, "c_custkey", "left_anti"), "intersection": c.select("c_custkey").distinct().join(o, "c_custkey", "left_semi")}
    out = None
    for k, s in sets.items():
        one = s.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out




@query("q_batch_abort", """
WITH g AS (SELECT o_custkey % 40 AS pairing, o_orderkey AS k, o_orderstatus <> 'P' AS ok FROM orders), r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY pairing ORDER BY k) AS won FROM g),
s AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY pairing, won ORDER BY k) AS streak FROM r), e AS (SELECT pairing, min(k) FILTER (streak >= 3) AS stop FROM s GROUP BY 1), j AS (SELECT s.*, coalesce(k > stop, false) AS skipped FROM s JOIN e USING (pairing))
SELECT pairing, count(*) AS scheduled, count(*) FILTER (NOT skipped) AS attempted, count(*) FILTER (ok AND NOT skipped) AS completed, count(*) FILTER (NOT ok AND NOT skipped) AS errored, count(*) FILTER (skipped) AS skipped, bool_or(skipped) AS aborted FROM j GROUP BY 1""")
def batch_abort(spark, d):
    """Three failures in a row end a pairing's batch."""
    from ..operators import batch

    games = read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("pairing"), F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") != "P").alias("ok"))
    return batch.report(batch.outcomes(games, "pairing", "k", "ok", 3), "pairing")
