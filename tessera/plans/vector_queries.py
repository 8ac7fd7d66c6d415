"""Embedding geometry: axis, loads, association, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import concordance
from .catalogue import query, read


def _emb(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", v.doubles("embedding").alias("v"))


_AXIS = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e),
dm AS (SELECT i, avg(x) FILTER (label < 5) - avg(x) FILTER (label >= 5) AS dx, avg(x) AS mu FROM x GROUP BY i),
ax AS (SELECT list(dx ORDER BY i) AS d0, list(mu ORDER BY i) AS mu FROM dm),
a AS (SELECT list_transform(d0, lambda z: z / sqrt(list_dot_product(d0, d0))) AS a, mu FROM ax)"""


@query("q_mean_axis_rho", f"WITH {_AXIS} SELECT vec_id, round(list_dot_product(v, a), 6) AS rho FROM e CROSS JOIN a")
def mean_axis_rho(spark, d):
    e = _emb(spark, d)
    a = v.axis(e, "v", F.col("label") < 5)
    return e.crossJoin(F.broadcast(a)).select("vec_id", F.round(v.dot("v", "axis"), 6).alias("rho"))  # one row


@query("q_centered_rho", f"WITH {_AXIS} SELECT vec_id, round(list_dot_product(v, a) - list_dot_product(mu, a), 6) AS rho_cent FROM e CROSS JOIN a")
def centered_rho(spark, d):
    e = _emb(spark, d)
    both = v.axis(e, "v", F.col("label") < 5).crossJoin(v.mean_vector(e, "v").withColumnRenamed("mean", "mu"))  # two single rows
    return e.crossJoin(F.broadcast(both)).select("vec_id", F.round(v.dot(v.centred("v", "mu"), "axis"), 6).alias("rho_cent"))


@query("q_weat", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT w.vec_id, round(avg(list_dot_product(w.v, t.v)) FILTER (t.label = 0) - avg(list_dot_product(w.v, t.v)) FILTER (t.label = 1), 6) AS weat FROM u w CROSS JOIN u t WHERE w.label >= 2 AND t.label IN (0, 1) GROUP BY 1""")
def weat(spark, d):
    # the mean of cosines is the dot product with the mean unit vector: two vectors instead of words x attributes
    u = _emb(spark, d).withColumn("v", v.normalised("v"))
    poles = v.mean_vector(u.where("label in (0, 1)"), "v", "label").agg(F.max(F.when(F.col("label") == 0, F.col("mean"))).alias("a"), F.max(F.when(F.col("label") == 1, F.col("mean"))).alias("b"))
    return u.where("label >= 2").crossJoin(F.broadcast(poles)).select("vec_id", F.round(v.dot("v", "a") - v.dot("v", "b"), 6).alias("weat"))


#: Vectors of a label that one row holds.
BLOCK = 256


def _blocks(e, side: str):
    """(label, ids, vectors end to end) in rows of about BLOCK vectors, so that a common label is dealt to several tasks."""
    sizes = e.groupBy("label").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    packed = e.join(sizes, "label").groupBy("label", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("vec_id", "v")).alias("vs"))
    return packed.select("label", F.transform("vs", lambda x: x["vec_id"]).alias(f"{side}_ids"), F.flatten(F.transform("vs", lambda x: x["v"])).alias(f"{side}_v"))


def _products(pairs, best, schema: str):
    """``best`` (target ids, candidate ids, targets, candidates as matrices) of every pair of blocks, as rows of ``schema``."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, others, v, w = (np.asarray(b.column(b.schema.get_field_index(c))[i].values) for c in ("t_ids", "c_ids", "t_v", "c_v"))
                yield pa.record_batch(best(ids, others, v.reshape(len(ids), -1), w.reshape(len(others), -1)))

    return pairs.mapInArrow(run, schema)


def _nearest(ids, others, v, w):
    size = np.sqrt((v * v).sum(1)[:, None] * (w * w).sum(1)[None])
    cos = np.round(np.divide(v @ w.T, size, out=np.zeros(size.shape), where=size > 0), 6)
    rows = []
    for i, target in enumerate(ids):
        order = [j for j in np.lexsort((others, -cos[i]))[:6] if others[j] != target][:5]
        rows += [(target, others[j], cos[i, j]) for j in order]
    t, c, x = zip(*rows, strict=True) if rows else ((), (), ())
    return {"target": pa.array(t, pa.int64()), "candidate": pa.array(c, pa.int64()), "cos": pa.array(x, pa.float64())}


def _highest(ids, others, v, w):
    return {"vec_id": pa.array(ids, pa.int64()), "sim": pa.array((v @ w.T).max(1), pa.float64())}


@query("q_topk_similar", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT t.vec_id AS target, c.vec_id AS candidate, round(list_dot_product(t.v, c.v) / sqrt(list_dot_product(t.v, t.v) * list_dot_product(c.v, c.v)), 6) AS cos FROM e t JOIN e c ON t.label = c.label AND t.vec_id <> c.vec_id)
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY cos DESC, candidate) AS INTEGER) AS rank, candidate, cos FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY cos DESC, candidate) <= 5""")
def topk_similar(spark, d):
    """Every vector against all others of its label, as products of blocks, each of which hands on its five best."""
    e = _emb(spark, d).select("vec_id", "label", "v")
    s = _products(_blocks(e, "t").join(_blocks(e, "c"), "label"), _nearest, "target long, candidate long, cos double")
    w = Window.partitionBy("target").orderBy(F.desc("cos"), "candidate")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("target", "rank", "candidate", "cos")


@query("q_congruence_classes", f"""
WITH {_AXIS}, r AS (SELECT vec_id, round(list_dot_product(v, a), 6) AS rho, (label - 4.5) / 10 AS p FROM e CROSS JOIN a)
SELECT CASE WHEN abs(rho) <= 0.05 THEN 'neutral' WHEN rho * p > 0 THEN 'C+' WHEN rho * p < 0 THEN 'C-' ELSE 'excluded' END AS grp, count(*) AS n FROM r WHERE abs(p) > 0.05 GROUP BY 1""")
def congruence_classes(spark, d):
    e = _emb(spark, d)
    r = e.crossJoin(F.broadcast(v.axis(e, "v", F.col("label") < 5))).select(F.round(v.dot("v", "axis"), 6).alias("rho"), ((F.col("label") - 4.5) / 10).alias("p")).where(concordance.admissible(F.col("p")))
    return r.groupBy(concordance.congruence(F.col("rho"), F.col("p")).alias("grp")).agg(F.count("*").alias("n"))


@query("q_history_similarity", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT c.vec_id, round(max(list_dot_product(c.v, h.v)), 6) AS sim_max, round(avg(list_dot_product(c.v, h.v)), 6) AS sim_mean FROM e c JOIN e h ON h.label = c.label + 1 GROUP BY 1""")
def history_similarity(spark, d):
    """Every vector against all of the next label, as products of blocks."""
    e = _emb(spark, d).select("vec_id", "label", "v")
    shifted = e.withColumn("label", F.col("label") - 1)
    # the mean of dot products is the dot product with the mean vector
    mean = v.mean_vector(shifted, "v", "label")
    top = _products(_blocks(e, "t").join(_blocks(shifted, "c"), "label"), _highest, "vec_id long, sim double").groupBy("vec_id").agg(F.max("sim").alias("sim"))
    s = e.join(mean, "label").select("vec_id", v.dot("v", "mean").alias("mean"))
    return top.join(s, "vec_id").select("vec_id", F.round("sim", 6).alias("sim_max"), F.round("mean", 6).alias("sim_mean"))


@query("q_consensus_gate", "SELECT p_brand, bool_and(p_retailprice >= p_size * 20) AS consensus_ok, count(*) AS n_arbiters FROM part GROUP BY 1")
def consensus_gate(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_retailprice") >= F.col("p_size") * 20).alias("consensus_ok"), F.count("*").alias("n_arbiters"))


@query("q_admitted_partition", """
WITH t AS (SELECT c_mktsegment AS seg, quantile_cont(c_acctbal, 0.10) FILTER (c_nationkey < 12) AS tau FROM customer GROUP BY 1)
SELECT c_custkey, c_nationkey < 12 AS grandfathered, c_nationkey < 12 OR c_acctbal >= tau AS admitted FROM customer JOIN t ON seg = c_mktsegment""")
def admitted_partition(spark, d):
    """A verdict on every customer; those of the calibrating nations are grandfathered."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_nationkey") < 12).alias("grandfathered"))
    tau = c.groupBy("c_mktsegment").agg(F.expr("percentile(c_acctbal, 0.10D) filter (where grandfathered)").alias("tau"))
    return c.join(tau, "c_mktsegment").select("c_custkey", "grandfathered", (F.col("grandfathered") | (F.col("c_acctbal") >= F.col("tau"))).alias("admitted"))


@query("q_sign_partition_deltas", "SELECT delta, count(*) FILTER (c_acctbal > delta) AS kept, count(*) FILTER (NOT c_acctbal > delta) AS dropped FROM customer CROSS JOIN (SELECT CAST(unnest([0.0, 100.0, 1000.0, 5000.0]) AS DOUBLE) AS delta) GROUP BY 1")
def sign_partition(spark, d):
    c = read(spark, d, "customer").select(F.explode(F.array(*[F.lit(x) for x in (0.0, 100.0, 1000.0, 5000.0)])).alias("delta"), "c_acctbal")
    return c.groupBy("delta").agg(F.count_if(F.col("c_acctbal") > F.col("delta")).alias("kept"), F.count_if(~(F.col("c_acctbal") > F.col("delta"))).alias("dropped"))
