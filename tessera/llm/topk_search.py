"""Exact top-k search by inner product over a pivot-distance index.

Every vector gets one further component that makes all lengths equal, so the highest inner products are the
nearest neighbours, and triangle-inequality bounds hold. Vectors are keyed by nearest pivot and distance to it; a cell is cut
along that distance into annuli of bounded size. A query's distance to its k-th best among the pivots' sample bounds its
search: only annuli that can hold something nearer get the query, and inside one only rows within the bound are compared,
nearest annulus first while the bound shrinks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shipped, column, materialise, mix

#: Rows that pivots and first bounds are taken from, about: the index's only bound on what is fitted.
SAMPLE = 4096
#: Least and most pivots; between them their number grows with the square root of the rows.
PIVOTS = (32, 256)
#: Distance bins a cell, and rows an annulus holds, about.
BINS, ANNULUS = 256, 4096
#: Queries that one task compares with one annulus, about.
QUERIES = 16384
_SLACK = 1e-6


class Index:
    """Pivots, the sample, the common length, and how cells are cut into annuli: all bounded by SAMPLE, PIVOTS and BINS."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, rows: int):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        self.dim = vectors.shape[1]
        #: No component is longer than the longest vector.
        self.kind = np.dtype(np.int16 if longest < 2**15 else np.int32 if longest < 2**31 else np.int64)
        full = self.lift(vectors)
        rng = np.random.default_rng(7)
        pivots = [full[int(rng.integers(len(full)))]]
        near = ((full - pivots[0]) ** 2).sum(1)
        while len(pivots) < min(max(PIVOTS[0], min(PIVOTS[1], int(rows**0.5) // 8)), len(full)):  # far from those before, as k-means++ seeds
            total = near.sum()
            if total <= 0:
                break
            pivots.append(full[int(rng.choice(len(full), p=near / total))])
            near = np.minimum(near, ((full - pivots[-1]) ** 2).sum(1))
        self.pivots = np.array(pivots)
        #: cell -> its annuli, each with the first and the last bin, the first block, parts of its rows and of its queries
        self.annuli: dict[int, list[list[int]]] = {}
        self.width = 2.0 * max(self.longest, 1e-9) / BINS

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (v.astype(np.float64) ** 2).sum(1), 0)
        return np.concatenate((v, np.sqrt(rest)[:, None]), 1)

    def to_pivots(self, full: np.ndarray) -> np.ndarray:
        d = (full**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(d, 0))

    def cut(self, counts: list[tuple[int, int, int]]) -> None:
        """Annuli from (cell, bin, rows)."""
        by: dict[int, list[tuple[int, int]]] = {}
        for c, b, n in sorted(counts):
            by.setdefault(c, []).append((b, n))
        for c, bins in by.items():
            out, lo, size = [], None, 0
            for b, n in bins:
                if lo is not None and size + n > ANNULUS:
                    out.append((lo, last, size))
                    lo = None
                if lo is None:
                    lo, size = b, 0
                last, size = b, size + n
            out.append((lo, last, size))
            # equal distances do not cut: such rows are dealt by a hash of the id
            self.annuli[c] = [[a, z, 0, max(1, -(-n // ANNULUS)), 1] for a, z, n in out]
        self.number({})

    def number(self, queries: dict[tuple[int, int], int]) -> None:
        """Blocks: a task's share of an annulus's rows and queries; ``queries`` has how many each (cell, annulus) gets."""
        block = 0
        for c, table in self.annuli.items():
            for i, t in enumerate(table):
                t[4] = max(1, -(-queries.get((c, i), 0) // QUERIES))
                t[2] = block
                block += t[3] * t[4]

    def bound(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> np.ndarray:
        """Distance within which k other rows lie for sure."""
        out = np.full(len(q), np.inf)
        for lo in range(0, len(q), 256):
            a, own = q[lo : lo + 256], q_ids[lo : lo + 256, None] == self.ids[None]
            d = (a**2).sum(1)[:, None] + self.longest**2 - 2 * a @ self.vectors.T  # lifted rows are all equally long
            d = np.where(own, np.inf, np.maximum(d, 0))
            if d.shape[1] >= k:
                out[lo : lo + 256] = np.sqrt(np.partition(d, k - 1, 1)[:, k - 1])
        return out


def _vectors(batch, dim):
    flat = column(batch, "v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


_ROWS = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("dist", pa.float64()), ("v", pa.binary())])


def _keyed(shared, cut: bool):
    def run(batches):
        ix = shared.get()
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _vectors(batch, ix.dim), column(batch, "id").to_numpy()
            d = ix.to_pivots(ix.lift(v))
            cell = d.argmin(1)
            dist = d[np.arange(len(d)), cell]
            bins = np.minimum((dist / ix.width).astype(np.int64), BINS - 1)
            if not cut:
                keys, n = np.unique(cell * BINS + bins, return_counts=True)
                yield pa.record_batch([pa.array((keys // BINS).astype(np.int32)), pa.array((keys % BINS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "bin", "n"])
                continue
            first, parts, chunks = (np.zeros(len(ids), np.int64) for _ in range(3))
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                table = np.array(ix.annuli[c])
                at = np.searchsorted(table[:, 0], bins[rows], "right") - 1
                first[rows], parts[rows], chunks[rows] = table[at, 2], table[at, 3], table[at, 4]
            first += (mix(ids.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64) * chunks
            copy = np.repeat(np.arange(len(ids)), chunks)  # a row for each part of the queries
            block = first[copy] + np.arange(len(copy)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            flat = v.astype(ix.kind)
            yield pa.record_batch([pa.array(block), pa.array(ids[copy]), pa.array(dist[copy]), pa.array([flat[i].tobytes() for i in copy.tolist()], pa.binary())], schema=_ROWS)

    return run


_ASKED = pa.schema([("block", pa.int64()), ("query_id", pa.int64()), ("query_key", pa.int64()), ("dist", pa.float64()), ("reach", pa.float64()), ("v", pa.binary())])
_COUNTS = pa.schema([("cell", pa.int32()), ("annulus", pa.int32()), ("n", pa.int64())])


def _asked(shared, k: int, count: bool):
    """Queries, once for each block that can hold one of their k nearest; or how many each annulus gets."""

    def run(batches):
        ix = shared.get()
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids, keys = _vectors(batch, ix.dim), column(batch, "id").to_numpy(), column(batch, "query_key").to_numpy()
            full = np.concatenate((v, np.zeros((len(v), 1))), 1)
            d = ix.to_pivots(full)
            reach = ix.bound(v, ids, k) * (1 + _SLACK) + _SLACK
            nearest, flat = d.min(1), v.astype(ix.kind)
            chunk = mix(ids.view(np.uint64) ^ keys.view(np.uint64))
            counted, made = [], []
            for c, table in ix.annuli.items():
                # every row of the cell is nearer to its pivot than to any other
                ok = (d[:, c] - nearest) / 2 <= reach
                for i, (a, z, block, parts, chunks) in enumerate(table):
                    low, high = a * ix.width, np.inf if z == BINS - 1 else (z + 1) * ix.width
                    gap = np.maximum(np.maximum(low - d[:, c], d[:, c] - high), 0)
                    hit = np.flatnonzero(ok & (gap <= reach))
                    if count:
                        counted.append((c, i, len(hit)))
                    elif len(hit):
                        of = np.repeat(hit, parts)
                        made.append((block + np.tile(np.arange(parts), len(hit)) * chunks + (chunk[of] % np.uint64(chunks)).astype(np.int64), of, d[of, c]))
            if count:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*counted, strict=True), _COUNTS, strict=True)], schema=_COUNTS)
            elif made:
                block, of, dist = (np.concatenate([m[j] for m in made]) for j in range(3))
                for lo in range(0, len(of), 1 << 14):
                    o = of[lo : lo + (1 << 14)]
                    yield pa.record_batch([pa.array(block[lo : lo + len(o)]), pa.array(ids[o]), pa.array(keys[o]), pa.array(dist[lo : lo + len(o)]), pa.array(reach[o]), pa.array([flat[i].tobytes() for i in o.tolist()], pa.binary())], schema=_ASKED)

    return run


def _search(dim: int, kind: np.dtype, longest: float, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            dist = rows.column("dist").to_numpy()
            order = np.argsort(dist, kind="stable")
            dist, ids = dist[order], rows.column("id").to_numpy()[order]
            v = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(-1, dim)[order].astype(np.float64)
            for qid, qkey, qd, reach, blob in zip(*(queries.column(c).to_pylist() for c in ("query_id", "query_key", "dist", "reach", "v")), strict=True):
                q = np.frombuffer(blob, kind).astype(np.float64)
                base = float(q @ q) + longest**2
                best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
                left = right = int(np.searchsorted(dist, qd))
                while True:  # outwards from the query's own distance, the nearer side first
                    gl = qd - dist[left - 1] if left > 0 else np.inf
                    gr = dist[right] - qd if right < len(dist) else np.inf
                    if min(gl, gr) > reach or left == 0 and right == len(dist):
                        break
                    if gl <= gr:
                        lo, hi = max(0, left - 1024), left
                        left = lo
                    else:
                        lo, hi = right, min(len(dist), right + 1024)
                        right = hi
                    s, c = v[lo:hi] @ q, ids[lo:hi]
                    other = c != qid
                    best_s, best_i = np.concatenate((best_s, s[other])), np.concatenate((best_i, c[other]))
                    top = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[top], best_i[top]
                    if len(best_s) == k:
                        reach = min(reach, np.sqrt(max(base - 2 * best_s[-1], 0)) * (1 + _SLACK) + _SLACK)
                out[0] += [qid] * len(best_s)
                out[1] += [qkey] * len(best_s)
                out[2] += best_i.tolist()
                out[3] += best_s.astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "query_key", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of highest inner product, ties to the smaller id.

    Both sides hold (id: long, v: array of long). A row does not find itself, that is, rows of the query's id. Null
    vectors, those with null components, and rows with a null id take no part. Vectors of different lengths are compared as
    if zeros followed the shorter one, so an empty one scores 0; all are stored as long as the longest. Rows equal in id and
    vector are one row; different vectors of one id are rows, and queries, of their own. Queries with fewer than ``k``
    candidates get all; no candidates, no rows. Scores are exact while products stay below 2 to the 53rd.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"

    def taken(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("long").alias("id"), "v").where("v is not null and not exists(v, x -> x is null) and id is not null").distinct()

    rows = materialise(taken(vectors), "vectors")
    one = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))")).alias("top")).first()
    n, dim = one["n"], max(1, one["dim"] or 0)
    if not n:
        return spark.createDataFrame([], schema)

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))

    if one["low"] < dim:
        rows = filled(rows)
    asked = filled(taken(queries).where(F.size("v") <= dim)).withColumn("query_key", F.xxhash64("v"))
    span = 1 << 30
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(span)) < F.lit(int(span * min(1.0, SAMPLE / n)))).collect() or rows.limit(1).collect()
    ix = Index(np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float64), float(np.sqrt(one["top"])) + 1e-9, n)
    counts = rows.mapInArrow(_keyed(Shipped(spark, ix), False), "cell int, bin int, n long").groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect()
    ix.cut([(r["cell"], r["bin"], r["n"]) for r in counts])
    hits = asked.mapInArrow(_asked(Shipped(spark, ix), k, True), "cell int, annulus int, n long").groupBy("cell", "annulus").agg(F.sum("n").alias("n")).collect()  # at most PIVOTS x BINS rows
    ix.number({(r["cell"], r["annulus"]): r["n"] for r in hits})
    shared = Shipped(spark, ix)
    index = rows.mapInArrow(_keyed(shared, True), "block long, id long, dist double, v binary")
    wanted = asked.mapInArrow(_asked(shared, k, False), "block long, query_id long, query_key long, dist double, reach double, v binary")
    search = _search(dim, ix.kind, ix.longest, k)

    def both(rows: pa.Table, queries: pa.Table) -> pa.Table:
        return search(rows, queries)

    both.__annotations__ = {"rows": pa.Table, "queries": pa.Table, "return": pa.Table}
    # a task holds about ANNULUS rows and QUERIES queries at a time
    found = index.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(both, "query_id long, query_key long, vec_id long, score long")
    # Spark limits each group before its shuffle: k rows a query and task
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(id, v): floor(256 * x) of each component as a double; vectors with null or non-finite components are null."""
    ok = F.expr("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return embeddings.select(F.col("vec_id").alias("id"), F.when(ok, F.expr("transform(embedding, x -> floor(256 * double(x)))")).alias("v"))
