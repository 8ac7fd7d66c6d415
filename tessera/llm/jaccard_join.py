"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets are one class from the start. Bands of MinHash values bring classes together;
within a band's bucket the values of two classes are compared a few at a time, and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below a tolerance. What is left links
classes into groups; inside a group every pair is verified on whole shingle sets of the words themselves. Pairs are compared inside
tasks and never become rows: tasks return spanning links and counts. Buckets and groups above ``BLOCK`` members
are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, column, exact_shingles, grouped, join_hot, joined_with, materialise, mix, partitions, shingles, slices, string_buffers, word_hashes
from .components import components

#: MinHash values of a document, and how many are compared before a pair is judged again.
VALUES, STEP = 96, 16
#: Chance that a pair at the threshold shares no band.
MISSED = 1e-5
#: Posterior probability of reaching the threshold under which a pair is dropped.
TOLERANCE = 1e-6
#: Members of a bucket or group that one task compares with each other.
BLOCK = 512


def band_rows(threshold: float = SIMILARITY) -> int:
    """Values a band, as many as keep the chance that a pair at the threshold shares no band below ``MISSED``: 24 bands of 4 at 0.8."""
    for rows in (8, 6, 4, 3, 2, 1):
        if (1 - threshold**rows) ** (VALUES // rows) <= MISSED:
            return rows
    raise ValueError(f"{VALUES} values cannot find pairs of similarity {threshold}")


def pruning_table(threshold: float = SIMILARITY, tolerance: float = TOLERANCE, n: int = VALUES, step: int = STEP) -> dict[int, int]:
    """Least matches among the first m values, m = step, 2 step ..., that keep a pair.

    With a uniform prior the similarity after k matches of m is Beta(k + 1, m - k + 1); its upper tail at the
    threshold is the chance that a Binomial(m + 1, threshold) is at most k.
    """
    out = {}
    for m in range(step, n + 1, step):
        tail, k = 0.0, 0
        while k <= m:
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= tolerance:
                break
            k += 1
        out[m] = k
    return out


def _constants(n: int):
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])


def _sketches(k: int):
    mul, add = _constants(VALUES)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offs = string_buffers(column(piece, "text"))
                n = len(piece)
                h, doc, _, _ = word_hashes(data, offs, lower=True)
                w, d, other = shingles(h, doc, n, k, word_hashes(data, offs, lower=True, family=1)[0])
                begin = np.searchsorted(d, np.arange(n + 1))
                size = np.diff(begin)
                some = np.flatnonzero(size)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sk = np.zeros((n, VALUES), np.uint32)
                if len(some):
                    at = begin[:-1][some]
                    a[some] = np.add.reduceat(mix(w), at)
                    b[some] = np.add.reduceat(mix(other), at)
                    for i in range(VALUES):
                        sk[some, i] = np.minimum.reduceat(((w ^ add[i]) * mul[i]) >> np.uint64(32), at).astype(np.uint32)
                yield pa.record_batch(
                    [column(piece, "doc_id"), column(piece, "text_hash"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(size), pa.array([sk[i].tobytes() if size[i] else None for i in range(n)], pa.binary())], schema=_SKETCH
                )

    return run


def _bands(per_band: int):
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])
    bands = VALUES // per_band

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = np.frombuffer(b"".join(column(batch, "sketch").to_pylist()), np.uint32).reshape(batch.num_rows, VALUES)
            rep = column(batch, "rep").to_numpy()
            keys = []
            for b in range(bands):
                h = np.full(len(sk), b + 1, np.uint64)
                for r in range(per_band):
                    h = mix(h * np.uint64(0x100000001B3) + sk[:, b * per_band + r])
                keys.append(h)
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(rep, bands))], schema=schema)

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, members 0 to n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spanning(left: np.ndarray, right: np.ndarray):
    """As few links that join the same members."""
    members, where = np.unique(np.concatenate((left, right)), return_inverse=True)
    root = _roots(len(members), where[: len(left)], where[len(left) :])
    off = np.flatnonzero(root != np.arange(len(members)))
    return members[off], members[root[off]]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(side: np.ndarray):
    """Index pairs to compare: across the two blocks, or within the one."""
    if (side == 2).all():
        return np.triu_indices(len(side), 1)
    i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(i, len(j)), np.tile(j, len(i))


def _bayes(least: dict[int, int]):
    def run(batches):
        lefts, rights, n = [], [], 0
        for _, rows in grouped(batches, ["key", "x", "y"]):
            if rows.num_rows < 2:
                continue
            rep = rows.column("rep").to_numpy()
            sk = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(len(rep), VALUES)
            i, j = _pairs(rows.column("side").to_numpy())
            kept = []
            for lo in range(0, len(i), 1 << 17):  # bounds the temporary arrays
                a, b = i[lo : lo + (1 << 17)], j[lo : lo + (1 << 17)]
                same, done = np.zeros(len(a), np.int32), 0
                for m, k in least.items():
                    same = same + (sk[a, done:m] == sk[b, done:m]).sum(1)
                    ok = same >= k
                    a, b, same, done = a[ok], b[ok], same[ok], m
                    if not len(a):
                        break
                kept.append((a, b))
            a, b = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
            if len(a):
                p, q = _spanning(rep[a], rep[b])
                lefts.append(p), rights.append(q)
                n += len(p)
            if n > 1 << 16:
                yield pa.record_batch([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], schema=_EDGES)
                lefts, rights, n = [], [], 0
        if n:
            yield pa.record_batch([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], schema=_EDGES)

    return run


def _dealt(rows: DataFrame, key: str, member: str, sizes: DataFrame, total: int) -> DataFrame:
    """Rows of (key, member) with the pairs of blocks (x, y) that each takes part in; side 2: the block with itself."""
    with_size = join_hot(rows, sizes, key, member, "members", total)
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    other = with_size.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.select(
        *rows.columns,
        F.least("own", "other").cast("int").alias("x"),
        F.greatest("own", "other").cast("int").alias("y"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
    )


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("texts", pa.int64()), ("docs", pa.int64())])


def _verify(k: int, threshold: float):
    def run(batches):
        for _, rows in grouped(batches, ["grp", "x", "y"]):
            rep = rows.column("rep").to_numpy()
            if len(rep) < 2:
                continue
            once = np.sort(np.unique(rep, return_index=True)[1])  # repeated rows of an id come once
            rows, n = rows.take(once), len(once)
            rep, copies, side = (rows.column(c).to_numpy() for c in ("rep", "copies", "side"))
            w, d = exact_shingles([t.encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()], k)
            size = np.bincount(d, minlength=n)
            order = np.argsort(w, kind="stable")
            w, d = w[order], d[order]
            new = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            shared = np.bincount(group)[group] > 1 if len(w) else new
            col = np.cumsum(new & shared) - 1
            col, who = col[shared], d[shared]
            both = np.zeros((n, n), np.float32)
            width = 4096
            cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
            for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                hit = np.zeros((n, width), np.float32)
                hit[who[lo:hi], col[lo:hi] - c * width] = 1
                both += hit @ hit.T
            inter = both.astype(np.float64)
            union = size[:, None] + size[None, :] - inter
            linked = inter / np.maximum(union, 1) >= threshold
            np.fill_diagonal(linked, False)
            if not (side == 2).all():
                linked &= side[:, None] != side[None, :]
            i, j = np.nonzero(np.triu(linked))
            texts, copied = linked.sum(1), linked @ copies
            a, b = _spanning(rep[i], rep[j]) if len(i) else (rep[:0], rep[:0])
            has = np.flatnonzero(texts)
            # counts are rows that link a class to itself
            yield pa.record_batch(
                [pa.array(np.concatenate((rep[has], a))), pa.array(np.concatenate((rep[has], b))), pa.array(np.concatenate((texts[has], np.zeros(len(a), np.int64)))), pa.array(np.concatenate((copied[has], np.zeros(len(a), np.int64))))],
                schema=_FOUND,
            )

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_text_links.

    Two documents are linked if the Jaccard similarity of their sets of word shingles (ASCII letters lower-cased)
    is at least ``threshold``. class_id is the smallest id of the documents that links join, copy_id the smallest
    id with an equal set; n_links counts the linked documents, copies included, n_text_links the linked sets that differ.
    A text of 1 to words - 1 words has one shingle, all its words; null, empty and blank texts have none and no links,
    not even to each other. Repeated rows count as copies of each other; different texts under one id that lends its name to
    their sets share their class and counts. Rows with a null id come back with null class_id and copy_id and link
    nothing. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    n, per_band = partitions(spark), band_rows(threshold)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = every.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    made = materialise(rows.mapInArrow(_sketches(words), "doc_id long, text_hash long, set_a long, set_b long, size long, sketch binary"), "sketches")
    sets = materialise(
        made.where("size > 0").groupBy("set_a", "set_b", "size").agg(F.min(F.struct("doc_id", "text_hash", "sketch")).alias("m"), F.count("*").alias("copies"))
        .select("set_a", "set_b", "size", F.col("m.doc_id").alias("rep"), "m.text_hash", "m.sketch", "copies"), "sets"
    )

    n_sets = sets.count()
    bands = sets.select("rep", "sketch").mapInArrow(_bands(per_band), "key long, rep long")
    met = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    candidates = _dealt(bands, "key", "rep", met, n_sets * (VALUES // per_band)).join(sets.select("rep", "sketch"), "rep")
    run = _bayes(pruning_table(threshold))
    likely = candidates.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "side", "rep", "sketch").mapInArrow(run, "a long, b long")
    groups = materialise(components(likely).select(F.col("node").alias("rep"), F.col("component").alias("grp")), "groups")

    members = _dealt(groups, "grp", "rep", groups.groupBy("grp").agg(F.count("*").alias("members")), groups.count()).join(sets.select("rep", "text_hash", "copies"), "rep")
    texts = joined_with(rows.withColumnRenamed("doc_id", "rep"), members, ["rep", "text_hash"], "inner")
    checked = texts.repartition(n, "grp", "x", "y").sortWithinPartitions("grp", "x", "y").select("grp", "x", "y", "side", "rep", "copies", "text").mapInArrow(_verify(words, threshold), "a long, b long, texts long, docs long")
    checked = materialise(checked, "links")
    counts = checked.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(checked.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("class_id"))

    per_set = sets.select("set_a", "set_b", "size", "rep", "copies").join(counts, "rep", "left").join(classes, "rep", "left")
    own = made.select("doc_id", "set_a", "set_b", "size").join(per_set, ["set_a", "set_b", "size"], "left")
    found = own.select(
        "doc_id",
        F.coalesce("class_id", "rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_id"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    unnamed = every.where("doc_id is null").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("class_id", "copy_id")], *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_text_links")])
    return found.unionByName(unnamed)


def brute_force(docs, threshold: float = SIMILARITY, words: int = SHINGLE_WORDS) -> dict[int, tuple[int, int]]:
    """class_id and n_links by comparing all pairs, for tests; ASCII texts."""
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[x : x + words]) for x in range(max(1, len(w) - words + 1))) if w else frozenset()
    ids = sorted(sets)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}
