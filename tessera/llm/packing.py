"""Best-fit packing with large-item matching.

Documents become token pieces of at most the capacity. Pieces above one third of it are matched first: at most
two fit into a bin, and each takes the longest partner that still fits. Shorter pieces, longest first, go where the
gap left is smallest. The plan works on how many pieces there are of each length, so the driver sees one count per
length and never a piece; pieces find their places by their rank among those of equal length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shipped, column, materialise, partitions

CAPACITY = 2048
END = 0
#: Pieces of one length that a task numbers, about.
RANKED = 1 << 18
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def load_bpe(path: str):
    """The byte-level BPE of a tokenizers file on the tiktoken engine, which gives the same ids several times as fast.

    Strings of added tokens become their ids, as the tokenizers library has it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    # the printable stand-ins of byte-level BPE: bytes that print stand for themselves, the rest follow from 256
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    import public_tokenizers

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def _cut(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        bpe = load_bpe(path)
        end = np.array([END], "<u4")
        for batch in batches:
            rows = []
            for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                ids = np.concatenate((bpe.encode_to_numpy(t or "", allowed_special="all").astype("<u4"), end))
                first = (len(ids) - 1) % capacity + 1
                lo, n = 0, 0
                for hi in range(first, len(ids) + 1, capacity):
                    rows.append((i, n, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    lo, n = hi, n + 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, slots, first bin, offset) for ``counts`` pieces of each length.

    Pieces of a length with ranks first rank, first rank + 1 ... go to bins first bin, first bin + 1 ... at the offset.
    """
    left = {n: c for n, c in counts.items() if c}
    rank: dict[int, int] = defaultdict(int)
    slots, bins = [], 0
    #: gap -> runs of bins (first bin, bins) that have it
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(length, n, first, offset):
        slots.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left.get(a):
            b = next((x for x in large if x <= a and left.get(x, 0) - (x == a) > 0 and a + x <= capacity), 0)
            n = min(left[a], left[b]) if b and b != a else left[a] // 2 if b else left[a]
            put(a, n, bins, 0)
            if b:
                put(b, n, bins, a)
            open_runs[capacity - a - b].append((bins, n))
            bins += n
    gaps = sorted(g for g in open_runs if g)
    from bisect import bisect_left, insort

    for a in sorted((n for n in left), reverse=True):
        while left.get(a):
            at = bisect_left(gaps, a)
            if at == len(gaps):  # no gap is wide enough: new bins, each filled with as many as fit
                each = capacity // a
                n, extra = divmod(left[a], each)
                for bins_now, per in ((n, each), (1 if extra else 0, extra)):
                    if bins_now:
                        for k in range(per):
                            put(a, bins_now, bins, k * a)
                        gap = capacity - per * a
                        if gap:
                            if not open_runs[gap]:
                                insort(gaps, gap)
                            open_runs[gap].append((bins, bins_now))
                        bins += bins_now
                continue
            gap = gaps[at]
            first, n = open_runs[gap].pop()
            if not open_runs[gap]:
                gaps.pop(at)
            take = min(n, left[a])
            if take < n:
                if not open_runs[gap]:
                    insort(gaps, gap)
                open_runs[gap].append((first + take, n - take))
            put(a, take, first, capacity - gap)
            if gap - a:
                if not open_runs[gap - a]:
                    insort(gaps, gap - a)
                open_runs[gap - a].append((first, take))
    return slots


def _place(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        slots = shared.get()
        key = slots[:, 0] * (1 << 44) + slots[:, 1]
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            yield pa.record_batch([*(column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slots[at, 3] + rank - slots[at, 1]), pa.array(slots[at, 4])], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 0; a null or empty text is the 0 alone. Strings of the tokenizer's added
    tokens are those tokens. Only documents longer than ``capacity`` are cut, into pieces of that length with the rest
    first. Sequences have no gaps. Equal texts make equal pieces in places of their own. Rows that share an id, or have
    none, are documents of their own; pieces of theirs that are equal in every column may change places. An empty table
    gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialise(rows.mapInArrow(_cut(tokenizer_path, capacity), _PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # ranks within a length, salted: a length that a third of all pieces have is numbered by as many tasks as it needs
    salts = max(partitions(spark), -(-max(counts.values(), default=0) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    slots = np.array(sorted(plan(counts, capacity)) or [(0, 0, 0, 0, 0)], np.int64)
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    placed = ranked.join(before.select("length", "salt", "before"), ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    return placed.mapInArrow(_place(Shipped(spark, slots)), _PIECES + ", sequence_id long, offset long")
