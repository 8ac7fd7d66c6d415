"""Bootstrap draws by MD5, worked out on arrays: the hash of a draw once for all groups, then counts and weighted sums per replicate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Draws that are hashed at once: their arrays stay in a core's cache.
CHUNK = 32768
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _heads(prefix: bytes, numbers: np.ndarray, digits: int, out: np.ndarray) -> None:
    """Into ``out``: the first eight hex digits of MD5 over ``prefix`` and each number, all of so many digits; one block of 55 bytes at most."""
    n, size = len(numbers), len(prefix) + digits
    block = bytearray(64)
    block[: len(prefix)], block[len(prefix) : size], block[size], block[56:64] = prefix, b"0" * digits, 0x80, (8 * size).to_bytes(8, "little")
    fixed = [int.from_bytes(block[4 * i : 4 * i + 4], "little") for i in range(16)]
    words: dict[int, np.ndarray] = {}
    rest = numbers
    for place in range(size - 1, len(prefix) - 1, -1):
        less = rest // np.uint32(10)
        words[place // 4] = words.get(place // 4, np.uint32(0)) + ((rest - less * np.uint32(10)) << np.uint32(8 * (place % 4)))
        rest = less
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # three more steps would not change the first word
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        shift = _SHIFTS[turn][i % 4]
        np.add(f, a, out=f), np.add(f, np.uint32((_SINES[i] + fixed[word]) & _MASK), out=f)
        if word in words:
            np.add(f, words[word], out=f)
        np.right_shift(f, np.uint32(32 - shift), out=t), np.left_shift(f, np.uint32(shift), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(b, np.uint32(_START[0]), out=t)
    t.byteswap(inplace=True)
    out[:] = t


def heads(rep: int, n: int) -> np.ndarray:
    """The first eight hex digits of md5('rep:d') as numbers, for d from 0 to n - 1."""
    out, prefix = np.empty(n, np.uint32), f"{rep}:".encode()
    low, digits = 0, 1
    while low < n:
        high = min(n, 10**digits)
        for x in range(low, high, CHUNK):
            y = min(high, x + CHUNK)
            _heads(prefix, np.arange(x, y, dtype=np.uint32), digits, out[x:y])
        low, digits = high, digits + 1
    return out


def weighted(hashes: np.ndarray, n: int, cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[float]:
    """hits, num and den of each cell (ord, num, den) when draw d takes number hashes[d] mod n, for n draws."""
    ords = hashes[:n] // np.uint32(n)  # a quotient is quicker than a remainder, and counts and places are quicker by indices
    np.subtract(hashes[:n], np.multiply(ords, np.uint32(n), out=ords), out=ords)
    times = np.bincount(ords.astype(np.intp), minlength=n).astype(np.float64)
    out = []
    for at, num, den in cells:
        w = times[at]
        out += [float(w.sum()), float(w @ num), float(w @ den)]
    return out


def drawn_sums(spark: SparkSession, groups: list[tuple[int, int, list]], width: int, replicates: int) -> tuple[DataFrame, object]:
    """(gid, rep, h0, n0, d0, h1, ...) of every group (gid, n, its ``width`` cells) and replicate, and the broadcast that it reads."""
    names = [f"{x}{i}" for i in range(width) for x in "hnd"]
    known = spark.sparkContext.broadcast(groups)
    most = max(n for _, n, _ in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(g, n, [(at.astype(np.intp), num, den) for at, num, den in cells]) for g, n, cells in known.value]
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                hashes = heads(rep, most)
                rows = [weighted(hashes, n, cells) for _, n, cells in groups]
                columns = [pa.array([g for g, _, _ in groups], pa.int32()), pa.array([rep] * len(rows), pa.int64()), *[pa.array(x, pa.float64()) for x in zip(*rows)]]
                yield pa.RecordBatch.from_arrays(columns, names=["gid", "rep", *names])

    slices = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, replicates, 1, slices).mapInArrow(run, ", ".join(["gid int", "rep long", *[f"{x} double" for x in names]])), known
