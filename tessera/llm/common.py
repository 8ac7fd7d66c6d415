"""Shared pieces of the training-data operators: table access, checkpoints, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII bytes.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Word shingles take five words and a similarity of 0.8 unless a contract says otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.8

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Two families of word hashes: powers' base and multiplier.
_FAMILIES = ((0x5851F42D4C957F2D, np.uint64(0xBF58476D1CE4E5B9)), (0x9FB21C651E98DF25, np.uint64(0xD6E8FEB86659FD93)))
#: Rows of one join key that one task takes at least, before the key counts as hot.
HOT_ROWS = 512
#: Bytes of text hashed in one go; bounds the temporary arrays.
BLOCK_BYTES = 1 << 21
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_checkpoints"
        local = not found.partition("://")[1] or found.startswith("file:")
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def materialise(df: DataFrame, name: str, swept: bool = False, **options: str) -> DataFrame:
    """Write to the shared folder, with the writer's ``options``, and read back: cuts lineage and survives lost executors.

    The folder goes when the driver ends, or before that by ``discard``. ``swept``: the shuffle files of the step go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    with _swept(spark) if swept else nullcontext():
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a frame that ``materialise`` returned and that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_written", None)
    if path:
        fs, at = _file_system(df.sparkSession, path)
        fs.delete(at, True)


def crc_of_id(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def _hash_block(data: np.ndarray, breaks: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends of bytes in which words also end at ``breaks``."""
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lens = ends - starts
    top = int(lens.max())
    base, factor = _FAMILIES[family]
    powers = np.cumprod(np.full(top, base, dtype=np.uint64))
    at = np.flatnonzero(word)
    rel = at - np.repeat(starts, lens)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers[rel]
    terms ^= terms >> np.uint64(32)  # not linear in the bytes: sums of plain powers coincide for some pairs of long words
    terms *= factor
    terms ^= terms >> np.uint64(29)
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lens)[:-1])))
    return mix(sums ^ (lens.astype(np.uint64) * _GOLD)), starts, ends


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False, family: int = 0):
    """(hash, document index, start byte, end byte) of every word of the documents that ``offs`` delimits."""
    if lower:
        data = _LOWER[data]
    hs, ss, es = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK_BYTES)
        if hi < n:  # end the block between words
            nxt = offs[np.searchsorted(offs, hi, "left")]
            back = np.flatnonzero(_IS_SPACE[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(_IS_SPACE[data[hi:nxt]])
                hi = hi + int(ahead[0]) + 1 if len(ahead) else int(nxt)
        a, b = np.searchsorted(offs, [lo, hi])
        h, s, e = _hash_block(data[lo:hi], offs[a : b + 1] - lo, family)
        hs.append(h), ss.append(s + lo), es.append(e + lo)
        lo = hi
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, np.searchsorted(offs, s, "right") - 1, s, e


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the len(h) - k + 1 windows of k words, by doubling shorter windows."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, size, have = None, 0, 1, mix(h + _GOLD)
    rest = k
    while True:
        if rest & 1:
            part = have[done : done + len(h) - k + 1]
            out = part if out is None else mix(out * _M2 + part + np.uint64(done + 1))
            done += size
        rest >>= 1
        if not rest:
            return out
        have = double_window(have, size)
        size *= 2


def double_window(have: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows twice as long as those of ``have``, which are ``size`` words long."""
    if len(have) <= size:
        return np.zeros(0, np.uint64)
    return mix(have[:-size] * _M1 + have[size:])


def _shingled(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """Hashes and documents of all shingles, repeats included."""
    w = window_hashes(h, k)
    d = doc[: len(w)]
    inside = d == doc[k - 1 : k - 1 + len(w)]
    w, d = w[inside], d[inside]
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        extra = []
        for i in short:
            part = h[begin[i] : begin[i + 1]]
            extra.append(window_hashes(part, len(part))[0] ^ _GOLD)
        w = np.concatenate((w, np.array(extra, np.uint64)))
        d = np.concatenate((d, short))
    return w, d


def _distinct(w: np.ndarray, d: np.ndarray, *others: np.ndarray):
    order = np.lexsort((w, d))
    w, d = w[order], d[order]
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    return w[keep], d[keep], *(x[order][keep] for x in others)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = SHINGLE_WORDS, other: np.ndarray | None = None):
    """(hash, document index), ascending and distinct, of each document's shingles; a document of 1 to k - 1 words has one shingle, all its words.

    ``other`` are the same words' hashes of another family; their shingles' hashes come third.
    """
    w, d = _shingled(h, doc, n_docs, k)
    return _distinct(w, d) if other is None else _distinct(w, d, _shingled(other, doc, n_docs, k)[0])


def exact_shingles(texts: list[bytes], k: int = SHINGLE_WORDS):
    """(number, document index) of each text's shingles, ascending and distinct: equal numbers stand for equal words, without hashes.

    ASCII letters are lower-cased; a text of 1 to k - 1 words has one shingle, all its words.
    """
    numbers: dict[bytes, int] = {}
    words = [t.lower().split() for t in texts]  # splits at just the ASCII white space
    for ws in words:
        for w in ws:
            numbers.setdefault(w, len(numbers))
    sizes = np.array([len(ws) for ws in words], np.int64)
    h = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)

    def joined(a, b):
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a

    n = max(0, len(h) - k + 1)
    out, done, size, have, rest = None, 0, 1, h, k
    while n:
        if rest & 1:
            part = have[done : done + n]
            out = part if out is None else joined(out, part)
            done += size
        rest >>= 1
        if not rest:
            break
        have, size = joined(have[: len(have) - size], have[size:]), size * 2
    w = out if n else h[:0]
    inside = doc[:n] == doc[k - 1 : k - 1 + n]
    w, d = w[inside], doc[:n][inside]
    short, seen = np.flatnonzero((sizes > 0) & (sizes < k)), {}
    if len(short):
        base = int(w.max()) + 1 if len(w) else 0
        extra = [base + seen.setdefault(tuple(words[i]), len(seen)) for i in short.tolist()]
        w, d = np.concatenate((w, np.array(extra, np.int64))), np.concatenate((d, short))
    return _distinct(w, d)


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """Row ranges of a batch that hold about ``limit`` bytes of a string column; a longer row stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offs = string_buffers(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batches, keys: list[str]):
    """Consecutive rows of equal keys, over batch borders, as (key tuple, table); the input is sorted by the keys."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield held_key, pa.Table.from_batches(held)


def joined_with(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """A join that shuffles but never sorts the wide side; the narrow side is hashed per partition."""
    return big.join(small.hint("shuffle_hash"), on, how)


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, member: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``per_key`` has for each ``key``, its ``weight`` being the key's number of rows.

    Keys of more than a thousandth of the ``total`` rows are dealt to several tasks by a hash of ``member``; as there
    are at most a thousand of those, they can be broadcast.
    """
    parts, least = partitions(rows.sparkSession), max(HOT_ROWS, total // 1000)
    if total <= least:
        return rows.join(per_key, key)
    hot = per_key.where(F.col(weight) > least).select(key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(member), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    spread = F.when(F.col(weight) > least, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(per_key.withColumn("_salt", F.explode(spread)), [key, "_salt"]).drop("_salt")


def return_memory() -> None:
    """From now on this worker gives arrays of over 1 MB back to the system once they are freed."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def to_bytes(a: np.ndarray) -> bytes:
    """Integers as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def from_bytes(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = pa.decompress(x[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8")[:, 0] if n else np.zeros(0, np.uint64)


class Shipped:
    """A driver object of bounded size on the executors, classes of this package included."""

    def __init__(self, spark: SparkSession, obj):
        from pyspark import cloudpickle

        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def get(self):
        import pickle

        return pickle.loads(self._bytes.value)
