"""Substring dedup by level-wise doubling.

Windows of five words are looked at first; only where such a window occurs twice in the corpus are windows of
twice that length built and compared, and so on up to the full length; a level without candidates hands the next one no
rows. To ship few windows, a level below the last takes, for each full window that is still a candidate, its smallest
window of the level's length (a minimizer): equal full windows hold equal minimizers, so no repeat is lost. The last level
compares 128-bit BLAKE2 digests of the windows' words themselves. Each task settles repeats among its own rows and ships
one row per distinct window, so a passage that a third of all documents share costs one row per task and not one per document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, from_bytes, joined_with, mix, partitions, slices, string_buffers, to_bytes, window_hashes, word_hashes

WINDOW_WORDS = 20
#: Words of the first level's windows.
FIRST_WORDS = 5
#: Records that a task gathers before it ships them.
FLUSH = 1 << 20
#: Bytes of text for each bucket, which bounds what a task holds.
BUCKET_BYTES = 1 << 26


def levels(window: int) -> list[int]:
    """Window lengths: each twice the one before, the last one as asked."""
    out = [window]
    while out[0] > FIRST_WORDS:
        out.insert(0, max(FIRST_WORDS, -(-out[0] // 2)))
    return out


def _anchors(h: np.ndarray, doc: np.ndarray, size: int, window: int):
    """For each full window inside one document: its start, the place of its minimizer; and all hashes of ``size`` words."""
    low = window_hashes(h, size)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), low
    order = mix(low)
    # sliding minimum over the window - size + 1 short windows of each full one, leftmost on ties
    width, span = window - size + 1, 1
    best, at = order, np.arange(len(order))
    while span * 2 <= width:
        take = best[span:] < best[:-span]
        at = np.where(take, at[span:], at[:-span])
        best = np.where(take, best[span:], best[:-span])
        span *= 2
    if span < width:
        gap = width - span
        take = best[gap:] < best[:-gap]
        at = np.where(take, at[gap:], at[:-gap])
    start = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    return start, at[start], low


def _digests(data: np.ndarray, s: np.ndarray, e: np.ndarray, start: np.ndarray, window: int):
    """128-bit digests of the windows that begin at words ``start``, as two columns: of their words' bytes, with one space between."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lens = e - s + 1
    ends = np.cumsum(lens)
    joined = np.full(int(ends[-1]), 0x20, np.uint8)
    begin = ends - lens
    word = np.arange(int(ends[-1])) - np.repeat(begin, lens)
    inside = word < np.repeat(lens - 1, lens)
    joined[inside] = data[(word + np.repeat(s, lens))[inside]]
    raw, b2 = joined.tobytes(), hashlib.blake2b
    out = b"".join([b2(raw[a:b], digest_size=16).digest() for a, b in zip(begin[start].tolist(), (ends[start + window - 1] - 1).tolist(), strict=True)])
    both = np.frombuffer(out, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _versions(piece) -> np.ndarray:
    """What tells texts of one id apart, in the upper half of a place: the CRC-32 of the text."""
    return np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) << 32 for t in column(piece, "text").to_pylist()], np.uint64)


def _firsts(key: list[np.ndarray], doc: np.ndarray, pos: np.ndarray):
    """Order that sorts by key, document and place, and where in it each key begins."""
    order = np.lexsort((pos, doc, *reversed(key)))
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in key:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
        d, p = doc[order], pos[order]
        once = np.concatenate(([True], ~same | (d[1:] != d[:-1]) | (p[1:] != p[:-1])))  # rows equal in id and text are one document
        order, new = order[once], new[once]
    return order, new


def _bin(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _steps(a: np.ndarray) -> bytes:
    """Integers that mostly grow by little, in few bytes."""
    return to_bytes(np.diff(a.view(np.uint64), prepend=np.uint64(0)))


def _unsteps(x: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(x))


def _in_order(doc: np.ndarray, pos: np.ndarray, *cols: np.ndarray):
    """The columns by document and place."""
    order = np.lexsort((pos, doc))
    return doc[order], pos[order], *(c[order] for c in cols)


def _by_part(part: np.ndarray, parts: int, *cols: np.ndarray):
    """(part, the columns' rows of it) for every part that has rows."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for b in range(parts):
        at = order[cuts[b] : cuts[b + 1]]
        if len(at):
            yield b, *(c[at] for c in cols)


def _home(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


#: Windows on their way to the bucket of their hash, and settled places (key null) on their way to their documents.
_SHIP = "bucket int, key binary, sub binary, doc binary, pos binary"
_SHIP_ARROW = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("sub", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
_PLACES = "home int, doc binary, pos binary"
_PLACES_ARROW = pa.schema([("home", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary())])
_MARKS = "doc_id long, marks binary"
_MARKS_ARROW = pa.schema([("doc_id", pa.int64()), ("marks", pa.binary())])


def _ship(parts: list[tuple], buckets: int, both: bool):
    """One task's records: one per distinct window to its bucket; what is settled here goes straight to its document.

    both: at the levels below the last every place of a window found twice is wanted, at the full length all but the first.
    """
    key, sub, doc, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order, new = _firsts([key, sub] if not both else [key], doc, pos)
    if both:
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        local = order[again & ~new]
        first_again = order[again & new]
        known_doc = np.concatenate((doc[local], doc[first_again]))
        known_pos = np.concatenate((pos[local], pos[first_again]))
    else:
        local = order[~new]
        known_doc, known_pos = doc[local], pos[local]
    lead = order[new]
    rows = [[], [], [], [], []]
    d, p, k, u = _in_order(doc[lead], pos[lead], key[lead], sub[lead])
    for b, k, u, d, p in _by_part((k % np.uint64(buckets)).astype(np.int64), buckets, k, u, d, p):
        for r, v in zip(rows, (b, _bin(k), None if both else _bin(u), _steps(d), _steps(p)), strict=True):
            r.append(v)
    for r, v in zip((rows[0], rows[3], rows[4]), zip(*_homes(known_doc, known_pos, buckets), strict=True), strict=False):
        r += v
    for r in rows[1:3]:
        r += [None] * (len(rows[0]) - len(r))
    yield pa.record_batch([pa.array(r, f.type) for r, f in zip(rows, _SHIP_ARROW, strict=True)], schema=_SHIP_ARROW)


def _homes(doc: np.ndarray, pos: np.ndarray, buckets: int):
    """(home, documents, places) of places on their way to their documents."""
    d, p = _in_order(doc, pos)
    for b, d, p in _by_part(_home(d, buckets), buckets, d, p):
        yield b, _steps(d), _steps(p)


def _meet(batches, buckets: int, both: bool):
    """Windows of a bucket from all tasks: the places that are repeats, a row for each home of documents."""
    keys, subs, docs, poss = [], [], [], []
    for batch in batches:
        known = column(batch, "key").is_null()
        mine = batch.filter(known)
        if mine.num_rows:
            yield pa.record_batch([column(mine, "bucket"), column(mine, "doc"), column(mine, "pos")], schema=_PLACES_ARROW)
        rest = batch.filter(pc.invert(known))
        for name, held in (("key", keys), ("sub", subs)):
            held += [np.frombuffer(x, np.uint64) for x in column(rest, name).to_pylist() if x is not None]
        for name, held in (("doc", docs), ("pos", poss)):
            held += [_unsteps(x) for x in column(rest, name).to_pylist()]
    if not keys:
        return
    key, doc, pos = np.concatenate(keys), np.concatenate(docs).view(np.int64), np.concatenate(poss)
    order, new = _firsts([key, np.concatenate(subs)] if not both else [key], doc, pos)
    if both:
        group = np.cumsum(new) - 1
        at = order[np.bincount(group)[group] > 1]
    else:
        at = order[~new]
    rows = list(zip(*_homes(doc[at], pos[at], buckets), strict=True)) or [[], [], []]
    yield pa.record_batch([pa.array(r, f.type) for r, f in zip(rows, _PLACES_ARROW, strict=True)], schema=_PLACES_ARROW)


def _gather(batches):
    """Places of the documents of a home: one row per document."""
    docs, poss = [], []
    for batch in batches:
        docs += [_unsteps(x) for x in column(batch, "doc").to_pylist()]
        poss += [_unsteps(x) for x in column(batch, "pos").to_pylist()]
    if not docs:
        return
    doc, pos = _in_order(np.concatenate(docs).view(np.int64), np.concatenate(poss))
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = [*cut[1:].tolist(), len(doc)]
    for lo in range(0, len(cut), 4096):
        hi = min(lo + 4096, len(cut))
        yield pa.record_batch([pa.array(doc[cut[lo:hi]]), pa.array([_steps(pos[a:b]) for a, b in zip(cut[lo:hi].tolist(), ends[lo:hi], strict=True)], pa.binary())], schema=_MARKS_ARROW)


def _places(marks: bytes | None, version: np.uint64) -> np.ndarray:
    """Word places of one text among the marks of its id."""
    if not marks:
        return np.zeros(0, np.int64)
    p = _unsteps(marks)
    return (p[p >> np.uint64(32) == version >> np.uint64(32)] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _level(window: int, before: int, size: int, buckets: int):
    """Records of one level; ``before`` is the length whose repeats are marked (0: the first level, every window is a candidate)."""
    last = size == window

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offs = string_buffers(column(piece, "text"))
                ids, versions = column(piece, "doc_id").to_numpy(), _versions(piece)
                h, doc, s, e = word_hashes(data, offs)
                begin = np.searchsorted(doc, np.arange(len(ids)))
                if before:
                    start, at, _ = _anchors(h, doc, before, window)
                    flag = np.zeros(len(h) + 1, bool)
                    for i, x in enumerate(column(piece, "marks").to_pylist()):
                        flag[begin[i] + _places(x, versions[i])] = True
                    keep = flag[at]
                if last:
                    at = start[keep] if before else _anchors(h, doc, size, window)[0]
                    key, sub = _digests(data, s, e, at, window)
                else:
                    _, at, low = _anchors(h, doc, size, window)
                    at = np.unique(at[keep] if before else at)
                    key = sub = low[at]
                parts.append((key, sub, ids[doc[at]], (at - begin[doc[at]]).astype(np.uint64) | versions[doc[at]]))
                n += len(at)
                if n >= FLUSH:
                    yield from _ship(parts, buckets, not last)
                    parts, n = [], 0
        if n:
            yield from _ship(parts, buckets, not last)

    return run


def _cover(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offs = string_buffers(column(piece, "text"))
                _, doc, s, e = word_hashes(data, offs)
                raw, versions = data.tobytes(), _versions(piece)
                begin = np.searchsorted(doc, np.arange(len(piece) + 1))
                removed, kept = [], []
                for i, x in enumerate(column(piece, "marks").to_pylist()):
                    a, b = int(begin[i]), int(begin[i + 1])
                    gone = np.zeros(b - a + 1, np.int32)
                    if x:
                        p = _places(x, versions[i])
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + window, -1)
                    stay = a + np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    removed.append(b - a - len(stay))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]).decode())
                yield pa.record_batch([column(piece, "doc_id"), pa.array(np.diff(begin), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, kept_text string"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Remove the words that a repeated window covers, but for the window's first occurrence.

    Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space). The first
    occurrence is the one of the smallest id, then the smallest start. Null or empty texts have no words and
    keep none; texts shorter than the window keep all; an empty table gives an empty table. Rows with a null id have no
    place in the order: they keep all their words and repeat nothing. Rows that share an id are told apart by their texts, in
    the order of the texts' CRC-32; rows equal in id and text are one document, whose result each of them gets. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    if window < 1:
        raise ValueError("a window holds at least one word")
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    size = every.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    buckets = n * max(1, -(-size // (n * BUCKET_BYTES)))
    rows = every.where("doc_id is not null")
    at_home = rows.repartition(buckets, "doc_id")
    marks, before = None, 0
    for size in levels(window):
        texts = rows if marks is None else joined_with(at_home, marks, "doc_id", "inner").select("doc_id", "text", "marks")
        records = texts.mapInArrow(_level(window, before, size, buckets), _SHIP)
        met = records.repartition(buckets, "bucket").mapInArrow(lambda it, both=size < window: _meet(it, buckets, both), _PLACES)
        marks, before = met.repartition(buckets, "home").mapInArrow(_gather, _MARKS), size
    run, schema = _cover(window)
    unplaced = every.where("doc_id is null").withColumn("marks", F.lit(None).cast("binary"))
    # the union stands above: below it, the exchange of texts would not be the same for all levels
    return joined_with(at_home, marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(run, schema).unionByName(unplaced.mapInArrow(run, schema))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW_WORDS) -> dict[int, tuple[int, int, str]]:
    """The same by a plain dictionary, for tests."""
    import re

    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out
