"""Cross-entropy difference scoring with matched n-gram models.

A target model and a background model share one vocabulary: every word of the corpus. Both are interpolated bigram
models, counted over every row. A document's score is its mean loss per token under the target model less that under
the background model: lower is closer to the target. A document that a model counted can be held out of it: its own counts,
which its chunk knows, are taken off before it is scored.

The counts grow with the corpus and are never gathered in one place. Tasks put documents together as chunks; a chunk
sends each shard its distinct n-grams and their counts once, the shard adds up the counts of all chunks and answers each
with the sums, and the chunk, which travels as word numbers, turns them into scores.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, from_bytes, grouped, joined_with, materialise, mix, partitions, return_memory, slices, string_buffers, to_bytes, word_hashes

#: Weight of the bigram estimate, and the additive constant of the unigram one.
LAMBDA, ADD = 0.7, 0.5
#: Tokens of a chunk, but for the last document's rest.
CHUNK_TOKENS = 1 << 20
#: Tokens whose documents' own counts are taken off at a time.
SLICE_TOKENS = 1 << 16
#: Bytes of counted text for each shard, which bounds what a task holds.
SHARD_BYTES = 1 << 23
#: Rounds in which counts are added up, and then chunks scored: a round's shuffle is gone from the disks before the next begins.
ROUNDS = 2
#: Target ids up to which they are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The previous word at a document's start.
START = np.uint64(0x9E3779B97F4A7C15)
#: n-grams are named by hashes of so many bits, of which the lowest marks single words. Among 1e9 of them, 4 in a million share a name.
KEY_BITS = 48
#: What chunks and answers hold is compressed already; the file format's codecs would keep buffers as large as a page of it.
PLAIN = {"compression": "none"}


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    """Names of n-grams; kind 0: bigrams, 1: words, 2: contexts."""
    h = mix(h ^ np.uint64(0xA0761D6478BD642F * (kind + 1) & (1 << 64) - 1)) >> np.uint64(64 - KEY_BITS)
    return (h & ~np.uint64(1)) | np.uint64(kind == 1)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards)) >> np.uint64(32)


def _together(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _apart(x: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(x):
        n = int.from_bytes(x[at : at + 8], "little")
        out.append(x[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class _Grams:
    """The distinct n-grams of a chunk: from word hashes, the words' numbers and the documents' sizes."""

    def __init__(self, vocab: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        v = len(vocab)
        prev = np.concatenate(([v], places[:-1])).astype(np.int64) if len(places) else places.astype(np.int64)
        prev[np.cumsum(sizes[:-1])[sizes[1:] > 0]] = v
        if len(places):
            prev[0] = v
        # a bigram of the chunk is a pair of numbers
        prev *= v + 1
        prev += places
        pairs, of_token = np.unique(prev, return_inverse=True)
        del prev
        self.of_token = of_token.astype(np.int32)
        del of_token
        prev, self.word = (pairs // (v + 1)).astype(np.int32), (pairs % (v + 1)).astype(np.int32)
        n = len(pairs)
        del pairs
        contexts, context = np.unique(prev, return_inverse=True)
        self.context = context.astype(np.int32)
        del context
        wide = np.concatenate((vocab, [START]))
        keys = np.concatenate((_key(wide[prev] * np.uint64(0xD6E8FEB86659FD93) + wide[self.word], 0), _key(vocab, 1), _key(wide[contexts], 2)))
        del prev, wide
        self.keys, at = np.unique(keys, return_inverse=True)
        del keys
        self.bigrams, self.words, self.contexts = np.split(at.astype(np.int32), [n, n + v])

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, in target and background tokens."""
        out = []
        every = np.bincount(self.of_token, minlength=len(self.word))
        hit = np.bincount(self.of_token[target], minlength=len(self.word))
        for n in (hit, every - hit):
            total = np.zeros(len(self.keys))
            for at, of, size in ((self.bigrams, None, 0), (self.words, self.word, len(self.words)), (self.contexts, self.context, len(self.contexts))):
                total += np.bincount(at, weights=n if of is None else np.bincount(of, weights=n, minlength=size), minlength=len(self.keys))
            out.append(total.astype(np.int64))
        return out[0], out[1]

    def _losses(self, of: np.ndarray, counts: np.ndarray, tokens, vocabulary: int, less=(0, 0, 0)) -> np.ndarray:
        """Of the bigrams ``of`` under the model that ``counts`` has each key of, less some of the counts."""
        n, u, c = (counts[at] - x for at, x in zip((self.bigrams[of], self.words[self.word[of]], self.contexts[self.context[of]]), less, strict=True))
        word = (u + ADD) / (tokens + ADD * (vocabulary + 1))
        return -np.log(np.where(c > 0, LAMBDA * n / np.maximum(c, 1) + (1 - LAMBDA) * word, word))

    def losses(self, counts: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
        """Of each token under the model that ``counts`` has each key of."""
        out = np.empty(len(self.word))
        for lo in range(0, len(out), SLICE_TOKENS):  # bounds the temporary arrays
            of = np.arange(lo, min(len(out), lo + SLICE_TOKENS))
            out[of] = self._losses(of, counts, tokens, vocabulary)
        return out[self.of_token]

    def held_out_losses(self, counts: np.ndarray, tokens: int, vocabulary: int, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Like ``losses``, but the model of a document that it counted (``own``) is less the document itself."""
        out = self.losses(counts, tokens, vocabulary)
        ends, lo = np.concatenate(([0], np.cumsum(sizes))), 0
        while lo < len(sizes):  # documents of about SLICE_TOKENS tokens at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS, "right")) - 1)
            doc = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            mine = np.flatnonzero(own[doc])
            if len(mine):
                doc, of = doc[mine], self.of_token[mine + ends[lo]]
                less = []
                for kind in (of, self.word[of], self.context[of]):  # how often the document holds the bigram, the word, the context
                    _, at, times = np.unique(doc * (len(self.word) + 1) + kind, return_inverse=True, return_counts=True)
                    less.append(times[at])
                out[mine + ends[lo]] = self._losses(of, counts, tokens - sizes[doc], vocabulary, less)
            lo = hi
        return out


_CHUNKS = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_target", pa.int64()), ("n_background", pa.int64()), ("body", pa.binary())])
_CHUNKS_SQL = "chunk string, part int, shard int, n_target long, n_background long, body binary"


def _chunks(shards: int):
    """For each chunk a row of shard -1 with its documents and tokens, and rows with its n-grams and counts by shard."""

    def made(held):
        from pyspark import TaskContext

        ids, sizes = pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held])
        vocab, inv, n = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small numbers for frequent words
        number = np.empty(len(vocab), np.int64)
        number[order] = np.arange(len(vocab))
        vocab, places = vocab[order], number[inv].astype(np.int32)
        goal = np.concatenate([x[3] for x in held])
        target = np.repeat(goal, sizes)
        held.clear()
        del inv, order, number
        grams = _Grams(vocab, places, sizes)
        counts = grams.counts(target)
        body = _together(to_bytes(ids.fill_null(0).to_numpy().view(np.uint64)), to_bytes(ids.is_null().to_numpy(zero_copy_only=False)), to_bytes(sizes), vocab.tobytes(), to_bytes(places), to_bytes(goal))
        shard = _shard(grams.keys, shards).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)]
        name, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        rows = [(name, part, -1, int(target.sum()), int((~target).sum()), body)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((name, part, int(shard[a]), 0, 0, _together(to_bytes(np.diff(grams.keys[a:b], prepend=np.uint64(0))), *(to_bytes(c[a:b]) for c in counts))))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)

    def run(batches):
        return_memory()
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                word, doc, _, _ = word_hashes(*string_buffers(column(piece, "text")), lower=True)
                held.append((word, column(piece, "doc_id"), np.bincount(doc, minlength=len(piece)), column(piece, "target").to_numpy(zero_copy_only=False).astype(bool)))
                size += len(word)
                if size >= CHUNK_TOKENS:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    return run


_ANSWERS = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("words", pa.int64()), ("body", pa.binary())])
_ANSWERS_SQL = "chunk string, part int, shard int, words long, body binary"


def _keys(body: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(_apart(body)[0]))


def _add_up(own: bool):
    """Adds up the counts of each shard (rows of kind 0, which come first) and answers its rows: all, if ``own``, or those of kind 1.

    A row without a chunk tells the distinct words of the shard.
    """

    def answer(row, at, counts):
        return pa.record_batch([[row[0]], [row[1]], [row[2]], [0], [_together(*(to_bytes(c[at]) for c in counts))]], schema=_ANSWERS)

    def summed(held):
        keys = [_keys(x[3]) for x in held]
        u, inv = np.unique(np.concatenate(keys), return_inverse=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = [np.bincount(inv, weights=np.concatenate([from_bytes(_apart(x[3])[m]) for x in held]), minlength=len(u)).astype(np.int64) if held else np.zeros(0, np.int64) for m in (1, 2)]
        return u, inv, [np.append(c, 0) for c in counts], np.cumsum([0, *map(len, keys)])

    def run(batches):
        return_memory()
        now, held, table = None, [], None

        def closed():
            u, inv, counts, ends = summed(held)
            if own:
                for row, a, b in zip(held, ends[:-1], ends[1:], strict=True):
                    yield answer(row, inv[a:b], counts)
            yield pa.record_batch([pa.array([None], pa.string()), [0], [now], [int((u & np.uint64(1)).sum())], pa.array([None], pa.binary())], schema=_ANSWERS)
            return u, counts

        for batch in batches:
            for kind, *row in zip(*(column(batch, c).to_pylist() for c in ("kind", "chunk", "part", "shard", "body")), strict=True):
                if row[2] != now:
                    if now is not None and table is None:
                        yield from closed()
                    now, held, table = row[2], [], None
                if kind == 0:
                    held.append(row)
                    continue
                if table is None:
                    table = yield from closed()
                    held = []
                u, counts = table
                keys = _keys(row[3])
                at = np.searchsorted(u, keys)
                yield answer(row, np.where(np.append(u, 0)[at] == keys, at, len(u)), counts)  # the last count is 0
        if now is not None and table is None:
            yield from closed()

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _scores(tokens: tuple[int, int], vocabulary: int, held_out: bool):
    """Scores of each chunk's documents: its own row comes first, then the answers in the order of shards."""

    def run(batches):
        return_memory()
        for _, rows in grouped(batches, ["chunk"]):
            first, *answers = (_apart(x.as_py()) for x in rows.column("body"))
            ids = pa.array(from_bytes(first[0]).view(np.int64), mask=from_bytes(first[1]).astype(bool))
            sizes, vocab, places = from_bytes(first[2]).astype(np.int64), np.frombuffer(first[3], np.uint64), from_bytes(first[4]).astype(np.int32)
            grams, n, goal = _Grams(vocab, places, sizes), len(sizes), from_bytes(first[5]).astype(bool)
            del first, places, rows, grams.keys
            doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
            means = []
            for m in (0, 1):
                counts, filled = np.empty(sum(int.from_bytes(x[m][:8], "little") for x in answers)), 0
                for x in answers:
                    part = from_bytes(x[m])
                    counts[filled : filled + len(part)] = part
                    filled += len(part)
                losses = grams.held_out_losses(counts, tokens[m], vocabulary, sizes, goal == (m == 0)) if held_out else grams.losses(counts, tokens[m], vocabulary)
                means.append(np.bincount(doc, weights=losses, minlength=n) / np.maximum(sizes, 1))
            none = sizes == 0
            yield pa.record_batch([ids, pa.array(sizes), *(pa.array(x, mask=none) for x in (*means, means[0] - means[1]))], schema=_SCORES)

    return run


class Models:
    """Counts of both models by chunk and shard, and the number of shards; to the driver come the tokens of both sides."""

    def __init__(self, chunks: DataFrame, shards: int):
        self.chunks, self.shards = chunks, shards
        got = chunks.where("shard < 0").agg(F.sum("n_target").alias("t"), F.sum("n_background").alias("b")).first()
        self.tokens = (got["t"] or 0, got["b"] or 0)


def _rows(docs: DataFrame, id_col: str, text_col: str, target) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), target.alias("target"))


def with_target(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with target: true if the doc_id is among ``ids``."""
    ids = materialise(ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "target")
    if ids.count() <= BROADCAST_ROWS:
        return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    return joined_with(docs.select("doc_id", "text"), ids, "doc_id", "left")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target") -> Models:
    """Count every row of ``docs``; rows whose target (boolean) is true make the target model, all others the background."""
    rows = _rows(docs, id_col, text_col, F.coalesce(F.col(target_col), F.lit(False)))
    n = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("size")).first()["size"] or 0
    shards = n * max(1, math.ceil(size / (n * SHARD_BYTES)))
    return Models(materialise(rows.mapInArrow(_chunks(shards), _CHUNKS_SQL), "chunks", **PLAIN), shards)


def _in_rounds(rows: DataFrame, by: str, order: list[str], run, schema: str, name: str, **options: str) -> DataFrame:
    """What ``run`` makes of ``rows``, dealt to tasks by the numbers in ``by`` and sorted there, written a round at a time."""
    n = partitions(rows.sparkSession)
    dealt = [rows.where(F.col(by) % ROUNDS == i).repartitionById(n, F.expr(f"cast({by} div {ROUNDS} as int)")) for i in range(ROUNDS)]
    return reduce(DataFrame.unionByName, [materialise(x.sortWithinPartitions(*order).mapInArrow(run, schema), name, swept=True, **options) for x in dealt])


def score(models: Models, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", held_out: bool = False) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (their difference) of every row of ``docs``, or of those that ``models`` counted.

    held_out: each counted document is scored by models less its own counts, so that none vouches for itself; not for ``docs``
    of their own, which the models have not counted as these rows. Losses are natural logarithms per token; a null, empty or blank text has no tokens and null losses. Equal texts score
    alike; words that no counted row has share one more place of the vocabulary. Rows that share an id, or have none, keep
    one row each. Other columns are ignored. An empty table gives an empty table.
    """
    if held_out and docs is not None:
        raise ValueError("only counted documents can be held out")
    chunks = models.chunks if docs is None else materialise(_rows(docs, id_col, text_col, F.lit(False)).mapInArrow(_chunks(models.shards), _CHUNKS_SQL), "chunks", **PLAIN)
    sent = models.chunks.where("shard >= 0").select(F.lit(0).alias("kind"), "chunk", "part", "shard", "body")
    if docs is not None:
        sent = sent.unionByName(chunks.where("shard >= 0").select(F.lit(1).alias("kind"), "chunk", "part", "shard", "body"))
    answers = _in_rounds(sent, "shard", ["shard", "kind"], _add_up(docs is None), _ANSWERS_SQL, "answers", **PLAIN)
    vocabulary = answers.agg(F.sum("words").alias("v")).first()["v"] or 0
    whole = chunks.where("shard < 0").select("chunk", "part", "shard", "body").unionByName(answers.where("chunk is not null").select("chunk", "part", "shard", "body"))
    return _in_rounds(whole, "part", ["chunk", "shard"], _scores(models.tokens, vocabulary, held_out), _SCORES_SQL, "scores")
