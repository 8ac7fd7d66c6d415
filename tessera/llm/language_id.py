"""Language identification as mixture inference.

A model holds one multinomial over hashed character trigrams per language. For each document
expectation-maximisation estimates the languages' proportions; the set of languages is the one of
highest likelihood less a penalty per language, and the largest proportion names the document. Beside the chosen
languages a uniform model stands for all unlearned ones; the proportion it takes tells how much no language explains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, column

#: Hash buckets of trigrams: a power of two.
BUCKETS = 1 << 15
#: Documents a language is learned from, about: above that a hash of the id picks so many. The model's only bound.
TRAIN_PER_LANG = 3000
#: Log-likelihood that a further language must add, times the logarithm of the trigrams.
PENALTY = 3.0
ROUNDS = 12
UNKNOWN = "und"


def _alphabet() -> np.ndarray:
    """Code point (up to 0xFFFF) to symbol: letters stay, all else is 0."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = c
    return out


_ALPHA: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(_alphabet())
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = cp > 0xFFFF
    if wide.any():
        s = _ALPHA[0][np.where(wide, 0, cp)]
        for i in np.flatnonzero(wide):
            s[i] = cp[i] if chr(cp[i]).isalpha() else 0
        return s
    return _ALPHA[0][cp]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often; none if the text has no letter. Runs of other characters are one gap."""
    s = _symbols(text)
    gap = s == 0
    s = s[~(gap & np.concatenate(([False], gap[:-1])))]
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate((([0] if s[0] else []), s, ([0] if s[-1] else []))).astype(np.uint32)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA6B) + s[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    full = np.bincount(h >> np.uint32(32 - 15), minlength=BUCKETS)
    at = np.flatnonzero(full)
    return at, full[at]


@dataclass
class Model:
    langs: list[str]
    #: Likelihood of each bucket under each language: BUCKETS x languages.
    p: np.ndarray
    #: Trigrams that each language was learned from.
    sizes: tuple[float, ...] = ()

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """Languages and proportions, largest first; empty if the text is null, has no letter, or nothing is learned."""
        return self.judged(text)[0]

    def judged(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The mixture, and the share of the text in no learned language, less two standard errors (0 without a mixture)."""
        if not text or not self.langs:
            return [], 0.0
        at, c = trigram_counts(text)
        if not len(at):
            return [], 0.0
        p, c = self.p[at], c.astype(np.float64)
        total = c.sum()
        pi = np.full(p.shape[1], 1 / p.shape[1])
        pi, ll = self._em(p, c, total, pi, ROUNDS)
        order = np.lexsort((np.arange(len(pi)), -pi))
        order = np.concatenate((order[:1], order[1:][pi[order[1:]] > 0.5 / total]))  # the largest always stays
        best, cost = None, PENALTY * np.log(total + 1)
        for k in range(1, len(order) + 1):
            sub = order[:k]
            if k == len(pi):
                q, l = pi[sub], ll
            elif k == 1:
                q, l = np.ones(1), float(c @ np.log(p[:, sub[0]]))
            else:
                q, l = self._em(p[:, sub], c, total, pi[sub] / pi[sub].sum(), ROUNDS // 2)
            value = l - cost * (k - 1)
            if best is not None and value <= best[0]:
                break
            best = (value, sub, q)
        _, sub, q = best
        both = np.column_stack((p[:, sub] @ q, np.full(len(at), 1 / BUCKETS)))
        share = float(self._em(both, c, total, np.full(2, 0.5), ROUNDS)[0][1])
        unlearned = share - 2 * np.sqrt(max(0.0, share * (1 - share)) / total)
        found = sorted(((self.langs[i], float(x)) for i, x in zip(sub, q, strict=True)), key=lambda t: (-t[1], t[0]))
        return found, min(1.0, max(0.0, float(unlearned)))

    @staticmethod
    def _em(p, c, total, pi, rounds):
        for _ in range(rounds):
            mixed = p @ pi
            new = pi * ((c / mixed) @ p) / total
            if np.abs(new - pi).max() < 1e-4:
                pi = new
                break
            pi = new
        return pi, float(c @ np.log(p @ pi))


def _histograms(batches):
    """Partial trigram counts per language of one task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            at, c = trigram_counts(text)
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang][at] += c
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """Learn from rows of (doc_id, text, lang); rows with a null text or lang are left out.

    Languages with more than ``per_lang`` rows are learned from about so many, picked by a hash of the id; rows that share an
    id, or have none, are picked together. Long texts count whole. What comes to the driver is one histogram per language.
    """
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    span = 1 << 30
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(span * min(1.0, per_lang / n))))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share[F.col("lang")])
    counts = picked.select("lang", "text").mapInArrow(_histograms, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():  # at most BUCKETS rows a language
        by.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    langs = sorted(by)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)))
    pooled = sum(by.values()) + 0.5
    pooled /= pooled.sum()
    p = np.stack([(by[x] + 200.0 * pooled) / (by[x].sum() + 200.0) for x in langs], 1)
    return Model(langs, p, tuple(float(by[x].sum()) for x in langs))


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64())), ("unlearned", pa.float64())])

    def run(batches):
        m = model.get()
        for batch in batches:
            judged = [m.judged(t) for t in column(batch, "text").to_pylist()]
            found = [x for x, _ in judged]
            yield pa.record_batch(
                [column(batch, "doc_id"), pa.array([x[0][0] if x else UNKNOWN for x in found]), pa.array([min(1.0, max(0.0, x[0][1])) if x else 0.0 for x in found]), pa.array(found, schema.field("mixture").type), pa.array([u for _, u in judged], pa.float64())], schema=schema
            )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion), mixture (each chosen language's proportion), unlearned of every row of ``docs``.

    ``unlearned`` is a lower bound of the share of the text that is in none of the learned languages.

    A null text, or one without a letter, is ``und`` with score 0 and an empty mixture; so is every text if nothing was
    learned. Texts are read whole, however long. Equal texts get equal results; ties go to the smaller language name. Rows
    that share an id, or have none, keep one row each. Other columns are ignored, whatever their names; an empty table gives
    an empty table.
    """
    shared = Shipped(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, mixture map<string,double>, unlearned double")
