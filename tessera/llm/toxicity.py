"""Toxicity by a weighted lexicon.

Texts are folded (case, width, homoglyphs, digits that stand for letters, symbols inside words), an
Aho-Corasick automaton finds every lexicon entry that starts a word, entries inside an exception phrase are
dropped, and the weights' sum is normalised by length. The lexicon, the exceptions and the calibration are learned.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, column, materialise

#: Labelled rows of each label that the lexicon is learned from, about; a hash of the id picks them. The model's only bound.
TRAIN_PER_LABEL = 8000
#: Least log-likelihood ratio and least weight (log odds ratio) of a lexicon entry; what a longer stem must weigh beyond a shorter one.
LEAST_G2, LEAST_WEIGHT, GAIN = 18.0, 1.2, 0.7
STEM_LENGTHS = range(4, 15)
#: Toxic documents that an entry, and clean ones that an exception, must have.
LEAST_DOCS = 3

#: Characters that look like Latin letters, and digits and symbols that stand for them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}
INSIDE = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_INSIDE = re.compile(r"(?<=[^\W\d_])[@$!|+](?=[^\W\d_])")


class _Fold(dict):
    """Translation of single characters, worked out when first met: a base letter, or a space."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        out = HOMOGLYPHS.get(ch)
        if out is None:
            base = "".join(HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKC", ch).lower())
            out = base if base and all(c.isalpha() for c in base) else "" if unicodedata.combining(ch) or unicodedata.category(ch) == "Cf" else " "
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, each between single or more spaces."""
    if "@" in text or "$" in text or "!" in text or "|" in text or "+" in text:
        text = _INSIDE.sub(lambda m: INSIDE[m[0]], text)
    return " " + text.lower().translate(_FOLD) + " "


@dataclass
class Lexicon:
    #: Stems at a word's start, with their weights.
    weights: dict[str, float]
    #: Folded phrases in which an entry does not count.
    exceptions: list[str] = field(default_factory=list)
    threshold: float = 0.5
    slope: float = 1.0
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None and self.weights:
            import ahocorasick

            a = ahocorasick.Automaton()
            for s, w in self.weights.items():
                a.add_word(" " + s, (w, len(s)))
            for s in self.exceptions:
                a.add_word(" " + s + " ", (None, len(s)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def raw(self, text: str | None) -> tuple[float, int]:
        """Weight sum normalised by length, and the entries that counted."""
        a = self._built()
        if not text or a is None:
            return 0.0, 0
        folded = fold(text)
        hits, spans = [], []
        for end, (w, n) in a.iter(folded):
            if w is None:
                spans.append((end - n, end - 1))
            else:
                hits.append((end - n + 1, w))
        if not hits:
            return 0.0, 0
        if spans:
            spans.sort()
            starts, ends, far = [x for x, _ in spans], [], -1
            for _, y in spans:
                far = max(far, y)
                ends.append(far)
            hits = [h for h in hits if not (i := bisect_right(starts, h[0])) or ends[i - 1] < h[0]]
        best: dict[int, float] = {}
        for at, w in sorted(hits, key=lambda h: h[0]):  # longer stems end later: the longest of a word stays
            best[at] = w
        words = folded.count(" ")
        return sum(best.values()) / math.sqrt(1.0 + math.log1p(words)), len(best)

    def score(self, text: str | None) -> tuple[float, int]:
        x, n = self.raw(text)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * (x - self.threshold))))), n


def stems(words: set[str]) -> set[str]:
    """The beginnings of words that an entry may be."""
    return {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k} | {w for w in words if len(w) == 3}


def entries(docs: dict[str, tuple[int, int]], n: tuple[int, int]) -> dict[str, float]:
    """Stems and weights from how many clean and toxic documents hold each stem, and how many there are.

    A stem's weight is the logarithm of how much oftener it starts a word in toxic documents. It is kept if that is too
    often for chance, and if it says more than every shorter stem kept. Of stems that stand for the same documents the
    longest stays. Without documents of both labels there are none.
    """
    if not n[0] or not n[1]:
        return {}
    rate = n[1] / (n[0] + n[1])

    def g2(a: int, b: int) -> float:
        e = (a + b) * rate
        return 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0.0)) if a > e else 0.0

    def weight(a: int, b: int) -> float:
        return math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))

    good = {s: (weight(a, b), a, b) for s, (b, a) in docs.items() if a >= LEAST_DOCS and g2(a, b) >= LEAST_G2 and weight(a, b) >= LEAST_WEIGHT}
    longest: dict[str, str] = {}
    for s in sorted(good, key=lambda x: (-len(x), x)):  # a stem gives way to a longer one that nearly the same documents have
        t = longest.get(s, s)
        for k in range(3, len(s)):
            c = good.get(s[:k])
            if c and good[t][1] >= 0.95 * c[1] and good[t][2] >= 0.95 * c[2] and len(longest.get(s[:k], "")) < len(t):
                longest[s[:k]] = t
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda x: (len(x), x)):
        if s in longest:
            continue
        shorter = [kept[s[:k]] for k in range(3, len(s)) if s[:k] in kept]
        if not shorter or good[s][0] >= max(shorter) + GAIN:
            kept[s] = good[s][0]
    return kept


def phrases(words: list[str], stems) -> set[str]:
    """Pairs of neighbours of which one starts with a stem."""
    out = set()
    for i, x in enumerate(words):
        if any(x[:k] in stems for k in range(3, len(x) + 1)):
            out.update(" ".join(p) for p in (words[max(0, i - 1) : i + 1], words[i : i + 2]) if len(p) == 2)
    return out


def calibrated(lex: Lexicon, raws) -> Lexicon:
    """Threshold and slope from (normalised sum, toxic) rows: the cut with fewest errors, a third into its gap."""
    rows = sorted(raws)
    lex.threshold, lex.slope = 1.0, 4.0
    n1 = sum(y for _, y in rows)
    if not n1:
        return lex
    best, left = None, [0, 0]
    for i in range(len(rows) - 1):
        left[rows[i][1]] += 1
        gap = rows[i + 1][0] - rows[i][0]
        if gap > 0:
            wrong = left[1] + (len(rows) - n1 - left[0])
            if best is None or (wrong, -gap) < best[:2]:
                best = (wrong, -gap, rows[i][0] + gap / 3)
    if best:
        lex.threshold = best[2]
        lex.slope = 4.0 / best[2]
    return lex


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, exceptions: list[str] | None = None) -> Lexicon:
    """Learn from ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1.

    About ``per_label`` ids of each label are used; tasks count in how many documents stems and phrases occur, and the driver
    gets those that occur often enough and one sum a document, not texts. Phrases of a stem's word and a neighbour that at
    least three clean documents have and toxic ones lack become exceptions, beside those given. Labels other than 0 and 1, null
    ones, and those without an id are left out; a label that is repeated counts once, an id with both labels once for each.
    Without documents of both labels the lexicon is empty and every score is that of a text without an entry.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    span = 1 << 30
    share = {y: int(span * min(1.0, per_label / max(1, sizes.get(y, 0)))) for y in (0, 1)}
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))  # about 2 x per_label ids
    sample = materialise(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("text", "toxic"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def counted(find) -> DataFrame:
        """(value, clean, toxic): in how many documents of each label ``find`` finds a value."""
        return sample.mapInArrow(_count_texts(find), "value string, clean long, toxic long").groupBy("value").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    found = counted(lambda t: stems(set(fold(t).split()))).where(F.col("toxic") >= LEAST_DOCS).toLocalIterator()
    kept = entries({r["value"]: (r["clean"], r["toxic"]) for r in found}, (n.get(0, 0), n.get(1, 0)))
    given = [" ".join(fold(x).split()) for x in exceptions or []]
    if not kept:
        return Lexicon({}, given, 1.0, 4.0)
    shared = Shipped(spark, kept)
    near = counted(lambda t: phrases(fold(t).split(), shared.get())).where((F.col("clean") >= LEAST_DOCS) & (F.col("toxic") == 0))
    lex = Lexicon(kept, given + sorted(r["value"] for r in near.toLocalIterator()))
    ready = Shipped(spark, lex)
    raws = sample.mapInArrow(_raws(ready), "value double, toxic int").collect()  # one number a sampled document
    return calibrated(lex, [(r["value"], r["toxic"]) for r in raws])


def _count_texts(find):
    schema = pa.schema([("value", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        counts = [Counter(), Counter()]
        for batch in batches:
            for t, y in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
                counts[y].update(find(t))
        values = list(counts[0].keys() | counts[1].keys())
        for lo in range(0, len(values), 1 << 16):
            some = values[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(some, pa.string()), *(pa.array([c[v] for v in some], pa.int64()) for c in counts)], schema=schema)

    return run


def _raws(shared):
    def run(batches):
        lex = shared.get()
        for batch in batches:
            yield pa.record_batch([pa.array([lex.raw(t)[0] for t in column(batch, "text").to_pylist()], pa.float64()), column(batch, "toxic")], names=["value", "toxic"])

    return run


def _apply(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

    def run(batches):
        lex = shared.get()
        for batch in batches:
            found = [lex.score(t) for t in column(batch, "text").to_pylist()]
            yield pa.record_batch([column(batch, "doc_id"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], schema=schema)

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_hits of every row of ``docs``.

    Null and empty texts score as texts without an entry; texts are read whole, however long; equal texts score alike; rows
    that share an id, or have none, keep one row each; an empty table gives an empty table; other columns are ignored,
    whatever their names.
    """
    shared = Shipped(docs.sparkSession, lexicon)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_apply(shared), "doc_id long, score double, n_hits long")
