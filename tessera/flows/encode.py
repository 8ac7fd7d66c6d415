"""Vectors of words that a frame lacks, by an encoder that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An encoder takes texts and gives a vector of each.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
BATCH = 256


def memoised(encoder: Encoder) -> Encoder:
    """The encoder, asked once for each text."""
    known: dict[str, Sequence[float]] = {}

    def run(texts: Sequence[str]) -> list[Sequence[float]]:
        new = [t for t in dict.fromkeys(texts) if t not in known]
        if new:
            known.update(zip(new, encoder(new), strict=True))
        return [known[t] for t in texts]

    return run


def centred(encoder: Encoder, mean: Sequence[float]) -> Encoder:
    """The encoder less a mean vector."""
    return lambda texts: [[x - m for x, m in zip(v, mean, strict=True)] for v in encoder(texts)]


def encode_missing(words: DataFrame, stored: DataFrame, frame_id: str, encoder: Encoder, dim: int, kind: str = "board_word", batch: int = BATCH) -> DataFrame:
    """Rows (frame_id, text, kind, embedding) of the distinct lower-cased ``words`` (word) that ``stored`` lacks for the frame.

    The encoder is called in the tasks with at most ``batch`` texts; vectors of another length are an error. Words that
    are stored are not asked for, so that a second run has no rows.
    """
    have = stored.where(F.col("frame_id") == frame_id).select(F.lower("text").alias("text")).distinct()
    new = words.select(F.lower("word").alias("text")).where("text is not null").distinct().join(have, "text", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                texts = frame.text.iloc[lo : lo + batch].tolist()
                vectors = [[float(x) for x in v] for v in encoder(texts)]
                if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"the encoder gave other than {len(texts)} vectors of {dim} components")
                yield pd.DataFrame({"frame_id": frame_id, "text": texts, "kind": kind, "embedding": vectors})

    return new.mapInPandas(run, "frame_id string, text string, kind string, embedding array<float>")
