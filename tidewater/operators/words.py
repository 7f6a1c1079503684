"""Pairs of neighbouring words, counted where they are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.query import table

#: Words whose pairs are counted at once; a longer document is counted alone.
PIECE_WORDS = 1_000_000


def documents_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)").alias("ws")).where("size(ws) > 1")


def both_ways(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at most two places apart, both ways round."""
    found = []
    for d in (1, 2):
        same = doc[d:] == doc[:-d]
        found += [(code[:-d][same], code[d:][same]), (code[d:][same], code[:-d][same])]
    return tuple(np.concatenate(side) for side in zip(*found))


def around(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's different neighbours at most two places away."""
    sides: list[np.ndarray] = []
    for d in (-2, -1, 1, 2):
        near = np.full(len(code), -1, code.dtype)
        to, of = (slice(None, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(None, d))
        near[to] = np.where(doc[of] == doc[to], code[of], -1)
        for other in sides:
            near[near == other] = -1
        sides.append(near)
    return tuple(np.concatenate(side) for side in zip(*((code[n >= 0], n[n >= 0]) for n in sides)))


def counted(words: DataFrame, pairs: Callable) -> DataFrame:
    """(a, b, n): how often ``pairs`` gives two words, over the arrays of words of all rows.

    A task sums the pairs of a piece of its rows before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE_WORDS, "right")) - 1)
                piece = lists.slice(lo, hi - lo)
                codes = piece.flatten().dictionary_encode()
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                a, b = pairs(codes.indices.to_numpy().astype(np.int64), doc)
                key, n = np.unique(a * len(codes.dictionary) + b, return_counts=True)
                a, b = np.divmod(key, len(codes.dictionary))
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(a)), codes.dictionary.take(pa.array(b)), pa.array(n)], names=["a", "b", "n"])
                lo = hi

    return words.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
