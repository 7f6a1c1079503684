"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators of word unigrams, word bigrams, byte trigrams and of the share of bigrams that repeat a
word are hashed to CELLS cells. Each cell is
scaled by the log-count ratio of the two classes; a linear hinge-loss model over the scaled, length-one
vectors is fit by dual coordinate descent, and its margin is turned into a probability by a logistic
curve fit on a part of the sample that the model did not see.

Only the classifier is fit on a sample: about ``max_rows`` labelled documents, whole, chosen by a
hash of their ids. Every document is scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.text import TABLE_RAW, U64, column_bytes, mix, slices, word_hashes

CELLS = 1 << 18


def _cells(data: np.ndarray, offsets: np.ndarray):
    """For each text, the cells of its n-grams, with repeats."""
    words, at = word_hashes(data, offsets, TABLE_RAW)
    low = U64(CELLS - 1)
    pair = np.zeros(len(words), U64)
    pair[:-1] = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])
    one, two = (words & low).astype(np.int32), (pair & low).astype(np.int32)
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        parts = [one[a:b], two[a : max(a, b - 1)], _shape(words[a:b])]
        text = data[offsets[i] : offsets[i + 1]].astype(np.uint32)
        if len(text) > 2:
            three = (text[:-2] << np.uint32(16)) | (text[1:-1] << np.uint32(8)) | text[2:]
            parts.append(((three * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32))
        yield np.concatenate(parts)


def _shape(words: np.ndarray) -> np.ndarray:
    """Cells of how often a word follows itself: one set for each share of the bigrams that is reached."""
    if len(words) < 2:
        return np.empty(0, np.int32)
    share = (words[1:] == words[:-1]).mean()
    reached = np.flatnonzero(share >= np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8]))
    return (mix(np.arange(1 << 40, (1 << 40) + 16 * len(reached), dtype=U64)) & U64(CELLS - 1)).astype(np.int32)


def _distinct(cells: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each cell once, without a sort; scratch is an int32 array of CELLS."""
    order = np.arange(len(cells), dtype=np.int32)
    scratch[cells] = order
    return cells[scratch[cells] == order]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, cost: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """(weight per cell, bias, slope, intercept) from distinct-cell arrays and 0/1 labels."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held = set(order[: max(1, len(rows) // 5)].tolist())
    train = np.array([i for i in order if i not in held])
    counts = np.ones((2, CELLS))
    for i in train:
        counts[labels[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = []
    for i in range(len(rows)):
        x = ratio[rows[i]]
        scaled.append((x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32))
    w, bias = np.zeros(CELLS), 0.0
    share = max(1, labels[train].sum()), max(1, (1 - labels[train]).sum())
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(train):
            y = 1.0 if labels[i] else -1.0
            bound = cost * len(train) / (2 * share[0 if labels[i] else 1])  # both classes weigh the same
            cells, x = rows[i], scaled[i]
            gradient = y * (w[cells] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound)  # |x|^2 + 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[cells] += step * x
                bias += step
                alpha[i] = new
    margins = np.array([w[rows[i]] @ scaled[i] + bias for i in held])
    target = labels[list(held)].astype(float)
    slope, intercept = 2.0, 0.0
    for _ in range(50):  # Newton steps for the logistic curve, with a weak prior
        p = 1 / (1 + np.exp(-np.clip(slope * margins + intercept, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-2 * (slope - 2), (p - target).sum() + 1e-2 * intercept])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * margins * margins).sum() + 1e-2, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-2]])
        slope, intercept = np.array([slope, intercept]) - np.linalg.solve(h, g)
    return (w * ratio).astype(np.float32), ratio.astype(np.float32), float(bias), float(slope), float(intercept)


def train(labelled: DataFrame, max_rows: int = 6000):
    """The model from (doc_id, text, label) rows, label 0 or 1; None without rows of both labels."""
    total = labelled.count()
    if not total:
        return None
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, max_rows / total))))

    def features(batches):
        scratch = np.zeros(CELLS, np.int32)
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            data, offsets = column_bytes(batch.column(0))
            packed = [_distinct(c, scratch).tobytes() for c in _cells(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], names=["cells", "label", "h"])

    def fit(batches):
        rows, labels, keys = [], [], []
        for batch in batches:
            rows += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)]
            labels += batch.column(1).to_pylist()
            keys += batch.column(2).to_pylist()
        if len(set(labels)) == 2:
            order = sorted(range(len(rows)), key=lambda i: (keys[i], rows[i].tobytes()))
            weight, ratio, bias, slope, intercept = fit_rows([rows[i] for i in order], np.array(labels)[order])
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()]), pa.array([ratio.tobytes()]), pa.array([[bias, slope, intercept]])], names=["weight", "ratio", "rest"])

    parts = chosen.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h")).mapInArrow(features, "cells binary, label int, h long")
    found = parts.repartition(1).mapInArrow(fit, "weight binary, ratio binary, rest array<double>").collect()
    if not found:
        return None
    return np.frombuffer(found[0]["weight"], np.float32), np.frombuffer(found[0]["ratio"], np.float32), *found[0]["rest"]


def score(documents: DataFrame, model, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row; without a model every score is 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scratch = np.zeros(CELLS, np.int32)
        for batch in (part for whole in batches for part in slices(whole, text, 1 << 20)):
            data, offsets = column_bytes(batch.column(2))
            out = np.full(batch.num_rows, 0.5)
            if shared.value is not None:
                weight, ratio, bias, slope, intercept = shared.value
                for i, cells in enumerate(_cells(data, offsets)):
                    cells = _distinct(cells, scratch)
                    r = ratio[cells]
                    margin = float(weight[cells].sum(dtype=np.float64)) / max(1e-12, float(np.sqrt((r * r).sum(dtype=np.float64)))) + bias
                    out[i] = 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["doc_id", "held_out", "score"])

    return documents.select("doc_id", held_out().alias("held_out"), text).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def held_out(folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves ``fold``; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels are learnt only from documents that are not held out; null labels are not learnt from, and
    of differing labels of one id the lower counts. Null and empty texts are scored by the bias alone.
    With labels of one value only, every score is 0.5. Repeated rows get equal scores.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label")).where(~held_out())
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
    model = train_on(rows, known, max_rows)
    return score(documents, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train_on(rows: DataFrame, known: DataFrame, max_rows: int):
    """Samples the labels before they meet the texts, so that only sampled texts are shuffled."""
    total = known.count()
    if not total:
        return None
    sampled = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, max_rows / total))))
    near = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, max_rows / total))))
    return train(near.join(sampled, "doc_id"), 10 * max_rows)


def op1_nb_svm(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_nb_svm": op1_nb_svm}
ORACLES: dict[str, str] = {}
