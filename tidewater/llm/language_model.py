"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The model gives each next token P(class | context) * P(token | class, context). Both factors are
log-linear in hashed features of the context: the word before (n-gram), the one before that (skip)
and the pair. All words on the frequent list (those with a share of 1 / ``listed`` of all tokens or
more) are predicted one by one. By falling count they fall into CLASSES of equal mass; a class's words
are told apart by factoring it in halves, again and again, so that a word costs as many factors as its
class has doublings. All rarer words form one more class, within which a token is as likely as its
smoothed count says. The probabilities of all tokens sum to one.

Counts cover all training documents. Training reads each of them once: tasks make gradient updates
on their own tokens, and the changes of all tasks, averaged by tokens, are added after each round, of
which the first reads a quarter of the documents and the second the rest. The changes are summed in
a tree of FAN_IN, shard by shard. Word list and weights have sizes given as parameters; counts of rarer
words are joined, never gathered.

Tasks learn from their own share of the table, in seeded order. Reruns over the same files and settings
give the same scores; another split of the table gives slightly different weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut
from tidewater.llm.text import U64, column_bytes, mix, slices, word_hashes

#: Words whose counts every task gets: those with a share of 1 / FREQUENT of all tokens, so at most as many.
FREQUENT = 1 << 20
#: Classes of listed words, besides that of all others.
CLASSES = 16
#: Rows of the class factor's weights, one for each hashed feature, and weights of all halvings together.
ROWS, BITS = 1 << 14, 20
#: Changes summed at once, and the parts in which weights are summed.
FAN_IN, SHARDS = 16, 8
#: Tokens gathered by a task before it sends their counts.
GATHER = 1 << 22
BATCH = 1 << 14
RATE = 0.2

END = U64(0x1F83D9ABFB41BD6B)
START = U64(0x5BE0CD19137E2179)
#: First rows and sizes of the feature tables: word before, word before that, the pair.
_TABLES = ((0, 1 << 12), (1 << 12, 1 << 12), (1 << 13, 1 << 13))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and their offsets."""
    words, at = word_hashes(*column_bytes(column))
    n = len(at) - 1
    out = np.empty(len(words) + n, U64)
    ends = at[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = words
    return out, np.concatenate(([0], ends + 1))


def _contexts(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (3, n) for the class factor, and the hashes behind them for the word factor."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    heads = offsets[:-1][offsets[:-1] < len(h)]
    two[:2] = START
    one[heads] = START
    two[heads] = START
    second = heads + 1
    two[second[second < len(h)]] = START
    keys = np.stack((mix(one + U64(1)), mix(two + U64(2)), mix(one * U64(0x9E3779B97F4A7C15) + two)))
    rows = np.stack([a + (k >> U64(40)).astype(np.int64) % size for k, (a, size) in zip(keys, _TABLES)])
    return rows, keys


class Vocabulary:
    """Listed words with their counts, their classes, and their numbers in their classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        self.total, self.distinct = total, distinct
        mass = np.cumsum(counts, dtype=np.float64)
        self.klass = np.minimum(CLASSES - 1, CLASSES * (mass - counts / 2) / max(1.0, mass[-1] if len(mass) else 1.0)).astype(np.int32)
        start = np.searchsorted(self.klass, np.arange(CLASSES + 1))
        size = np.diff(start)
        self.number = (np.arange(len(hashes)) - start[self.klass]).astype(np.int32)
        depth = np.array([max(0, int(n) - 1).bit_length() for n in size], np.int32)
        # the halvings of a class are a heap: its first has the place of its class, plus 1
        self.base = np.concatenate(([0], np.cumsum(1 << depth)))
        self.depth = depth[self.klass]
        self.bias = np.zeros(int(self.base[-1]) + 1, np.float32)
        for k in np.flatnonzero(depth):
            level = np.zeros(1 << depth[k])
            level[: size[k]] = counts[start[k] : start[k + 1]] + 0.5
            while len(level) > 1:
                left, right = level[::2], level[1::2]
                held = np.where(right > 0, np.log(np.maximum(right, 1e-30) / np.maximum(left, 1e-30)), -60.0)
                self.bias[self.base[k] + len(left) : self.base[k] + 2 * len(left)] = np.clip(held, -60.0, 60.0)
                level = left + right
        of_class = np.bincount(self.klass, weights=counts, minlength=CLASSES)
        of_class = np.concatenate((of_class, [max(0.0, total - of_class.sum())])) + 0.5
        self.class_bias = np.log(of_class / of_class.sum()).astype(np.float32)
        self.class_bias[:CLASSES][size == 0] = -60.0  # never asked for
        sort = np.argsort(hashes)
        self.sorted, self.counts, self.place = hashes[sort], counts[sort], sort.astype(np.int32)
        rest = max(0.0, total + distinct + 1 - float((counts + 1).sum()))
        self.log_rest = float(np.log10(max(rest, 1.0)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places on the list and counts of distinct hashes, -1 for those that are not on it."""
        if not len(self.sorted):
            return np.full(len(h), -1, np.int32), np.full(len(h), -1, np.int64)
        spot = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        hit = self.sorted[spot] == h
        return np.where(hit, self.place[spot], np.int32(-1)), np.where(hit, self.counts[spot], -1)


class Model:
    """Weights of both factors. A token is given by its place on the list, -1 if it is not on it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.classes = np.zeros((ROWS, CLASSES + 1), np.float32)
        self.halves = np.zeros(1 << BITS, np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate((self.classes.ravel(), self.halves))

    def load(self, flat: np.ndarray) -> None:
        cut_ = self.classes.size
        self.classes, self.halves = flat[:cut_].reshape(self.classes.shape).copy(), flat[cut_:].copy()

    def _klass(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.v.klass[place], CLASSES) if len(self.v.klass) else np.full(len(place), CLASSES)

    def _softmax(self, rows) -> np.ndarray:
        x = self.classes[rows[0]]
        x += self.classes[rows[1]]
        x += self.classes[rows[2]]
        x += self.v.class_bias
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def _halvings(self, keys, place):
        """For every halving on the way to every listed token: the token, the side taken, the weights asked and their sum."""
        v = self.v
        listed = np.flatnonzero(place >= 0)
        if not len(listed):
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, np.zeros((3, 0), np.int64), np.zeros(0, np.float32)
        at = place[listed]
        depth = v.depth[at]
        token = np.repeat(listed, depth)
        left = np.repeat(np.cumsum(depth), depth) - np.arange(1, len(token) + 1)  # halvings still to come after this one
        path = np.repeat((np.int64(1) << depth.astype(np.int64)) + v.number[at], depth) >> left
        side = path & 1
        path >>= 1
        node = np.repeat(v.base[v.klass[at]], depth) + path
        spots = np.repeat(keys[:, listed], depth, axis=1)
        spots ^= node.astype(U64) * U64(0xD1342543DE82EF95)
        spots *= U64(0x9E3779B97F4A7C15)
        spots >>= U64(64 - BITS)
        spots = spots.view(np.int64)
        x = v.bias[node] + self.halves[spots[0]] + self.halves[spots[1]] + self.halves[spots[2]]
        return token, side, spots, x

    def log10_probability(self, rows, keys, place) -> np.ndarray:
        """Per token; of tokens that are not listed only that of their class."""
        n = len(place)
        p = self._softmax(rows)
        out = np.log(np.maximum(p[np.arange(n), self._klass(place)], 1e-30)).astype(np.float64)
        token, side, _, x = self._halvings(keys, place)
        x *= 1 - 2 * side.astype(np.float32)
        out -= np.bincount(token, weights=np.log1p(np.exp(np.clip(x, -60, 60))), minlength=n)
        return out / np.log(10)

    def update(self, rows, keys, place, seen) -> None:
        """One gradient step on a batch, with a rate for each weight that falls as it is updated."""
        g = self._softmax(rows)
        g[np.arange(len(place)), self._klass(place)] -= 1
        self._apply(self.classes, seen[0], rows, g)
        _, side, spots, x = self._halvings(keys, place)
        g = 1 / (1 + np.exp(-np.clip(x, -60, 60))) - side
        total = np.bincount(spots.ravel(), weights=np.tile(g, 3), minlength=len(self.halves)).astype(np.float32)
        squares = seen[1]
        squares += total * total
        total *= RATE
        total /= np.sqrt(squares + 1.0)
        self.halves -= total

    @staticmethod
    def _apply(table, seen, rows, g) -> None:
        width = table.shape[1]
        flat = g.ravel()
        for r, (a, size) in zip(rows, _TABLES):
            cell = ((r - a)[:, None] * width + np.arange(width)).ravel()
            total = np.bincount(cell, weights=flat, minlength=size * width).reshape(size, width).astype(np.float32)
            seen[a : a + size] += total * total
            table[a : a + size] -= RATE * total / np.sqrt(seen[a : a + size] + 1.0)


def _parts(batches, index: int, text: str):
    for whole in batches:
        for part in slices(whole, text, 1 << 20):
            yield part, *tokens(part.column(index))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in a one-column table of texts."""
    name = texts.columns[0]

    def run(batches):
        held, n = [], 0

        def sums():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)].view(np.int64)), pa.array(c[i : i + (1 << 17)].astype(np.int64))], names=["h", "c"])

        for _, h, _ in _parts(batches, 0, name):
            held.append(h)
            n += len(h)
            if n >= GATHER:
                yield from sums()
                held, n = [], 0
        if held:
            yield from sums()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: tuple[tuple[int, int], ...] = ((0, 1), (1, 4))) -> np.ndarray:
    """Averaged weights. texts: (text, part 0 to 3); ``rounds`` are ranges of parts.

    Each task sends its change of the weights, times its tokens, in SHARDS rows of fixed size. FAN_IN
    tasks' rows are summed at a time, shard by shard, until one row of each shard is left for the driver.
    """
    sc = texts.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    flat = Model(vocabulary).weights()
    names, schema = ["slot", "shard", "n", "change"], "slot long, shard int, n long, change binary"

    def row(slot, shard, n, change):
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([change.astype(np.float32).tobytes()], pa.binary())], names=names)

    for low, high in rounds:
        start = sc.broadcast(flat)

        def learn(batches):
            from pyspark import TaskContext

            model = Model(words.value)
            model.load(start.value)
            seen = np.zeros_like(model.classes), np.zeros_like(model.halves)
            n = 0
            for part, h, offsets in _parts(batches, 0, "text"):
                rows, keys = _contexts(h, offsets)
                distinct, back = np.unique(h, return_inverse=True)
                place = words.value.find(distinct)[0][back]
                order = np.random.default_rng(len(h)).permutation(len(h))
                for i in range(0, len(h), BATCH):
                    at = order[i : i + BATCH]
                    model.update(rows[:, at], keys[:, at], place[at], seen)
                n += len(h)
            if n:
                change = (model.weights() - start.value) * np.float32(n)
                for shard, piece in enumerate(np.array_split(change, SHARDS)):
                    yield row(TaskContext.get().partitionId(), shard, n, piece)

        def add(batches):
            sums: dict = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    slot, shard, n = (batch.column(k)[i].as_py() for k in range(3))
                    change = np.frombuffer(batch.column(3)[i].as_buffer(), np.float32)
                    before = sums.get((slot, shard))
                    sums[slot, shard] = (n, change.astype(np.float64)) if before is None else (before[0] + n, before[1] + change)
            for (slot, shard), (n, change) in sums.items():
                yield row(slot, shard, n, change)

        part = texts.where((F.col("part") >= low) & (F.col("part") < high)).select("text")
        changes, slots = part.mapInArrow(learn, schema), part.rdd.getNumPartitions()
        while slots > 1:
            slots = -(-slots // FAN_IN)
            changes = changes.withColumn("slot", F.expr(f"slot div {FAN_IN}")).repartition(slots * SHARDS, "slot", "shard").mapInArrow(add, schema)
        pieces = np.array_split(flat, SHARDS)
        for r in changes.collect():
            pieces[r["shard"]] = pieces[r["shard"]] + np.frombuffer(r["change"], np.float32) / np.float32(r["n"])
        flat = np.concatenate(pieces).astype(np.float32)
        start.unpersist()
    words.unpersist()
    return flat


def held_out(folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_documents(documents: DataFrame, text: str = "text", listed: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null or empty text is one END. Documents that are not held out, null ids among them, are learnt
    from; repeated rows are learnt from and scored as often. Without any, no token is known and the
    model is the base. Scores are log10 probabilities. ``listed`` (FREQUENT) bounds the words that are
    predicted one by one, and so what every task holds; the size of the weights is set by ROWS and BITS.
    Other columns are not read, whatever their names.
    """
    listed = listed or FREQUENT
    sc = documents.sparkSession.sparkContext
    docs = documents.select("doc_id", F.col(text).alias("text"), held_out().alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = cut(count_tokens(training.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("c") >= max(1, -(-total // listed))).toArrow()
    vocabulary = Vocabulary(frequent.column("h").to_numpy().view(U64), frequent.column("c").to_numpy(), total, distinct)
    split = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(4))
    flat = train(training.select("text", split.alias("part")), vocabulary)
    words, weights = sc.broadcast(vocabulary), sc.broadcast(flat)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["uid", "h", "tf", "whole"]
    whole = pa.struct([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64())])

    def run(batches):
        v = words.value
        model = Model(v)
        model.load(weights.value)
        for part, h, offsets in _parts(batches, 2, "text"):
            n = part.num_rows
            doc = np.repeat(np.arange(n), np.diff(offsets))
            rows, keys = _contexts(h, offsets)
            distinct_h, back = np.unique(h, return_inverse=True)
            place, count = v.find(distinct_h)
            place = place[back]
            likely = np.concatenate([model.log10_probability(rows[:, i : i + BATCH], keys[:, i : i + BATCH], place[i : i + BATCH]) for i in range(0, len(h), BATCH)])
            log = np.log10(np.maximum(count, 0) + 1.0)[back]
            other = place < 0
            known = (count > 0)[back]
            uid = part.column(1).to_numpy()
            # what is not on the list is looked up by a join: log10(c + 1) is added there
            rare = np.flatnonzero((count < 0)[back])
            where = doc[rare] * np.int64(len(distinct_h)) + back[rare]
            pair, tf = np.unique(where, return_counts=True)
            model_sum = np.bincount(doc, weights=likely + np.where(other, log - v.log_rest, 0.0), minlength=n)
            summary = pa.StructArray.from_arrays(
                [part.column(3), pa.array(np.diff(offsets)), pa.array(np.bincount(doc, weights=known, minlength=n).astype(np.int64)), pa.array(np.bincount(doc, weights=log, minlength=n)), pa.array(model_sum)], fields=list(whole)
            )
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(mix(uid.view(U64)).view(np.int64)), pa.array(np.zeros(n, np.int32)), part.column(0), summary], names=[*names[:3], "doc_id", "whole"])
            if len(pair):
                nothing = pa.nulls(len(pair), whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[pair // len(distinct_h)]), pa.array(distinct_h[pair % len(distinct_h)].view(np.int64)), pa.array(tf.astype(np.int32)), pa.nulls(len(pair), part.column(0).type), nothing], names=[*names[:3], "doc_id", "whole"]
                )

    scored = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text", "held_out").mapInArrow(
        run, f"uid long, h long, tf int, doc_id {kind}, whole struct<held_out: boolean, n_tokens: long, n_known: long, logs: double, model: double>"
    )
    joined = scored.join(counts.hint("shuffle_hash"), "h", "left")
    found = F.coalesce(F.col("c"), F.lit(0))
    by_doc = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("whole").alias("whole"),
        F.sum(F.when(found > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10(found + 1.0)).alias("logs"),
    )
    base = F.log10(F.lit(float(total + distinct + 1)))
    n = F.col("whole.n_tokens")
    return by_doc.select(
        "doc_id",
        F.col("whole.held_out").alias("held_out"),
        n.alias("n_tokens"),
        (F.col("whole.n_known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("whole.logs") + F.col("logs") - n * base).alias("base_score"),
        (F.col("whole.model") + F.col("logs") if total else F.col("whole.logs") * 0.0).alias("score"),
    )


def op7_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_maxent_lm": op7_maxent_lm}
ORACLES: dict[str, str] = {}
