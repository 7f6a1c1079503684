"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated at random (three rounds of random signs and a fast Hadamard transform) and hashed
to the nearest signed axis; HASHES such hashes make a table's bucket. Multiprobe: besides its own
bucket a vector enters, per hash, the one with the second nearest axis instead, in each of TABLES
tables. Vectors that share a bucket are candidates; each pair is verified by its cosine in double
precision, in the one bucket that has the smallest number of those that the pair shares, so that it
counts once.

With these parameters the chance to miss a pair at the threshold itself is under 1 in 1,000, and it
falls quickly above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import components, cut
from tidewater.llm.text import U64, mix

TABLES = 8
HASHES = 3
SEED = 20240229
#: Vectors in a block of a bucket; two blocks are compared at once.
BLOCK_ROWS = 1024


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = x * s
        h, d = 1, x.shape[1]
        while h < d:
            x = x.reshape(len(x), -1, 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), d)
            h *= 2
    return x


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """(n, tables * (1 + hashes)) bucket numbers of the rows of x, all of one dimension."""
    n, width = x.shape
    d = 1 << max(0, width - 1).bit_length()
    padded = np.zeros((n, d))
    padded[:, :width] = x
    padded /= np.maximum(np.abs(padded).max(axis=1, keepdims=True), 1e-300)
    random = np.random.default_rng((seed, d))
    out = []
    for table in range(tables):
        first, second = np.empty((hashes, n), U64), np.empty((hashes, n), U64)
        for k in range(hashes):
            y = _rotate(padded, random.choice((-1.0, 1.0), (3, d)))
            size = np.abs(y)
            rows = np.arange(n)
            a = size.argmax(axis=1)
            first[k] = 2 * a + (y[rows, a] > 0)
            size[rows, a] = -1
            b = size.argmax(axis=1)
            second[k] = 2 * b + (y[rows, b] > 0)
        for probe in range(-1, hashes):
            key = np.full(n, table * 1_000_003 + width, U64)
            for k in range(hashes):
                key = mix(key * U64(0x100000001B3) + (second if k == probe else first)[k] + U64(1))
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def _matrices(column: pa.Array):
    """(rows, matrix) for each length of the lists of a column."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)[None, :]]


def _verify_bucket(key: int, cid: np.ndarray, copies: np.ndarray, x: np.ndarray, side: np.ndarray, least: float):
    """(cid, links, root) of the classes of a block pair that have links there."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # powers of two: no norm overflows or vanishes
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    p, q = np.nonzero(np.triu(unit @ unit.T >= least - 1e-9, 1))
    if side.any() and not side.all():
        across = side[p] != side[q]
        p, q = p[across], q[across]
    if not len(p):
        return None
    exact = np.concatenate([(x[p[i : i + 65536]] * x[q[i : i + 65536]]).sum(axis=1) for i in range(0, len(p), 65536)]) / (norm[p] * norm[q]) >= least
    p, q = p[exact], q[exact]
    if not len(p):
        return None
    used = np.unique(np.concatenate((p, q)))
    keys = np.zeros((len(x), TABLES * (1 + HASHES)), np.int64)
    keys[used] = np.sort(bucket_keys(x[used]), axis=1)
    here = np.zeros(len(p), bool)
    for i in range(0, len(p), 4096):
        a, b = keys[p[i : i + 4096]], keys[q[i : i + 4096]]
        common = (a[:, :, None] == b[:, None, :]).any(axis=2)
        here[i : i + 4096] = a[np.arange(len(a)), common.argmax(axis=1)] == key
    links = np.zeros(len(x), np.int64)
    np.add.at(links, p[here], copies[q[here]])
    np.add.at(links, q[here], copies[p[here]])
    root = cid.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        if (root == before).all():
            break
    return cid[used], links[used], root[used]


def _verify(least: float):
    """Streams rows (key, i, j, cid, copies, block, embedding) sorted by (key, i, j)."""
    names = ["cid", "links", "root"]

    def groups(tables):
        rest = None
        for table in tables:
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            code = mix(rest.column("key").to_numpy().view(U64)) + rest.column("i").to_numpy().astype(U64) * U64(0x9E3779B97F4A7C15) + rest.column("j").to_numpy().astype(U64) * U64(0xD1342543DE82EF95)
            ends = np.flatnonzero(code[1:] != code[:-1]) + 1
            if len(ends):
                yield rest.slice(0, ends[-1]), np.concatenate(([0], ends))
                rest = rest.slice(ends[-1])
        if rest is not None and rest.num_rows:
            code = np.zeros(rest.num_rows, np.int64)
            yield rest, np.array([0, rest.num_rows])

    def run(batches):
        for table, at in groups(pa.Table.from_batches([b]) for b in batches if b.num_rows):
            key, cid, copies, i, j, block = (table.column(c).to_numpy() for c in ("key", "cid", "copies", "i", "j", "block"))
            vectors = table.column("embedding").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            found = []
            for rows, matrix in _matrices(vectors):
                place = np.full(table.num_rows, -1)
                place[rows] = np.arange(len(rows))
                for a, b in zip(at, at[1:]):
                    own = place[a:b]
                    use = np.flatnonzero(own >= 0) + a
                    if len(use) > 1:
                        side = (block[use] == j[use]) & (i[use] != j[use])
                        if i[a] != j[a] and (side.all() or not side.any()):
                            continue
                        got = _verify_bucket(key[a], cid[use], copies[use], matrix[place[use]], side, least)
                        if got:
                            found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in found])) for k in range(3)], names=names)

    return run


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.95, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their cosine is at least ``threshold``; rows with equal vectors always do. Vectors
    that are null, empty or zero, or that hold a null or a non-finite component, link with nothing.
    ``component_id`` is the smallest vec_id reached (null ids do not count); ``kept`` says whether it is
    the row's own. Repeated rows are vectors of their own. Vectors of different lengths never link. Components may be of any finite magnitude.
    """
    rows = embeddings.select("vec_id", F.col(vector).cast("array<double>").alias("embedding"))
    good = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    good = F.coalesce(F.expr(good), F.lit(False))
    classes = rows.where(good).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))

    def keys(batches):
        for batch in batches:
            for rows_, x in _matrices(batch.column(1)):
                for i in range(0, len(rows_), 1024):
                    found = bucket_keys(x[i : i + 1024])
                    ids = batch.column(0).take(pa.array(rows_[i : i + 1024])).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(ids, found.shape[1]))], names=["key", "cid"])

    entries = classes.select("cid", "embedding").mapInArrow(keys, "key long, cid long").distinct()
    entries = cut(entries)
    several = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    cells = entries.join(several, "key").withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "block")
    cells = cells.join(classes.select("cid", "copies", "embedding"), "cid").select("key", "i", "j", "cid", "copies", "block", "embedding")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(cells.mapInArrow(_verify(threshold), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).where("a <> b"))
    whole = classes.join(links, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = whole.join(named, "component").select(F.col("embedding").alias("vector_"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where(good).join(whole, F.col("embedding") == F.col("vector_"), "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v WHERE e IS NOT NULL AND len(e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.s > 0 AND b.s > 0 AND list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) m ON m.id = v.vec_id
"""

QUERIES = {"op4_cross_polytope": op4_cross_polytope}
ORACLES = {"op4_cross_polytope": ORACLE}
