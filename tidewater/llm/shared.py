"""Session helpers of the llm operators: shared storage, Bloom words, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of the fixed-size Bloom filters: 2 MB, whatever the input.
BLOOM_WORDS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
            path = sc.getCheckpointDir()
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pack(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Like ``cut``, for narrow rows: read back in partitions of about ``rows``, so that few rows make few files."""
    kept = cut(df)
    return kept.coalesce(kept.count() // rows + 1)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unused(name: str, taken) -> str:
    """A column name that none of ``taken`` has, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bloom_words(keys: DataFrame, column: str):
    """A Bloom filter of a column's xxhash64 values: BLOOM_WORDS 64-bit words, two bits a key.

    Its size is fixed. With more keys it lets more rows through, which costs time and loses nothing.
    """
    import numpy as np

    h = F.xxhash64(F.col(column))
    bits = keys.select(F.explode(F.array(h, F.xxhash64(h, F.lit(1)))).alias("h"))
    word = F.col("h").bitwiseAND(BLOOM_WORDS - 1)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
    rows = bits.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).collect()
    words = np.zeros(BLOOM_WORDS, np.int64)
    for r in rows:
        words[r["w"]] = r["b"]
    return words.view(np.uint64)


def bloom_columns(column: str) -> list:
    """The two hash columns that ``in_bloom`` takes."""
    h = F.xxhash64(F.col(column))
    return [h.alias("bloom_a"), F.xxhash64(h, F.lit(1)).alias("bloom_b")]


def in_bloom(words, a, b):
    """Which rows the filter lets through; a and b are numpy int64 arrays of ``bloom_columns``."""
    import numpy as np

    def hit(h):
        h = h.view(np.uint64)
        return (words[(h & np.uint64(BLOOM_WORDS - 1)).astype(np.int64)] >> (h >> np.uint64(58))) & np.uint64(1)

    return (hit(a) & hit(b)).astype(bool)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, rows: int = 250_000) -> DataFrame:
    """Connected components of an edge list as (id, component), component the smallest id reached.

    Alternating large-star and small-star steps: each keeps connectivity and at most as many edges,
    and the edges end as stars around each smallest id, in a number of rounds that grows with the
    logarithm of the longest chain. Loops and repeated edges are harmless. The smallest id of a
    component gets no row, nor does an id without an edge to another. Every round ends with its edges in
    the shared folder, in partitions of about ``rows``.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    parts = now.count() // rows + 1
    now, seen = now.coalesce(parts), None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.coalesce(parts))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct().coalesce(parts))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("component"))
