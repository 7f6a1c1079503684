"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target number of words (its share of all words by weight, held to ``max_repeats``
times what it has) and a schedule: a weight that changes linearly over the run. Integrating the
schedule gives the demand that has accumulated at each training position; inverting it gives the
position at which a document of the source is due, from the words of its source that come before it.

A source's documents form a stream in the order of ``md5(doc_id)``. The mix reads the stream again
and again until the target is met: each document is taken a whole number of times, and the one at
which the last pass ends in part.

All of it is DataFrame code. Running sums within a source are made in two levels (the first hex digits
of the order key, then the rows of such a bucket), so that a source with a third of all rows is spread
over 4,096 groups with three digits; texts are reduced to their sizes before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.llm.shared import cut, scratch, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), 0)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """(source, source_size, weight, target): targets by water-filling.

    ``sizes`` has one row per source: (source, source_size). Sources in code-point order, null last,
    weigh 1, 2, .. ``cycle``, repeating. With the level L of the water, a source gets
    min(max_repeats * source_size, L * weight); the sources are few beside the documents, and the
    windows below order one row of each.
    """
    ranked = sizes.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("long"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("rest"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("full"), F.col("level")))).over(everything)["level"])
    )
    held = F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("cap"))
    return filled.select("source", "source_size", "weight", F.when(held, F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def position(share, slope):
    """Where in the run (0 to 1) a source has given ``share`` of its target.

    The weight runs as 1 + slope * (2t - 1); its integral t + slope * (t^2 - t) is set equal to share
    and solved for t.
    """
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(2 * share / (b + root))


def mix(documents: DataFrame, text: str = "text", max_repeats: int = 3, slopes: tuple[float, ...] = (0.5, 0.0, -0.5), carry: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats, position.

    ``taken`` counts words, repeats included; ``repeats`` the passes that touch the document, the last
    perhaps in part; ``position`` (0 to 1) is where its first pass is due, null where none is.
    ``slopes``, by weight, are the schedules: sources of weight k rise or fall by ``slopes[k - 1]``.
    Repeated rows are separate documents; null ids come last in the order; null and empty texts have
    size 0 and are not taken; a table without words takes nothing. The columns ``carry`` come along, as
    carry_0 and so on, and order what else is a tie; others are not looked at. ``digits``: a source's
    rows are summed in 16 ** digits groups, and those without an id by size.
    """
    sized = documents.select("doc_id", "source", word_count(text).alias("size"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry))).withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary")))
    carry = tuple(f"carry_{i}" for i in range(len(carry)))
    sized = sized.withColumn("bucket", F.coalesce(F.substring("key", 1, digits), F.concat(F.lit("~"), F.lpad(F.col("size").cast("string"), 19, "0"))))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_repeats, len(slopes))
    along = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))
    starts = starts.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "weight", "target")
    within = W.partitionBy("source", "bucket").orderBy(F.col("key").asc_nulls_last(), "size", *carry).rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("goal", goal).withColumn("passes", passes).withColumn("offset", F.col("start") + F.col("inner"))
    over = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * F.col("source_size") - F.col("offset")))
    rows = rows.withColumn("over", over).withColumn("taken", (F.col("passes") * F.col("size") + F.col("over")).cast("long"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("weight").cast("int"))
    due = F.when(F.col("taken") > 0, position(F.col("offset") / F.greatest(F.col("goal"), F.lit(1)), slope))
    repeats = F.when(F.col("size") > 0, F.col("passes") + (F.col("over") > 0).cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", repeats.alias("repeats"), due.alias("position"), "offset", "goal", slope.alias("slope"), *carry)


def readings(plan: DataFrame) -> DataFrame:
    """One row per reading of the documents of ``mix``: its columns, and pass, words, due.

    ``pass`` counts from 0; ``words`` is what the pass takes of the document; ``due`` (0 to 1) is where
    in the run the reading comes, that of pass 0 being ``position``. A document that is not taken has
    one row, in which pass and due are null and words 0.
    """
    times = F.when(F.col("repeats") > 0, F.sequence(F.lit(1), F.col("repeats")))
    rows = plan.select("*", F.posexplode_outer(times).alias("pass", "nth")).drop("nth")
    before = F.col("offset") + F.col("pass") * F.col("source_size")
    words = F.when(F.col("pass").isNull(), F.lit(0)).otherwise(F.least(F.col("size"), F.col("goal") - before)).cast("long")
    share = F.least(before / F.greatest(F.col("goal"), F.lit(1)), F.lit(1.0))
    return rows.withColumn("words", words).withColumn("due", F.when(F.col("pass").isNotNull(), position(share, F.col("slope"))))


def in_order(rows: DataFrame, *order) -> DataFrame:
    """The rows range-sorted: every partition is sorted and comes after the one before."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_sequence(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The ``readings`` of the mix in training order, without texts; documents that are not taken come last.

    Readings due at the same position come by doc_id, source and place in the source, so that reruns agree.
    """
    return in_order(readings(mix(documents, text, **options)), F.col("due").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("source").asc_nulls_last(), "offset", "size", "pass")


def mixed_documents(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents as the mix reads them: each as often as it is touched, sorted by position.

    Keeps the columns of ``documents``, whatever their names. A document at which a last pass ends in
    part comes whole. Every row is a document of its own, so repeated rows come ``repeats`` times each
    and rows with a null doc_id are mixed like others; what has no words is not taken; an empty table
    gives an empty one. The rows are first written to the shared folder with a number each, by which
    plan and texts meet again.
    """
    spark = documents.sparkSession
    key = unused("mix_key", documents.columns)
    path = scratch(spark, "mix")
    documents.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    plan = readings(mix(keyed, text, **options, carry=(key,)).where("repeats > 0"))
    at = F.struct(F.col("due").alias("position"), F.col("doc_id").alias("id"), F.col("carry_0").alias("row"), "pass")
    place = unused("mix_place", documents.columns)
    plan = plan.select(F.col("carry_0").alias(key), at.alias(place))
    return in_order(keyed.join(plan, key), place).select(*documents.columns)


def op8_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """One row per document, in the order in which the run first reads them; those not taken come last.

    The run is kept whole before first readings are picked, else the pick would go before the sort and
    later readings would get no place.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = cut(training_sequence(documents))
    return run.where("coalesce(pass, 0) = 0").select("doc_id", "size", "source_size", "target", "taken", "repeats", F.col("due").alias("position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS full_size, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
      FROM r WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - full_size AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM f),
t AS (SELECT *, (SELECT arg_min(level, full_size) FROM l WHERE level * weight <= cap) AS water FROM l),
p AS (SELECT source, source_size, weight, CASE WHEN water IS NULL OR water * weight > cap THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM t),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.weight, CAST(floor(p.target + 0.5) AS BIGINT) AS goal,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)) NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM o),
v AS (SELECT *, greatest(0, least(size, goal - passes * source_size - off)) AS part,
             CASE weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope, CAST(off AS DOUBLE) / CAST(greatest(goal, 1) AS DOUBLE) AS share FROM q)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS repeats,
       CASE WHEN passes * size + part > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN share
            ELSE 2 * share / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4 * slope * share)) END END AS position
FROM v
"""

QUERIES = {"op8_curriculum_mix": op8_curriculum_mix}
ORACLES = {"op8_curriculum_mix": ORACLE}
