"""Scans and sinks. Round trips write to a scratch folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.query import Book, table

book = Book()
sql = book.sql


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewater-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, kind: str, write: dict | None = None, read: dict | None = None) -> DataFrame:
    path = scratch(df.sparkSession, kind)
    df.write.format(kind).options(**(write or {})).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**(read or write or {})).load(path)


@book.plan("scan_csv", "SELECT * FROM region")
def scan_csv(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "region"), "csv", {"header": "true"})


@book.plan("scan_tsv", "SELECT * FROM nation")
def scan_tsv(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "nation"), "csv", {"header": "true", "sep": "\t"})


@book.plan("scan_glob_union", "SELECT event_id, user_id, event_type FROM events")
def scan_glob_union(spark, sf_dir):
    """Many files in nested folders read as one table."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = scratch(spark, "glob")
    events.withColumn("part", F.col("event_type")).write.partitionBy("part").csv(path, header=True)
    return spark.read.schema(events.schema).csv(path, header=True, recursiveFileLookup=True)


@book.plan("scan_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def scan_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@book.plan("scan_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def scan_json(spark, sf_dir):
    path = scratch(spark, "json")
    table(spark, sf_dir, "events").select("props").write.text(path)
    return spark.read.schema("k long").json(path).groupBy("k").agg(F.count("*").alias("n"))


@book.plan("scan_text_dir", "SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source")
def scan_text_dir(spark, sf_dir):
    """Texts under a folder per label; the label is read from the path."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", F.translate("text", "\n\r", "  ").alias("value"))
    path = scratch(spark, "text")
    docs.write.partitionBy("source").text(path)
    back = spark.read.text(path, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), "source=([^/]+)/", 1).alias("source"))
    return back.groupBy("source").agg(F.count("*").alias("n"))


@book.plan("sink_partitioned", "SELECT replace(p_type, ' ', '_') AS pt, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def sink_partitioned(spark, sf_dir):
    """An append sink with a folder per type, whose name has no blanks or slashes."""
    part = table(spark, sf_dir, "part").select(F.regexp_replace("p_type", "[ /]", "_").alias("pt"), "p_partkey", "p_size")
    path = scratch(spark, "sink")
    part.repartition("pt").write.partitionBy("pt").mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path).groupBy("pt").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@book.plan("gen_events")
def gen_events(spark, sf_dir):
    """Synthetic addresses and times, by hashes of the row number, so that reruns agree."""
    byte = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256)).cast("string")
    return spark.range(10_000).select("id", F.concat_ws(".", *map(byte, range(4))).alias("ip_address"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(86_400 * 30))).alias("created_at"))
