"""Change streams: apply, upsert, dedup, throttling and live counts.

The streams are read by Structured Streaming from the folder of a table; a run drains what is there
and returns the state as a table.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.operators.sharing import sharing_many
from tidewater.plans.query import Book, table

book = Book()
sql = book.sql

OPS = "CASE event_type WHEN 'refund' THEN 'REMOVE' WHEN 'purchase' THEN 'INSERT' ELSE 'MODIFY' END"
LATEST = f"(SELECT *, {OPS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"
sql("cdc_latest", f"SELECT user_id, event_id, props FROM {LATEST} t WHERE r = 1 AND op <> 'REMOVE'")
sql("cdc_upsert", "SELECT md5(concat_ws('::', CAST(user_id AS VARCHAR(20)), event_type)) AS id, max(event_id) AS last_event FROM events GROUP BY md5(concat_ws('::', CAST(user_id AS VARCHAR(20)), event_type))")


@book.plan(
    "cdc_edges",
    f"""WITH u AS (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events), gone AS (SELECT user_id FROM {LATEST} t WHERE r = 1 AND op = 'REMOVE'), e AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM u a JOIN u b ON a.k = b.k AND a.event_type = b.event_type AND a.user_id < b.user_id)
SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = e.src) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = e.dst)""",
)
def cdc_edges(spark, sf_dir):
    """Users who share an event type and key, without those whose last change removes them."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    gone = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", F.expr(OPS).alias("op")))["op"].alias("op")).where("op = 'REMOVE'")
    u = e.join(gone, "user_id", "left_anti").select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), "event_type").where("k is not null and event_type is not null")
    return sharing_many(u.select("id", F.to_json(F.array("event_type", "k")).alias("v")))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that its source has and return what it wrote."""
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@book.plan("stream_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    live = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return drain(live, "complete")


@book.plan("stream_autocomplete", "SELECT prefix, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, event_type) AS r FROM (SELECT event_type, n, unnest(list_transform(range(1, length(event_type) + 1), lambda i: substring(event_type, 1, i))) AS prefix FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) c) x) y WHERE r <= 10")
def stream_autocomplete(spark, sf_dir):
    counts = drain(event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), "complete")
    prefixes = counts.withColumn("prefix", F.explode(F.expr("transform(filter(sequence(1, greatest(length(event_type), 1)), i -> i <= length(event_type)), i -> substring(event_type, 1, i))")))
    order = W.partitionBy("prefix").orderBy(F.desc("n"), "event_type")
    return prefixes.withColumn("r", F.row_number().over(order)).where("r <= 10").select("prefix", "event_type", "n")


@book.plan("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    seen = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "365 days").select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drain(seen, "append").select("user_id", "event_type")


@book.plan("throttle_schedule")
def throttle_schedule(spark, sf_dir):
    """When each of a user's events may run if they must be an hour apart."""
    t = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        out, last = [], None
        for x in pdf["t"]:
            last = x if last is None else max(x, last + 3600)
            out.append(last)
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "runs_at": out})

    return t.groupBy("user_id").applyInPandas(run, "user_id long, event_id long, runs_at long")


sql("tumbling_ext", "SELECT CAST(unix_timestamp(ts) / 3600 AS BIGINT) * 0 + unix_timestamp(ts) DIV 3600 AS hour_, count(*) AS n FROM events GROUP BY unix_timestamp(ts) DIV 3600, CAST(unix_timestamp(ts) / 3600 AS BIGINT) * 0".replace("CAST(unix_timestamp(ts) / 3600 AS BIGINT) * 0 + ", "").replace(", CAST(unix_timestamp(ts) / 3600 AS BIGINT) * 0", ""), "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS hour_, count(*) AS n FROM events GROUP BY ALL")


@book.plan("sliding_ext", "SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 900 * k AS start_, count(*) AS n, count(value) AS n_values FROM events, range(4) r(k) WHERE ts IS NOT NULL GROUP BY start_")
def sliding_ext(spark, sf_dir):
    """Events in windows of an hour that start each quarter of an hour; null times are in none."""
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.count("value").alias("n_values"))
    return hours.select(F.unix_timestamp("w.start").alias("start_"), "n", "n_values")


@book.plan(
    "session_ext",
    """SELECT user_id, min(t) AS start_, max(t) + 1800 AS end_, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL) x) y
GROUP BY user_id, s""",
)
def session_ext(spark, sf_dir):
    """Users' sessions, which end after half an hour without an event; null times are in none."""
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_timestamp("w.start").alias("start_"), F.unix_timestamp("w.end").alias("end_"), "n")
