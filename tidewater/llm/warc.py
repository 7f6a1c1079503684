"""WARC archives: writing, and reading by boundary-chain verification.

Records are written by Spark's text sink with CRLF CRLF as its line end, which is what closes a WARC
record. Reading splits archives at every magic line ``WARC/1.1`` by the splittable text source, so that
no file is read by one task alone. A payload may hold the magic itself, whole records even; therefore
each piece is only a candidate. Its header says where its successor must begin. Within a split a task
follows these offsets; between splits pointer jumping from each file's start doubles the reach in
every round. Only candidates on a chain from the start are records, and the pieces between two of
them are put together again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.llm.shared import bloom_columns, bloom_words, cut, in_bloom, remove, scratch

MAGIC = "WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(hexed: Column) -> Column:
    """Base32 of 40 hex digits, ten of them (eight characters) at a time."""
    out = []
    for g in range(4):
        number = F.conv(F.substring(hexed, 10 * g + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*out)


def _numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha, size, first, copy): ``first`` is the smallest (page_id, url) with the payload.

    ``first`` is null where a payload occurs once; ``copy`` numbers rows that are equal in all. A Bloom
    filter of fixed size tells most payloads that occur once; they go on without a shuffle.
    """
    me = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"), F.col("url").alias("url")).alias("me")
    marked = pages.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    copied = cut(marked.select("sha", me).groupBy("sha").agg(F.count("*").alias("copies"), F.min("me").alias("first")).where("copies > 1").select("sha", "first"))
    words = pages.sparkSession.sparkContext.broadcast(bloom_words(copied, "sha"))
    names = ["page_id", "url", "payload", "sha", "size"]

    def mark(batches):
        for batch in batches:
            again = in_bloom(words.value, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(again)], names=[*names, "again"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = marked.select(*bloom_columns("sha"), *names).mapInArrow(mark, f"page_id {kind}, url string, payload string, sha string, size long, again boolean")
    lone = rows.where("not again").select(*names, F.lit(None).cast(copied.schema["first"].dataType).alias("first"), F.lit(1).alias("copy"))
    some = rows.where("again").groupBy("page_id", "url", "sha", "size").agg(F.count("*").alias("k"), F.first("payload").alias("payload")).join(copied, "sha", "left")
    some = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    return lone.union(some.select(*names, "first", "copy"))


def write(pages: DataFrame, path: str, html: str = "html", least: int = 0) -> None:
    """Write a record per row of (page_id, url, html) to the folder ``path``.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id (null
    last, then the smallest url) is a response, the others revisit it and hold no payload. Null html is
    empty; null ids and urls leave their header out; line breaks in a url are escaped.
    """
    every = _numbered(pages.select("page_id", "url", F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload")))
    own = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url")) & (F.col("copy") == 1)
    revisit = F.col("first").isNotNull() & ~own & (F.col("size") >= least)
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("sha")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    code = F.md5(F.concat_ws(":", F.col("page_id").cast("string"), "url", "sha", F.col("copy").cast("string")).cast("binary"))
    uuid = F.regexp_replace(code, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", digest),
        header("Page-Id", F.col("page_id").cast("string")),
        header("Refers-To-Page-Id", F.when(revisit, F.col("first.page_id").cast("string"))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit(""))),
    )
    every.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _pieces(spark: SparkSession, path: str, raw_only: bool = False) -> DataFrame:
    """Candidates in each split: what follows each magic, its place and, within the split, where its chain leaves it.

    Columns: file, block, off (of the magic, from the split's first), exit (off past the split that the
    chain from here comes to, null if it breaks), size (of the whole record as its header says), total
    (of the split), the header, sha (of the payload, if the piece has all of it), raw (the piece, if not).
    """
    source = spark.read.option("lineSep", MAGIC).text(path)
    text, blob = F.col("value"), F.col("value").cast("binary")
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("cut", F.instr("value", "\r\n\r\n"))
    lines = lines.withColumn("header", F.when(F.col("cut") > 0, F.expr("substring(value, 1, cut + 1)")))
    lines = lines.withColumn("length", F.expr(r"try_cast(nullif(regexp_extract(header, '(?i)(?:^|\n)Content-Length: *([0-9]{1,15})\r\n', 1), '') as bigint)"))
    lines = lines.withColumn("length", F.when(F.col("header").rlike(r"(?i)(^|\n)WARC-Type: "), F.col("length")))
    head = F.octet_length("header").cast("long") + 2
    whole = F.coalesce(F.octet_length(text) >= head + F.col("length"), F.lit(False))
    sha = F.when(whole, F.sha1(F.expr("substring(cast(value as binary), cast(octet_length(header) + 3 as int), cast(length as int))")))
    raw = blob if raw_only else F.when(~whole, blob)
    size = F.lit(len(MAGIC)) + head + F.col("length") + 4
    lines = lines.select("file", "block", F.octet_length("value").cast("long").alias("bytes"), size.alias("size"), F.when(~F.lit(raw_only), F.col("header")).alias("header"), "length", sha.alias("sha"), raw.alias("raw"))
    out = ["file", "block", "off", "exit", "total", "size", "header", "length", "sha", "raw"]
    step = len(MAGIC)

    def split(rows: pa.Table):
        first = rows.column("block")[0].as_py() == 0
        length = rows.column("bytes").to_numpy()
        off = np.concatenate(([0], np.cumsum(length + step)[:-1]))
        total = int((length + step).sum())
        if first:  # nothing stands before the first piece
            off, total = off - step, total - step
        size = rows.column("size").fill_null(-1).to_numpy()
        to = np.where(size > 0, off + size, -1)
        spot = np.minimum(np.searchsorted(off, to), len(off) - 1)
        leaves, goes = to >= total, (to >= 0) & (off[spot] == to)
        exits = np.where(leaves, to, -1)
        for i in range(len(off) - 1, -1, -1):
            if not leaves[i] and goes[i]:
                exits[i] = exits[spot[i]]
        columns = {c: rows.column(c) for c in rows.column_names}
        columns |= {"off": pa.array(off), "exit": pa.array(exits, mask=exits < 0), "total": pa.array(np.full(len(off), total))}
        table = pa.table([columns[c] for c in out], names=out)
        return table.slice(1 if first else 0).to_batches()

    def run(batches):
        held, key = [], None
        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [0, *(i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1]))]
            for a, b in zip(starts, [*starts[1:], len(files)]):
                if b > a:
                    if key not in (None, (files[a], blocks[a])):
                        yield from split(pa.Table.from_batches(held))
                        held = []
                    key = (files[a], blocks[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from split(pa.Table.from_batches(held))

    return lines.mapInArrow(run, "file string, block long, off long, exit long, total long, size long, header string, length long, sha string, raw binary")


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, base, entry) of each split: its place, and where the chain from the file's start enters it, if at all.

    The entries are found by pointer jumping.
    """
    splits = pieces.groupBy("file", "block").agg(F.max("total").alias("total"))
    splits = cut(splits.withColumn("base", F.coalesce(F.sum("total").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    here = splits.select("file", "block", "base")
    at = pieces.select("file", "block", "off", "exit").join(here, ["file", "block"])
    at = at.select("file", (F.col("base") + F.col("off")).alias("at"), (F.col("base") + F.col("exit")).alias("to"), "block", "off")
    reached = at.where("at = 0").select("file", "at")
    if most > 1:
        jump = cut(at.where("to is not null").select("file", "at", "to"))
        for i in range(math.ceil(math.log2(most)) + 1):
            ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
            reached = cut(reached.union(ahead).distinct())
            if i < math.ceil(math.log2(most)):
                onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
                jump = cut(jump.join(onward, ["file", "to"]).select("file", "at", F.col("further").alias("to")))
    entered = at.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("off").alias("entry"))
    return here.join(entered, ["file", "block"], "left")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, header, length, sha, payload) of every record of the archives in ``path``.

    ``payload`` is only given where a record lay in several pieces; ``sha`` (hex SHA-1 of the payload)
    always. What a broken chain leaves behind is no record.
    """
    pieces = cut(_pieces(spark, path))
    located = pieces.join(_entries(pieces), ["file", "block"])

    def walk(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("off").to_numpy())
        table = table.take(pa.array(order))
        off = table.column("off").to_numpy()
        size = table.column("size").fill_null(-1).to_numpy()
        entry = table.column("entry")[0].as_py()
        real = np.zeros(len(off), bool)
        at = entry if entry is not None else -1
        while at >= 0:
            i = int(np.searchsorted(off, at))
            if i == len(off) or off[i] != at or size[i] < 0:
                break
            real[i] = True
            at = int(off[i] + size[i])
        base = table.column("base")[0].as_py()
        return pa.table([table.column("file"), table.column("block"), table.column("off"), pa.array(off + base), *(table.column(c) for c in ("header", "length", "sha", "raw")), pa.array(real)], names=names)

    names = ["file", "block", "off", "at", "header", "length", "sha", "raw", "real"]
    walked = cut(located.groupBy("file", "block").applyInArrow(walk, "file string, block long, off long, at long, header string, length long, sha string, raw binary, real boolean"))
    whole = walked.where("real and sha is not null").select("file", "at", "header", "length", "sha", F.lit(None).cast("binary").alias("payload"))
    if walked.where("real and sha is null").isEmpty():
        return whole
    # records in pieces: each piece goes to the last record before it
    owner = F.last(F.when(F.col("real"), F.col("at")), True).over(W.partitionBy("file").orderBy("at"))
    owned = walked.withColumn("owner", owner)
    broken = owned.where("real and sha is null").select("file", F.col("at").alias("owner"))
    parts = cut(owned.join(broken, ["file", "owner"]))
    seen = parts.where("raw is not null").select("file", "owner", "at", "raw")
    unseen = parts.where("raw is null").select("file", "block", "off", "owner", "at")
    if not unseen.isEmpty():  # whole records inside a payload: their bytes are read again
        again = _pieces(spark, path, raw_only=True).select("file", "block", "off", "raw")
        seen = seen.union(unseen.join(again, ["file", "block", "off"]).select("file", "owner", "at", "raw"))
    joined = seen.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("p"))
    # Latin-1 has a character for every byte, so that all pieces are put together at once
    blob = F.expr(f"encode(array_join(transform(p, x -> concat(if(x.at = owner, '', '{MAGIC}'), decode(x.raw, 'ISO-8859-1'))), ''), 'ISO-8859-1')")
    heads = walked.where("real and sha is null").select("file", F.col("at").alias("owner"), "header", "length")
    found = heads.join(joined.withColumn("blob", blob), ["file", "owner"])
    payload = F.expr("substring(blob, cast(octet_length(header) + 3 as int), cast(length as int))")
    found = found.withColumn("payload", payload).where(F.octet_length("payload") == F.col("length"))
    return whole.union(found.select("file", F.col("owner").alias("at"), "header", "length", F.sha1("payload").alias("sha"), "payload"))


def field(name: str) -> Column:
    return F.expr(rf"nullif(regexp_extract(header, '(?i)(?:^|\n){name}: *([^\r]*)\r\n', 1), '')")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives in ``path``.

    A revisit's payload is that of the response with its digest.
    """
    found = cut(read(spark, path).select(field("Page-Id").cast("long").alias("page_id"), "length", base32_sha1(F.col("sha")).alias("own"), F.lower(field("WARC-Type")).alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), field("Refers-To-Page-Id").cast("long").alias("refers_to")))
    responses = found.where("record_type = 'response'")
    of_digest = responses.groupBy("own").agg(F.max("length").alias("full")).withColumnRenamed("own", "digest")
    revisits = found.where("record_type = 'revisit'").join(of_digest, "digest")
    out = responses.select("page_id", F.col("length").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return out.union(revisits.select("page_id", "full", "digest", "record_type", "refers_to"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = records(spark, path)
    remove(spark, path)  # the records are in a checkpoint by now
    return out


ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
c AS (SELECT page_id, octet_length(encode(h)) AS n, x, ('0x' || x[1:10])::BIGINT AS a, ('0x' || x[11:20])::BIGINT AS b, ('0x' || x[21:30])::BIGINT AS c, ('0x' || x[31:40])::BIGINT AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id, row_number() OVER (PARTITION BY x ORDER BY page_id) AS k FROM c)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((([a, b, c, d][i // 8 + 1] >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": ORACLE}
