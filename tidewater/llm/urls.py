"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models of the URL's characters, one of URLs that the rules accept
and one of those they reject, are counted over all such rows. A URL that no rule decides is blocked
when its length-normalised log-likelihood difference falls below a threshold that is calibrated on the
decided URLs, each scored with its own counts taken out.

Contexts of each order are hashed into tables of fixed size, so that the models' size does not depend
on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.text import column_bytes, mix, slices

#: The filter's rules: (host, path, verdict). A rule is named host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 5
#: Cells of each order's hashed table.
CELLS = 1 << 18
#: Bytes of URLs worked on at once.
PART = 1 << 18


def host(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent domain, and whose path starts the URL's; null if none."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def rule_verdict(rules=RULES) -> Column:
    verdict = F.lit(None).cast("string")
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, F.lit(v)).otherwise(verdict)
    return verdict


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte and a closing mark: its text, and per order 0..ORDER the cells of context and of context with it."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    size = int(lengths.sum()) + n
    text = np.repeat(np.arange(n), lengths + 1)
    starts = offsets[:-1] + np.arange(n)
    place = np.arange(size) - starts[text]
    symbol = np.full(size, 256, np.uint64)
    inside = np.ones(size, bool)
    inside[starts + lengths] = False
    symbol[inside] = data
    contexts, joint = np.empty((ORDER + 1, size), np.int64), np.empty((ORDER + 1, size), np.int64)
    context = np.zeros(size, np.uint64)
    for order in range(ORDER + 1):
        if order:
            before = np.full(size, 257, np.uint64)  # before the start
            shifted = np.arange(size) - order
            has = place >= order
            before[has] = symbol[shifted[has]]
            context = mix(context * np.uint64(0x100000001B3) + before + np.uint64(1))
        base = np.uint64(order)
        contexts[order] = (mix(context ^ (base << np.uint64(56))) & np.uint64(CELLS - 1)).astype(np.int64)
        joint[order] = (mix(context * np.uint64(0x9E3779B97F4A7C15) + symbol + (base << np.uint64(40))) & np.uint64(CELLS - 1)).astype(np.int64)
    return text, contexts, joint


def _log_likelihood(counts: np.ndarray, contexts, joint, own: float = 0.0) -> np.ndarray:
    """Per symbol. counts[0 or 1][order] are the tables of contexts and of contexts with a symbol.

    Each order's estimate is interpolated with the one below it: (c + b * lower) / (n + b). ``own``
    takes that share of one count out, for URLs that were counted.
    """
    p = np.full(contexts.shape[1], 1 / 257)
    for order in range(ORDER + 1):
        n = np.maximum(counts[0, order][contexts[order]] - own, 0)
        c = np.minimum(np.maximum(counts[1, order][joint[order]] - own, 0), n)
        p = (c + 4.0 * p) / (n + 4.0)
    return np.log(p)


def fit(decided: DataFrame) -> tuple[np.ndarray, float] | None:
    """Tables and threshold from (url, verdict) rows; None without URLs of both verdicts.

    Tasks send sparse sums of the cells that they met; what reaches the driver are at most two
    classes of 2 * (ORDER + 1) * CELLS cells and the 2,000 bins of a histogram of scores.
    """
    width = 2 * (ORDER + 1) * CELLS

    def count(batches):
        sums = np.zeros(2 * width, np.int64)
        for batch in (part for whole in batches for part in slices(whole, "url", PART)):
            data, offsets = column_bytes(batch.column(0))
            rejected = np.asarray(batch.column(1).to_pylist()) == "block"
            text, contexts, joint = _features(data, offsets)
            side = rejected[text].astype(np.int64) * width
            for order in range(ORDER + 1):
                for k, cells in enumerate((contexts[order], joint[order])):
                    np.add.at(sums, side + (k * (ORDER + 1) + order) * CELLS + cells, 1)
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["cell", "n"])

    cells = decided.select("url", "verdict").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    tables = np.zeros(2 * width, np.float32)
    tables[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    tables = tables.reshape(2, 2, ORDER + 1, CELLS)
    if not tables[0].any() or not tables[1].any():
        return None
    shared = decided.sparkSession.sparkContext.broadcast(tables)

    def bins(batches):
        for batch in (part for whole in batches for part in slices(whole, "url", PART)):
            rejected = np.asarray(batch.column(1).to_pylist()) == "block"
            score = _score(batch.column(0), shared.value, rejected)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(score * 100), -1000, 999).astype(np.int64)), pa.array(rejected)], names=["bin", "rejected"])

    found = decided.select("url", "verdict").mapInArrow(bins, "bin long, rejected boolean").groupBy("bin", "rejected").count().collect()
    shared.unpersist()
    by_bin = np.zeros((2, 2001))
    for r in found:
        by_bin[int(r["rejected"]), r["bin"] + 1000] += r["count"]
    by_bin /= np.maximum(by_bin.sum(axis=1, keepdims=True), 1)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(by_bin, axis=1)), axis=1)
    gain = below[1] - below[0]  # rejected caught less accepted lost, with the threshold at each bin's lower edge
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return tables, float((best[len(best) // 2] - 1000) / 100)


def _score(urls: pa.Array, tables: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """Mean log-likelihood difference per character, accepted less rejected; 0 for an empty URL.

    ``counted``: whether each URL was counted among the rejected; then it's taken out of its side.
    """
    data, offsets = column_bytes(urls)
    text, contexts, joint = _features(data, offsets)
    side = []
    for k in range(2):
        own = 0.0 if counted is None else (counted[text] == bool(k)).astype(np.float64)
        side.append(_log_likelihood(tables[k], contexts, joint, own))
    lengths = np.diff(offsets)
    total = np.bincount(text, weights=side[0] - side[1], minlength=len(lengths))
    return np.where(lengths > 0, total / (lengths + 1), 0.0)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Null URLs and those without ``://`` have an empty host and path; no rule fits them, and the model
    judges their characters (an empty URL scores 0 and is allowed). Where the decided URLs are all
    accepted, all rejected or none, the model allows everything. Repeated rows get equal verdicts.
    """
    ruled = pages.select("page_id", "url").withColumns({"host": host(), "path": path()})
    ruled = ruled.withColumn("rule", matching_rule(rules)).withColumn("verdict", rule_verdict(rules))
    fitted = fit(ruled.where("verdict is not null").select("url", "verdict"))
    if fitted is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    tables, threshold = fitted
    shared = pages.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "url", PART)):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(_score(batch.column(0), shared.value))], names=["page_id", "host", "path", "rule", "ruled", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = ruled.select("url", "page_id", "host", "path", "rule", F.col("verdict").alias("ruled")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    empty = (F.col("host") == "") & (F.col("path") == "") & (F.col("score") == 0)
    own = F.when((F.col("score") < threshold) & ~empty, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
