"""How queries are registered: a plan over named tables, and equivalent SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run Spark SQL over the tables that the text names; Catalyst sees plain scans and prunes them."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    frames = {f"{t}_": table(spark, sf_dir, t) for t in used}
    for t in used:
        text = re.sub(rf"(?i)\b(from|join)\s+{t}\b(?!\s*\()", rf"\1 {{{t}_}}", text)
    if any(f"{{{k}}}" in text for k in frames):
        # formatting needs other braces doubled
        for k in frames:
            text = text.replace(f"{{{k}}}", f"\0{k}\1")
        text = text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return spark.sql(text, **{k: v for k, v in frames.items() if f"{{{k}}}" in text})


class Book:
    """Collects the queries of a module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, other: str | None = None) -> None:
        """A query in Spark SQL; ``other`` is the SQL of the other engine, by default the same text."""
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
        self.oracles[name] = text if other is None else other

    def plan(self, name: str, other: str | None = None):
        """A query in the DataFrame API, as a decorator of (spark, sf_dir) functions."""

        def register(f: Query) -> Query:
            self.queries[name] = f
            if other is not None:
                self.oracles[name] = other
            return f

        return register
