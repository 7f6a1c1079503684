"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and rejection are measured on a sample that is kept in the shared folder; the
rules then run in falling order of rejection per cost, and a text that one rule rejects is not
looked at by the next. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Low bits of a window's code that hold its position; longer texts are compared by the words themselves.
POSITION_BITS = 24


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0)


def word_chars(column: str = "words") -> Column:
    return F.expr(f"aggregate({column}, 0L, (a, w) -> a + char_length(w))")


def count_class(chars: str, text: str = "text") -> Column:
    """How many characters of a class (written as inside brackets) the text has."""
    return F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{chars}]+", "")).cast("long")


def _lines(text: str) -> Column:
    return F.expr(rf"filter(split(coalesce({text}, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")


def n_lines(text: str = "text") -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    return F.expr(rf"transform(array(filter(split(coalesce({text}, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), l -> cast(size(l) - size(array_distinct(l)) as long))[0]")


def n_repeat_words(column: str = "words") -> Column:
    """Words in three-word windows that the text has twice or more.

    Every window's hash keeps its high bits and takes its position in the low ones; after one sort of
    longs, equal windows are neighbours. Where neighbours with equal high bits differ in their words,
    or a text is too long for the position bits, the windows are sorted as strings instead.
    """
    bits, mask = POSITION_BITS, (1 << POSITION_BITS) - 1
    covered = "aggregate({}, named_struct('n', 0L, 'last', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.last), 'last', p), a -> a.n)"
    window = f"array_join(slice({column}, i + 1, 3), ' ')"
    exact = f"""
      transform(array(sort_array(transform(sequence(0, size({column}) - 3), i -> named_struct('w', {window}, 'p', cast(i as long))))), s ->
        {covered.format("sort_array(transform(filter(s, (x, j) -> (j > 0 and s[j - 1].w = x.w) or (j < size(s) - 1 and s[j + 1].w = x.w)), x -> x.p))")})[0]"""
    coded = f"""
      transform(array(transform({column}, w -> xxhash64(w))), h ->
        transform(array(sort_array(transform(sequence(0, size(h) - 3), i -> ((xxhash64(h[i], h[i + 1], h[i + 2]) & {~mask}L) | i)))), s ->
          filter(s, (x, j) -> (j > 0 and shiftright(s[j - 1], {bits}) = shiftright(x, {bits})) or (j < size(s) - 1 and shiftright(s[j + 1], {bits}) = shiftright(x, {bits}))))[0])"""
    differ = " or ".join(f"{column}[cast(x & {mask} as int) + {k}] <> {column}[cast(d[j - 1] & {mask} as int) + {k}]" for k in range(3))
    chosen = f"""
      transform({coded}, d ->
        case when exists(transform(d, (x, j) -> j > 0 and shiftright(d[j - 1], {bits}) = shiftright(x, {bits}) and ({differ})), y -> y) then {exact}
             else {covered.format(f"sort_array(transform(d, x -> x & {mask}L))")} end)[0]"""
    return F.expr(f"case when size({column}) < 3 then 0L when size({column}) > {mask} then {exact} else {chosen} end")


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a text passes; the condition is never null."""

    name: str
    passes: Column


def rules(base: bool = True, ready: bool = False, text: str = "text") -> list[Rule]:
    """The production rules over columns (words, text), or over ready base columns.

    Integer arithmetic throughout, so that every engine gives the same verdict.
    """
    n = F.col("n_words") if ready else F.size("words").cast("long")
    chars = F.col("word_chars") if ready else word_chars()
    symbols = F.col("n_symbols") if ready else count_class(r"#*$%&|<>", text)
    dup = F.col("n_dup_lines") if ready else n_dup_lines(text)
    repeat = F.col("n_repeat_words") if ready else n_repeat_words()
    out = [Rule("enough_words", n >= 50), Rule("few_repeats", 100 * repeat <= 50 * n)] if base else []
    return out + [
        Rule("few_symbols", 10 * symbols <= 3 * n),
        Rule("word_length", (chars >= 2 * n) & (chars <= 14 * n)),
        Rule("few_dup_lines", (dup <= 2) | (100 * dup <= 30 * n_lines(text))),
        Rule("few_capitals", 100 * count_class("A-Z", text) <= 50 * chars),
    ]


def measure(documents: DataFrame, chosen: list[Rule], sample_rows: int = 2000, ready=lambda rows: rows) -> list[tuple[str, float, float]]:
    """(name, seconds a row, share rejected) of each rule on about sample_rows whole rows.

    ``ready`` adds the columns that the rules read, so the expressions measured are those that run; what a
    run without a rule takes is subtracted. Costs below a tenth of that run can't be told apart and count as
    a tenth, so that such rules go by rejection alone and reruns run the same code. Rows are drawn at random,
    whatever their ids.
    """
    total = documents.count()
    if not total:
        return [(r.name, 1.0, 0.0) for r in chosen]
    share = min(1.0, sample_rows / total)
    held = cut(ready(documents.where(F.rand(7) < share)))

    def seconds(*columns) -> tuple[float, tuple]:
        """The least of three runs; the first one compiles."""
        took, found = [], None
        for _ in range(3):
            began = time.perf_counter()
            found = held.agg(F.count("*"), *columns).first()
            took.append(time.perf_counter() - began)
        return min(took), found

    idle = seconds()[0]
    out = []
    for rule in chosen:
        took, (rows, rejected) = seconds(F.count(F.when(~rule.passes, 1)))
        out.append((rule.name, max(took - idle, idle / 10) / max(rows, 1), rejected / max(rows, 1)))
    return out


def ordered(chosen: list[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """The rules by falling rejection per cost."""
    worth = {name: rejection / max(cost, 1e-12) for name, cost, rejection in measured}
    return sorted(chosen, key=lambda r: -worth[r.name])


def first_failure(chosen: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    out = None
    for rule in chosen:
        out = F.when(~rule.passes, F.lit(rule.name)) if out is None else out.when(~rule.passes, F.lit(rule.name))
    return out


def quality_filter(documents: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The documents that pass every rule, with their own columns.

    Null and empty texts have no words and are rejected; repeated rows share a fate.
    """
    plain = documents.select("doc_id", "text")
    order = ordered(rules(), measure(plain, rules(), sample_rows, lambda rows: rows.withColumn("words", words())))
    # the columns are held in one of their own, so that none clashes with what the rules make
    own = documents.select(F.struct(*documents.columns).alias("row"), "text").withColumn("words", words())
    # A filter would be pushed down and the words pasted into every use, inside lambdas too. A generator's
    # input is not, so the verdict is made there, once a row.
    verdict = F.explode_outer(F.array(first_failure(order).isNull()))
    return own.select("row", verdict.alias("kept")).where("kept").select("row.*")


def quality_signals(documents: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    The base columns are wanted for every row, so the cascade is of the rules beyond them, over ready
    columns, and only for rows that the base passes.
    """

    def with_base(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("words", words())
        return rows.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), word_chars().alias("word_chars"), count_class(r"#*$%&|<>").alias("n_symbols"), n_dup_lines().alias("n_dup_lines"), n_repeat_words().alias("n_repeat_words"))

    plain = documents.select("doc_id", "text")
    chosen = rules(base=False, ready=True)
    order = ordered(chosen, measure(plain, chosen, sample_rows, with_base))
    out = with_base(plain)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(first_failure(order).isNull()))
    return out.drop("text")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_signals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, list(i) AS spots FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM i) GROUP BY rid, a, b, c HAVING count(*) > 1),
p AS (SELECT rid, unnest(spots) AS i FROM g),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= 3 * n_words AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND (n_dup_lines <= 2 OR 100 * n_dup_lines <= 30 * n_lines) AND 100 * n_capitals <= 50 * word_chars AS kept
FROM f
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE}
