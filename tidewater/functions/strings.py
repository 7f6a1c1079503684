"""String, date, math, array, map and JSON functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.plans.query import Book, table

book = Book()
sql = book.sql


def rows(name: str, columns: str, values: list[tuple], expression: str, expected: list) -> None:
    """A query over literal rows, whose expected results are literals too: text id -> value."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    spark_lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "r\"" + v + "\"" if "'" in v or "\\" in v else "'" + v + "'"
    given = ", ".join(f"({i}, {', '.join(map(spark_lit, v))})" for i, v in enumerate(values))
    want = ", ".join(f"({i}, {lit(v)})" for i, v in enumerate(expected))
    sql(name, f"SELECT id, {expression} AS result FROM VALUES {given} AS v(id, {columns})", f"SELECT id, result FROM (VALUES {want}) v(id, result)")


def tokens_a(text: str) -> str:
    """Tags, then all but word characters and points within numbers become spaces; no lower-casing."""
    return rf"filter(split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '<[^<]+?>', ' '), '[^a-zA-Z0-9\\-\'\". ]', ' '), '(?<![0-9])[.]|[.](?![0-9])', ' '), ' +', ' '), ' '), x -> x <> '')"


def _per_document(name: str, expression: str, from_: str = "documents", key: str = "doc_id", text: str = "text"):
    """A tokeniser's output as one string per row; checked by rows only where the other engine lacks the regex."""
    sql(name, f"SELECT {key}, array_join({expression}, ' ') AS toks FROM {from_}")
    book.oracles.pop(name)


_per_document("tokens_a", tokens_a("text"))
_per_document("tokens_b", r"filter(split(lower(regexp_replace(regexp_replace(text, '<[^<]+?>', ' '), '(?U)[^\\w\\-+&.\'\":]', ' ')), ' +'), x -> x <> '')")
_per_document("tokens_c", r"filter(split(lower(regexp_replace(regexp_replace(text, '<[^<]+?>', ' '), '(?U)[^\\w\\-+&.\'\":]', ' ')), ' +'), x -> x <> '' and x not in ('the', 'a', 'an', 'of'))")
_per_document("tokens_e", r"filter(split(lower(regexp_replace(regexp_replace(text, '<[^<]+?>', ' '), '(?U)[^\\w\\-]', ' ')), ' +'), x -> x <> '')")
_per_document("tokens_f", r"filter(split(lower(regexp_replace(text, '(?U)[^\\w\']', ' ')), ' +'), x -> x <> '')", "conversations", "conv_id, turn")
sql("tokens_g", r"SELECT doc_id, array_join(regexp_extract_all(text, '(?<![a-zA-Z0-9_])[a-zA-Z]{3,}(?![a-zA-Z0-9_])', 0), ' ') AS toks FROM documents", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[a-zA-Z]{3,}\b'), ' ') AS toks FROM documents")
sql("tokens_h", r"SELECT doc_id, array_join(filter(split(lower(text), '[ \\r\\n\\t`!@#$%^&*()_+={}|:;<>,.?/~\"\\[\\]-]'), x -> x <> '' AND x NOT IN ('the', 'of', 'and', 'a')), ' ') AS toks FROM documents",
    r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \r\n\t`!@#$%^&*()_+={}|:;<>,.?/~" + r'"' + r"\[\]-]'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and', 'a')), ' ') AS toks FROM documents")
sql("sanitize", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(html, '<[^<]+?>', ' ')), '[^a-z0-9. ]', ' '), ' +', ' ')) AS txt FROM pages", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(html, '<[^<]+?>', ' ', 'g')), '[^a-z0-9. ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS txt FROM pages")
sql("clean_r", r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z]', ' '), '\\b[a-zA-Z]{1,2}\\b', ' '), ' +', ' '))) AS txt FROM documents", r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'), '\b[a-zA-Z]{1,2}\b', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS txt FROM documents")
sql("clean_tag", r"SELECT p_partkey, array_join(filter(split(regexp_replace(regexp_replace(lower(p_name), '[^a-zA-Z0-9 ]', ' '), ' +', ' '), ' '), x -> x NOT IN ('the', 'of', 'a')), ' ') AS tag FROM part",
    r"SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(p_name), '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: x NOT IN ('the', 'of', 'a')), ' ') AS tag FROM part")
sql("ngrams_word", "SELECT p_partkey, array_join(filter(flatten(transform(sequence(1, 2), n -> transform(sequence(1, size(w)), i -> CASE WHEN i + n - 1 <= size(w) THEN array_join(slice(w, i, n), ' ') END))), x -> x IS NOT NULL), '|') AS grams FROM (SELECT p_partkey, split(p_name, ' ') AS w FROM part) t",
    "SELECT p_partkey, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS grams FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) t")
sql("ngrams_char", "SELECT p_partkey, array_join(transform(sequence(1, length(p_name) - 2), i -> substring(p_name, i, 3)), '|') AS grams FROM part WHERE length(p_name) >= 3", "SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)), '|') AS grams FROM part WHERE length(p_name) >= 3")
sql("skip_grams", "WITH t AS (SELECT p_partkey, i, w FROM part LATERAL VIEW posexplode(split(p_name, ' ')) e AS i, w) SELECT a.p_partkey, a.i AS i, b.i AS j, concat(a.w, b.w) AS gram FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.i < b.i",
    "WITH t AS (SELECT p_partkey, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part) z) SELECT a.p_partkey, a.i AS i, b.i AS j, concat(a.w, b.w) AS gram FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.i < b.i")
sql("title_runs", r"SELECT doc_id, array_join(transform(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+', 0), x -> replace(x, ' ', '__')), '|') AS runs FROM documents", r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), lambda x: replace(x, ' ', '__')), '|') AS runs FROM documents")
sql("prefixes", "SELECT p_partkey, array_join(transform(filter(sequence(1, greatest(length(p_name), 1)), i -> i <= length(p_name)), i -> substring(p_name, 1, i)), '|') AS prefixes FROM part", "SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: substring(p_name, 1, i)), '|') AS prefixes FROM part")
sql("break_words", "SELECT DISTINCT w, array_join(transform(sequence(3, length(w) - 4), i -> concat(substring(w, 1, i), ' ', substring(w, i + 1))), '|') AS broken FROM part LATERAL VIEW explode(split(p_name, ' ')) e AS w WHERE length(w) >= 7",
    "SELECT DISTINCT w, array_to_string(list_transform(range(3, length(w) - 3), lambda i: concat(substring(w, 1, i), ' ', substring(w, i + 1))), '|') AS broken FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) t WHERE length(w) >= 7")
sql("levenshtein_pairs", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS dist FROM n a JOIN n b ON a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 3", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS dist FROM n a JOIN n b ON a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 3")


def _common_subsequence(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence with b."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _name_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), (F.col("a") < F.col("b")) & (F.substring_index("a", " ", 1) == F.substring_index("b", " ", 1)))


@book.plan("lcs_len")
def lcs_len(spark, sf_dir):
    @F.pandas_udf("int")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(_common_subsequence(x.split(), y.split())) for x, y in zip(a, b)])

    return _name_pairs(spark, sf_dir).select("a", "b", length("a", "b").alias("n"))


@book.plan("lcs_span")
def lcs_span(spark, sf_dir):
    def cut(x: str, y: str) -> str:
        at = _common_subsequence(x.split(), y.split())
        return " ".join(x.split()[at[0] : at[-1] + 1]) if at else ""

    @F.pandas_udf("string")
    def span(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cut(x, y) for x, y in zip(a, b)])

    return _name_pairs(spark, sf_dir).select("a", "b", span("a", "b").alias("span"))


sql("word_shape", r"SELECT DISTINCT w, w rlike '^[A-Z][a-z]*$' AS title, w rlike '^[a-z]+$' AS low, w rlike '^[A-Z]+$' AS up, w rlike '^[0-9]+$' AS digit, w rlike '-' AS hyphen FROM documents LATERAL VIEW explode(split(text, ' ')) e AS w",
    r"SELECT DISTINCT w, regexp_matches(w, '^[A-Z][a-z]*$') AS title, regexp_matches(w, '^[a-z]+$') AS low, regexp_matches(w, '^[A-Z]+$') AS up, regexp_matches(w, '^[0-9]+$') AS digit, regexp_matches(w, '-') AS hyphen FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t")
sql("affixes", "SELECT p_partkey, left(p_name, 1) AS p1, left(p_name, 2) AS p2, left(p_name, 3) AS p3, right(p_name, 1) AS s1, right(p_name, 2) AS s2, right(p_name, 3) AS s3 FROM part")
sql("intent_token", r"""SELECT conv_id, turn, CASE WHEN q IS NULL THEN 'none' ELSE concat(q, '__', coalesce(try_element_at(w, CAST(array_position(w, q) + 1 AS INT)), '')) END AS intent FROM (SELECT conv_id, turn, w, element_at(filter(w, x -> x IN ('how', 'what', 'who', 'when', 'where', 'why', 'which', 'can', 'is', 'the')), 1) AS q FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM conversations WHERE role = 'user') t WHERE size(filter(w, x -> x IN ('how', 'what', 'who', 'when', 'where', 'why', 'which', 'can', 'is', 'the'))) > 0) u""",
    r"""SELECT conv_id, turn, concat(q, '__', coalesce(w[list_position(w, q) + 1], '')) AS intent FROM (SELECT conv_id, turn, w, list_filter(w, lambda x: x IN ('how', 'what', 'who', 'when', 'where', 'why', 'which', 'can', 'is', 'the'))[1] AS q FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = 'user') t) u WHERE q IS NOT NULL""")

# attribute normalisers over literal rows; the patterns are fixed values
NUMBER = r"[-+]?[0-9]*[.][0-9]+|[0-9]+"
rows("last_number", "t", [("from 5 to 15.6 inches",), ("none",), ("up to 32",)], f"try_element_at(regexp_extract_all(t, '{NUMBER}', 0), -1)", ["15.6", None, "32"])
rows("first_number", "t", [("from 5 to 15.6 inches",), ("none",), ("up to 32",)], f"try_element_at(regexp_extract_all(t, '{NUMBER}', 0), 1)", ["5", None, "32"])
# fixed values: the pattern and the numbers
WORDS = r"(?i)\bone|two|three|four|five|six|seven|eight|nine|ten|single|eleven|twelve|twin|triple\b"
NUMBERS = [("one", 1), ("single", 1), ("two", 2), ("twin", 2), ("three", 3), ("triple", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12)]


def number_words(text: str) -> Column:
    """The number that most number words of a text name, whatever their case; null without any or with a tie."""
    named = F.create_map(*[F.lit(x) for pair in NUMBERS for x in pair])
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(WORDS), 0), lambda w: named[F.lower(w)])
    counts = F.transform(F.array_distinct(found), lambda v: F.struct(F.size(F.filter(found, lambda x: x == v)).alias("n"), v.alias("v")))
    ranked = F.reverse(F.array_sort(counts))
    clear = (F.size(ranked) == 1) | (F.get(ranked, 0)["n"] > F.get(ranked, 1)["n"])
    return F.when(clear, F.get(ranked, 0)["v"])


# the other engine's word boundary is of ASCII letters only, so its pattern names the neighbours
_BOUNDED = WORDS.replace(r"\bone", r"(?:^|[^\p{L}\p{N}_])one").replace(r"triple\b", r"triple(?:$|[^\p{L}\p{N}_])")
_CASES = " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBERS)


@book.plan(
    "number_words",
    f"""WITH m AS (SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '{_BOUNDED}'))), '[^a-z]', '', 'g') AS w FROM documents),
c AS (SELECT doc_id, CASE w {_CASES} END AS v, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM c)
SELECT d.doc_id, CAST(b.v AS INT) AS result FROM documents d LEFT JOIN (SELECT doc_id, min(v) AS v FROM r WHERE r = 1 GROUP BY doc_id HAVING count(*) = 1) b ON b.doc_id = d.doc_id""",
)
def number_words_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", number_words("text").alias("result"))


rows("light_counts", "t", [("3 lights with 0 bulbs",), ("5-light fixture",), ("2x 40 W",), ("no count",)], r"array_join(filter(regexp_extract_all(lower(t), '([0-9]+)[ -]*(?:lights?|bulbs?|x\\b|led)', 1), x -> cast(x as int) > 0), ',')", ["3", "5", "2", ""])
rows("seating_capacity", "t", [("Loveseat sofa",), ("Tub chair",), ("seats 4 people",), ("bean bag",), ("table",)], "CASE WHEN regexp_extract(lower(t), 'seats? ([0-9]+)', 1) <> '' THEN cast(regexp_extract(lower(t), 'seats? ([0-9]+)', 1) as int) WHEN lower(t) LIKE '%loveseat%' THEN 2 WHEN lower(t) rlike 'chair|tub|bean bag' THEN 1 END", [2, 1, 4, 1, None])
_feet = r"(?i)^([0-9]+)\' *([0-9]+)?\"? x ([0-9]+)\' *([0-9]+)?\"?$"


@book.plan("rug_size", "SELECT * FROM (VALUES (0, '5'' x 8'''), (1, '60\" x 84\"'), (2, '5''3\" x 7''6\"'), (3, '8'''), (4, '39.37\" x 78.74\"')) v(id, result)")
def rug_size(spark, sf_dir):
    """Dimensions in one spelling; centimetres become inches."""
    given = spark.createDataFrame([(0, "5' x 8'"), (1, "60 in x 84 in"), (2, "5'3\" x 7'6\""), (3, "8"), (4, "100 cm x 200 cm")], "id int, t string")
    t = F.lower("t")
    inch = F.regexp_replace(t, r" *in(ches)?\b", '"')
    cm = [F.regexp_extract(t, r"([0-9.]+) *cm x ([0-9.]+) *cm", k).cast("string") for k in (1, 2)]
    inches = [F.format_string("%.2f", F.expr(f"try_cast(regexp_extract(lower(t), '([0-9.]+) *cm x ([0-9.]+) *cm', {k}) as double)") / 2.54) for k in (1, 2)]
    out = F.when(cm[0] != "", F.concat(inches[0], F.lit('" x '), inches[1], F.lit('"'))).when(t.rlike("^[0-9]+$"), F.concat(t, F.lit("'"))).otherwise(inch)
    return given.select("id", out.alias("result"))


rows("laptop_screen", "t", [("15.6 inch laptop",), ("laptop 8GB RAM 1TB HDD 2.4 GHz",), ("13.3\" display",)], r"concat_ws('|', nullif(regexp_extract(t, '(?i)([0-9.]+) ?(?:inch|\")', 1), ''), nullif(regexp_extract(t, '(?i)([0-9]+ ?GB) RAM', 1), ''), nullif(regexp_extract(t, '(?i)([0-9]+ ?[GT]B) HDD', 1), ''), nullif(regexp_extract(t, '(?i)([0-9.]+ ?GHz)', 1), ''))", ["15.6", "8GB|1TB|2.4 GHz", "13.3"])
rows("ounces", "t", [("12 fl oz",), ("8.5oz",), ("1 lb",), ("16 fl. oz",)], r"CASE WHEN t rlike '([0-9.]+) *(fl[.]?)? *oz' THEN concat(regexp_extract(t, '([0-9.]+) *(?:fl[.]?)? *oz', 1), ' oz') END", ["12 oz", "8.5 oz", None, "16 oz"])
rows("token_translate", "t", [("colour of centre",), ("grey sofa",), ("plain",)], "array_join(transform(split(t, ' '), w -> coalesce(map('colour', 'color', 'centre', 'center', 'grey', 'gray')[w], w)), ' ')", ["color of center", "gray sofa", "plain"])
rows("split_labels", "t", [("_Red__Blue_",), ("One",)], "array_join(split(lower(trim(BOTH '_' FROM t)), '__'), ',')", ["red,blue", "one"])
sql("ascii_only", r"SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '') AS txt FROM documents", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS txt FROM documents")
sql("url_base_md5", r"SELECT page_id, base, md5(base) AS name FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base FROM pages) t", r"SELECT page_id, base, md5(base) AS name FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base FROM pages) t")
sql("hash_keys", "SELECT c_custkey, sha2(c_name, 256) AS s, md5(c_name) AS m FROM customer", "SELECT c_custkey, sha256(c_name) AS s, md5(c_name) AS m FROM customer")
sql("pad_tokens", "SELECT doc_id, array_join(slice(concat(w, array_repeat('PAD_TXT', 20)), 1, 20), ' ') AS toks FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM documents) t", "SELECT doc_id, array_to_string(list_concat(w, list_transform(range(20), lambda i: 'PAD_TXT'))[1:20], ' ') AS toks FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) t")
sql("word_index", "WITH t AS (SELECT p_partkey, i, w FROM part LATERAL VIEW posexplode(split(p_name, ' ')) e AS i, w), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS k FROM (SELECT DISTINCT w FROM t WHERE p_partkey % 2 = 0) x) SELECT t.p_partkey, t.i, coalesce(d.k, 0) AS k FROM t LEFT JOIN d ON t.w = d.w",
    "WITH t AS (SELECT p_partkey, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part) z), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS k FROM (SELECT DISTINCT w FROM t WHERE p_partkey % 2 = 0) x) SELECT t.p_partkey, t.i, coalesce(d.k, 0) AS k FROM t LEFT JOIN d ON t.w = d.w")
sql("deletion_instances", "SELECT DISTINCT w, i, concat(substring(w, 1, i - 1), substring(w, i + 1)) AS rest, substring(w, i, 1) AS gone FROM (SELECT w, explode(filter(sequence(1, greatest(length(w), 1)), i -> i <= length(w))) AS i FROM part LATERAL VIEW explode(split(p_name, ' ')) e AS w) t",
    "SELECT DISTINCT w, i, concat(substring(w, 1, i - 1), substring(w, i + 1)) AS rest, substring(w, i, 1) AS gone FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) z) t")
sql("group_anagrams", "SELECT k, array_join(sort_array(collect_set(w)), ',') AS words FROM (SELECT w, array_join(array_sort(split(w, '')), '') AS k FROM part LATERAL VIEW explode(split(p_name, ' ')) e AS w) t GROUP BY k",
    "SELECT k, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM (SELECT w, array_to_string(list_sort(string_split(w, '')), '') AS k FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) z) t GROUP BY k")
sql("pattern_positions", "SELECT doc_id, i FROM (SELECT doc_id, w, explode(sequence(1, size(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM documents) t WHERE size(w) > 1) u WHERE w[i - 1] = 'of' AND w[i] = 'the'",
    "SELECT doc_id, i FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) t) u WHERE w[i] = 'of' AND w[i + 1] = 'the'")

# dates, math, arrays, maps, JSON
sql("date_math", "SELECT o_orderkey, date_sub(CAST(o_orderdate AS DATE), 30) AS d30, add_months(CAST(o_orderdate AS DATE), -6) AS m6, date_format(o_orderdate, 'yyyyMMdd') AS ymd, unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS ms FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS d30, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS m6, strftime(o_orderdate, '%Y%m%d') AS ymd, epoch_ms(o_orderdate) AS ms FROM orders")
rows("parse_ts_us", "t", [("2024-01-02T03:04:05.123Z",), ("2024-01-02T03:04:05.1234567Z",)], r"date_format(to_timestamp(substring(t, 1, 19), \"yyyy-MM-dd'T'HH:mm:ss\") + make_dt_interval(0, 0, 0, cast(regexp_extract(t, '[.]([0-9]+)Z', 1) as decimal(18, 6)) / 1000000), 'yyyy-MM-dd HH:mm:ss.SSSSSS')".replace('\\"', '"'), ["2024-01-02 03:04:05.000123", "2024-01-02 03:04:06.234567"])
sql("minmax_scale", "SELECT o_orderkey, (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS scaled FROM orders")
sql("redmean", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt((2 + (l_quantity * 5 + 128) / 2 / 256) * (l_quantity * 5 - 128) * (l_quantity * 5 - 128) + 4 * (l_discount * 2000 - 64) * (l_discount * 2000 - 64) + (2 + (255 - (l_quantity * 5 + 128) / 2) / 256) * (l_tax * 3000 - 32) * (l_tax * 3000 - 32)), 8) AS dist FROM lineitem")
E2 = ("aggregate(zip_with(a.e, b.e, (x, y) -> {}), 0D, (s, x) -> s + x)", "list_sum(list_transform(range(1, 65), lambda i: {}))")
sql("vector_distances", "WITH v AS (SELECT vec_id, transform(embedding, x -> CAST(x AS DOUBLE)) AS e, label FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(" + E2[0].format("(x - y) * (x - y)") + "), 6) AS euclid, round(" + E2[0].format("x * y") + ", 6) AS dot FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 20 = 0",
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS euclid, round(list_inner_product(a.e, b.e), 6) AS dot FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 20 = 0")
rows("logit_radius", "w, b, t", [(-2.0, 1.0, 0.5), (-4.0, 2.0, 0.5)], "round(-(b + ln(1 / t - 1)) / w, 6)", [0.5, 0.5])
sql("softmax_rows", "SELECT vec_id, array_join(transform(embedding, x -> CAST(CAST(round(exp(CAST(x AS DOUBLE)) / z * 1000000) AS BIGINT) AS STRING)), ',') AS p FROM (SELECT vec_id, embedding, aggregate(embedding, 0D, (s, x) -> s + exp(CAST(x AS DOUBLE))) AS z FROM embeddings) t",
    "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(exp(CAST(x AS DOUBLE)) / z * 1000000) AS BIGINT)), ',') AS p FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))) AS z FROM embeddings) t")
MAT = "m AS (SELECT l_suppkey % 20 AS i, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_suppkey % 20, l_linenumber)"
sql("matmul", f"WITH {MAT} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.k = b.k GROUP BY a.i, b.i")
sql("transpose", f"WITH {MAT} SELECT k AS i, i AS k, v FROM m")
sql("convolve2d", f"WITH {MAT} SELECT a.i, a.k, sum(b.v * (CASE WHEN a.i = b.i AND a.k = b.k THEN 4 ELSE 1 END)) AS v FROM m a JOIN m b ON abs(a.i - b.i) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.i, a.k")
sql("sieve", "WITH n AS (SELECT id AS n FROM range(2, 2000)) SELECT n FROM n WHERE NOT EXISTS (SELECT 1 FROM n d WHERE d.n * d.n <= n.n AND n.n % d.n = 0)".replace("FROM n WHERE", "FROM n n WHERE"), "WITH n AS (SELECT range AS n FROM range(2, 2000)) SELECT n FROM n WHERE NOT EXISTS (SELECT 1 FROM n d WHERE d.n * d.n <= n.n AND n.n % d.n = 0)")
book.queries.pop("sieve")


@book.plan("sieve", book.oracles["sieve"])
def sieve(spark, sf_dir):
    """Primes below 2,000: numbers without a composite's (divisor, multiple) row."""
    top = 2000
    multiples = spark.range(2, int(top**0.5) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(top - 1), F.col("id"))).alias("n"))
    return spark.range(2, top).withColumnRenamed("id", "n").join(multiples, "n", "left_anti")


sql("array_flatten", "SELECT p_brand, array_join(sort_array(array_distinct(flatten(collect_list(split(p_name, ' '))))), ' ') AS words FROM part GROUP BY p_brand", "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS words FROM part GROUP BY p_brand")
sql("last_wins_map", "SELECT l_partkey, max_by(l_suppkey, struct(l_orderkey, l_linenumber, l_suppkey)) AS v FROM lineitem GROUP BY l_partkey", "SELECT l_partkey, l_suppkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem) t WHERE r = 1")
sql("json_path", "SELECT event_id, coalesce(get_json_object(concat('{\"values\":[{\"value\":', props, '}]}'), '$.values[0].value.k'), '') AS k FROM events", "SELECT event_id, coalesce(json_extract_string('{\"values\":[{\"value\":' || props || '}]}', '$.values[0].value.k'), '') AS k FROM events")
rows("json_multi_join", "t", [('{"values":[{"value":"a"},{"value":"b"}]}',), ('{"values":[]}',)], "array_join(transform(from_json(t, 'values array<struct<value:string>>').values, x -> x.value), '__')", ["a__b", ""])
rows("json_tolerant", "t", [('{"k":1}',), ("broken",)], "from_json(t, 'k int').k", [1, None])
sql("json_emit", "SELECT c_custkey, to_json(named_struct('id', c_custkey, 'seg', c_mktsegment)) AS j FROM customer", "SELECT c_custkey, CAST(to_json({'id': c_custkey, 'seg': c_mktsegment}) AS VARCHAR) AS j FROM customer")
rows("fillback_merge", "pred, pcf", [("a__b", "b"), ("Y", None), (None, "c")], "CASE WHEN pred IS NULL THEN pcf WHEN pred IN ('Y', 'N') THEN CASE pred WHEN 'Y' THEN 'Yes' ELSE 'No' END WHEN pcf IS NULL THEN pred ELSE array_join(array_intersect(split(pred, '__'), split(pcf, '__')), '__') END", ["b", "Yes", "c"])


def indented(text: str | None) -> str | None:
    """JSON with an indentation of two; null for null and for what is no JSON."""
    try:
        return None if text is None else json.dumps(json.loads(text), indent=2)
    except ValueError:
        return None


@book.plan("json_pretty")
def json_pretty(spark, sf_dir):
    @F.pandas_udf("string")
    def pretty(s: pd.Series) -> pd.Series:
        return s.map(indented)

    return table(spark, sf_dir, "events").select("event_id", pretty("props").alias("pretty"))


sql("fm_score", "WITH x AS (SELECT l_orderkey AS id, l_linenumber AS f, l_quantity / 50 AS v FROM lineitem) SELECT id, round(0.1e0 + sum(v * 0.01e0 * f) + 0.5e0 * (power(sum(v * 0.1e0 * f), 2) - sum(power(v * 0.1e0 * f, 2))), 6) AS score FROM x GROUP BY id")
