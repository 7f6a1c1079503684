"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.query import Book, table

book = Book()
sql = book.sql

FACTS = "(SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_brand AS family, l.l_returnflag AS os, l.l_linestatus AS loc, l.l_extendedprice / l.l_quantity / 1000 AS price, l.l_quantity AS q, l.l_discount AS d FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"


@book.plan("agg_product", "SELECT l_returnflag, l_linestatus, l_orderkey, round(product(1 - l_discount), 12) AS kept FROM lineitem GROUP BY l_returnflag, l_linestatus, l_orderkey")
def agg_product(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_orderkey")
    return rows.agg(F.round(F.product(1 - F.col("l_discount")), 12).alias("kept"))


sql("agg_sum", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_max_flag", "SELECT l_partkey, max(l_discount) AS d, max(l_tax) AS t, CASE WHEN max(l_discount) < 1e-5 THEN 1 ELSE 0 END AS none FROM lineitem GROUP BY l_partkey")
sql("agg_minmax", "SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_suppkey")
sql("agg_weighted_mean", "SELECT l_partkey, round(sum(l_discount * (l_quantity + 1e-5)) / sum(l_quantity + 1e-5), 6) AS mean_discount FROM lineitem GROUP BY l_partkey")
sql("agg_smoothed_rate", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / (sum(l_quantity) + 1), 8) AS rate, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / (sum(l_quantity) + 1) > 0.3 THEN 1 ELSE 0 END AS high FROM lineitem GROUP BY l_suppkey")
sql("group_share", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(try_divide(l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey)), 0) AS share FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0), 0) AS share FROM lineitem")
sql("segment_sum", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS total FROM lineitem")
# demand = k * own^(beta - aw) * exp(sum over the group of ln(p) * aw), with beta -1.5, aw 0.1 / group size, k the quantity
DEMAND = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q * exp(g * a) * power(price, -1.5 - a), 6) AS demand {more}
FROM (SELECT *, sum(ln(price)) OVER w AS g, 0.1 / count(*) OVER w AS a, min(price) OVER w AS lo, max(price) OVER w AS hi, count(*) OVER w AS n FROM """ + FACTS + """ f WINDOW w AS (PARTITION BY family, os, loc)) t"""
sql("demand_model", DEMAND.format(more=""))
# own price at one bound while all rivals are at the other: closed form, no loop over rows
sql("demand_minmax", DEMAND.format(more=", round(q * exp(a * ((n - 1) * ln(lo) + ln(hi))) * power(hi, -1.5 - a), 6) AS demand_min, round(q * exp(a * ((n - 1) * ln(hi) + ln(lo))) * power(lo, -1.5 - a), 6) AS demand_max"))
sql("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
sql("zscore_by_key", "SELECT o_orderkey, round(CASE WHEN sd = 0 THEN 0 ELSE (o_totalprice - m) / sd END, 6) AS z FROM (SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS m, stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey) AS sd, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) t WHERE n > 1")
sql("inverted_index", "SELECT l_partkey, array_join(sort_array(collect_set(l_orderkey)), ',') AS orders_ FROM lineitem GROUP BY l_partkey",
    "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS orders_ FROM lineitem GROUP BY l_partkey")
TOKENS = ("(SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) e AS pos, w)",
          "(SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents) z)")


def both(name: str, text: str) -> None:
    """A query over TOKENS in either dialect."""
    sql(name, text.replace("TOKENS", TOKENS[0]), text.replace("TOKENS", TOKENS[1]))


both("token_counts", "SELECT w, count(*) AS n FROM TOKENS t GROUP BY w")
sql("alias_value_counts", "SELECT v, count(*) AS n FROM (SELECT p_partkey, p_type AS v FROM part UNION SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'STANDARD' ELSE p_type END FROM part) t GROUP BY v")
MI = """WITH t AS (SELECT DISTINCT k.doc_id, k.w, l.quality AS y FROM TOKENS k JOIN labels l ON k.doc_id = l.doc_id), n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
c AS (SELECT y, count(DISTINCT doc_id) AS ny FROM t GROUP BY y), f AS (SELECT w, count(*) AS nw FROM t GROUP BY w), j AS (SELECT w, y, count(*) AS nwy FROM t GROUP BY w, y),
m AS (SELECT f.w, c.y, coalesce(j.nwy, 0) AS a, f.nw - coalesce(j.nwy, 0) AS b, c.ny - coalesce(j.nwy, 0) AS d, n.n - c.ny - f.nw + coalesce(j.nwy, 0) AS e, f.nw, c.ny, n.n FROM f CROSS JOIN c CROSS JOIN n LEFT JOIN j ON j.w = f.w AND j.y = c.y),
s AS (SELECT w, y, round(CASE WHEN a > 0 THEN a * 1.0e0 / n * ln(a * 1.0e0 * n / (nw * ny)) ELSE 0 END + CASE WHEN b > 0 THEN b * 1.0e0 / n * ln(b * 1.0e0 * n / (nw * (n - ny))) ELSE 0 END
 + CASE WHEN d > 0 THEN d * 1.0e0 / n * ln(d * 1.0e0 * n / ((n - nw) * ny)) ELSE 0 END + CASE WHEN e > 0 THEN e * 1.0e0 / n * ln(e * 1.0e0 * n / ((n - nw) * (n - ny))) ELSE 0 END, 8) AS mi FROM m) """
both("mi_features", MI + "SELECT w, max(mi) AS mi FROM s GROUP BY w ORDER BY mi DESC, w LIMIT 100")
both("mi_per_label", MI + "SELECT y, w, mi FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY mi DESC, w) AS r FROM s) x WHERE r <= 50")
both("mi_class_union", MI + "SELECT DISTINCT w FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY mi DESC, w) AS r FROM s) x WHERE r <= 50")
sql("cluster_entropy", "SELECT p_brand, sum(n) AS size, round(-sum(n * 1.0 / t * log2(n * 1.0 / t)), 8) AS entropy FROM (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t FROM part GROUP BY p_brand, p_type) x GROUP BY p_brand",
    "SELECT p_brand, CAST(sum(n) AS BIGINT) AS size, round(-sum(n * 1.0::DOUBLE / t * log2(n * 1.0::DOUBLE / t)), 8) AS entropy FROM (SELECT p_brand, p_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS BIGINT) AS t FROM part GROUP BY p_brand, p_type) x GROUP BY p_brand")
sql("best_split_gini", """WITH v AS (SELECT d.n_chars AS x, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT x, count(*) AS n, sum(y) AS p FROM v GROUP BY x),
c AS (SELECT x, CAST(sum(n) OVER (ORDER BY x) AS BIGINT) AS ln, CAST(sum(p) OVER (ORDER BY x) AS BIGINT) AS lp, CAST(sum(n) OVER () AS BIGINT) AS n, CAST(sum(p) OVER () AS BIGINT) AS p FROM g),
s AS (SELECT x, round(2.0e0 * lp * (ln - lp) / ln / n + CASE WHEN n > ln THEN 2.0e0 * (p - lp) * (n - ln - p + lp) / (n - ln) / n ELSE 0 END, 9) AS gini FROM c)
SELECT x, gini FROM s ORDER BY gini, x LIMIT 1""",
    """WITH v AS (SELECT d.n_chars AS x, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT x, count(*) AS n, sum(y) AS p FROM v GROUP BY x),
c AS (SELECT x, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS ln, CAST(sum(p) OVER (ORDER BY x) AS DOUBLE) AS lp, CAST(sum(n) OVER () AS DOUBLE) AS n, CAST(sum(p) OVER () AS DOUBLE) AS p FROM g),
s AS (SELECT x, round(2.0e0 * lp * (ln - lp) / ln / n + CASE WHEN n > ln THEN 2.0e0 * (p - lp) * (n - ln - p + lp) / (n - ln) / n ELSE 0 END, 9) AS gini FROM c)
SELECT x, gini FROM s ORDER BY gini, x LIMIT 1""")
sql("variant_scores", "SELECT p_brand, count(DISTINCT concat_ws('|', p_type, CAST(p_size AS VARCHAR(9)))) / (count(*) * 1.0e0) AS combo, count(DISTINCT p_type) / (count(*) * 1.0e0) AS by_type, count(DISTINCT p_size) / (count(*) * 1.0e0) AS by_size FROM part GROUP BY p_brand")
sql("multilabel_prf", """WITH p AS (SELECT d.doc_id, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS y FROM documents d), j AS (SELECT l.quality AS t, p.y FROM labels l JOIN p ON l.doc_id = p.doc_id),
c AS (SELECT v.k, sum(CASE WHEN t = k AND y = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t <> k AND y = k THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t = k AND y <> k THEN 1 ELSE 0 END) AS fn FROM j CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) v GROUP BY v.k)
SELECT k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp * 1.0e0 / (tp + fp) AS prec, tp * 1.0e0 / (tp + fn) AS rec, 2.0e0 * tp / (2 * tp + fp + fn) AS f1 FROM c""")
sql("forecast_errors", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS y FROM events GROUP BY CAST(ts AS DATE)), f AS (SELECT y, lag(y) OVER (ORDER BY day) AS p FROM d)
SELECT round(avg(abs(p - y) / abs(y)), 6) AS mape, round(avg(p - y), 6) AS me, round(avg(abs(p - y)), 6) AS mae, round(avg((p - y) / y), 6) AS mpe, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM f WHERE p IS NOT NULL""")
sql("mean_ci_parts", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, count(*) AS n FROM orders GROUP BY o_orderpriority")
sql("majority_vote", """WITH c AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag), g AS (SELECT l_orderkey, count(*) AS k, max(n) AS m FROM c GROUP BY l_orderkey),
w AS (SELECT c.l_orderkey, min(c.v) AS v, count(*) AS ties FROM c JOIN g ON c.l_orderkey = g.l_orderkey AND c.n = g.m GROUP BY c.l_orderkey)
SELECT g.l_orderkey, CASE WHEN g.k = 1 THEN w.v WHEN g.m > 1 AND w.ties = 1 THEN w.v END AS winner FROM g JOIN w ON g.l_orderkey = w.l_orderkey""")
BIGRAMS = ("WITH b AS (SELECT inline(concat(CASE WHEN size(ws) > 0 THEN array(named_struct('a', '__BEGIN__', 'b', ws[0])) ELSE array() END, transform(ws, (x, i) -> named_struct('a', x, 'b', coalesce(get(ws, i + 1), '__END__'))))) FROM (SELECT regexp_extract_all(lower(text), '[a-z]+', 0) AS ws FROM documents) d), c AS (SELECT a, b, count(*) AS n FROM b GROUP BY a, b) ",
           "WITH b AS (SELECT doc_id, w AS a, coalesce(lead(w) OVER (PARTITION BY doc_id ORDER BY pos), '__END__') AS b FROM TOKENS t UNION ALL SELECT doc_id, '__BEGIN__', w FROM TOKENS t WHERE pos = 0), c AS (SELECT a, b, count(*) AS n FROM b GROUP BY a, b) ".replace("TOKENS", TOKENS[1]))


def bigrams(name: str, text: str) -> None:
    sql(name, BIGRAMS[0] + text, BIGRAMS[1] + text)


bigrams("bigram_probs", "SELECT a, b, n, n * 1.0e0 / sum(n) OVER (PARTITION BY a) AS forward, n * 1.0e0 / sum(n) OVER (PARTITION BY b) AS backward FROM c")
bigrams("bigram_mean_prob", "SELECT a, round(avg(p), 8) AS mean_p FROM (SELECT a, n * 1.0e0 / sum(n) OVER (PARTITION BY a) AS p FROM c) x GROUP BY a")
both("unigram_075", "SELECT w, round(p / sum(p) OVER (), 12) AS share FROM (SELECT w, power(count(*), 0.75e0) AS p FROM TOKENS t GROUP BY w) x")
SEQ = "(SELECT user_id, event_type AS tag, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"
sql("hmm_transitions", f"""WITH s AS {SEQ}, g AS (SELECT DISTINCT event_type AS tag FROM events), c AS (SELECT prev, tag, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY prev, tag)
SELECT a.tag AS prev, b.tag AS tag, (coalesce(c.n, 0) + 1) * 1.0e0 / sum(coalesce(c.n, 0) + 1) OVER (PARTITION BY a.tag) AS p FROM g a CROSS JOIN g b LEFT JOIN c ON c.prev = a.tag AND c.tag = b.tag""")
sql("markov_transitions", f"WITH s AS {SEQ} SELECT coalesce(prev, '__START__') AS prev, tag, count(*) * 1.0e0 / sum(count(*)) OVER (PARTITION BY coalesce(prev, '__START__')) AS p FROM s GROUP BY coalesce(prev, '__START__'), tag")
both("idf_smooth", "SELECT w, round(ln((1.0e0 + n.n) / (1.0e0 + df)) + 1, 9) AS idf FROM (SELECT w, count(DISTINCT doc_id) AS df FROM TOKENS t GROUP BY w) x CROSS JOIN (SELECT count(*) AS n FROM documents) n")
both("idf_merge", """WITH p AS (SELECT d.source, t.w, count(DISTINCT t.doc_id) AS df FROM TOKENS t JOIN documents d ON t.doc_id = d.doc_id GROUP BY d.source, t.w)
SELECT w, round(ln((1.0e0 + n.n) / (1.0e0 + sum(df))) + 1, 9) AS idf FROM p CROSS JOIN (SELECT count(*) AS n FROM documents) n GROUP BY w, n.n""")
both("dtm", "WITH c AS (SELECT doc_id, w, count(*) AS n FROM TOKENS t GROUP BY doc_id, w), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS term_id FROM (SELECT DISTINCT w FROM c) x) SELECT c.doc_id, d.term_id, c.n FROM c JOIN d ON c.w = d.w")
sql("numeric_attr", r"SELECT p_type, CASE WHEN avg(CASE WHEN p_name rlike '[0-9]' THEN 1.0e0 ELSE 0.0e0 END) > 0.5 THEN 1 ELSE 0 END AS numeric_name, CASE WHEN avg(CASE WHEN p_brand rlike '[0-9]' THEN 1.0e0 ELSE 0.0e0 END) > 0.5 THEN 1 ELSE 0 END AS numeric_brand FROM part GROUP BY p_type",
    r"SELECT p_type, CASE WHEN avg(CASE WHEN regexp_matches(p_name, '[0-9]') THEN 1.0e0 ELSE 0.0e0 END) > 0.5 THEN 1 ELSE 0 END AS numeric_name, CASE WHEN avg(CASE WHEN regexp_matches(p_brand, '[0-9]') THEN 1.0e0 ELSE 0.0e0 END) > 0.5 THEN 1 ELSE 0 END AS numeric_brand FROM part GROUP BY p_type")
sql("classifier_gate", "SELECT p_brand, CASE WHEN count(*) * 1.0e0 / count(DISTINCT p_type) < 10 OR sum(CASE WHEN instr(lower(p_name), lower(p_type)) > 0 THEN 1 ELSE 0 END) * 1.0e0 / count(*) > 0.6 THEN false ELSE true END AS usable FROM part GROUP BY p_brand")
sql("reduce_min_count", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, sum(CASE WHEN l_quantity = 10 THEN 1 ELSE 0 END) AS tens, count(*) AS n FROM lineitem",
    "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum(CASE WHEN l_quantity = 10 THEN 1 ELSE 0 END) AS BIGINT) AS tens, count(*) AS n FROM lineitem")


@book.plan("kth_smallest", "SELECT l_extendedprice AS v FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 999")
def kth_smallest(spark, sf_dir):
    """The 1,000th smallest: the k smallest of each partition first, then the largest of k."""
    low = table(spark, sf_dir, "lineitem").select("l_extendedprice").orderBy("l_extendedprice").limit(1000)
    return low.agg(F.max("l_extendedprice").alias("v"))


sql("implicit_norm", "SELECT o_custkey, round(1 / sqrt(count(*) + 0.001e0), 9) AS norm FROM orders GROUP BY o_custkey")
sql("coverage", "SELECT d.source, sum(CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN l.quality IS NULL AND d.n_chars > 500 THEN 1 ELSE 0 END) AS predicted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source",
    "SELECT d.source, CAST(sum(CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN l.quality IS NULL AND d.n_chars > 500 THEN 1 ELSE 0 END) AS BIGINT) AS predicted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
sql("majority_n3", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag HAVING count(*) > (SELECT count(*) / 3 FROM lineitem)")
sql("string_agg", "SELECT p_brand, array_join(sort_array(collect_set(p_type)), ', ') AS types FROM part GROUP BY p_brand", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS types FROM part GROUP BY p_brand")
