"""Projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.operators.sharing import sharing, within
from tidewater.plans.query import Book, table

book = Book()
sql = book.sql

# projections and filters
sql("project_rename", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM customer")
sql("derived_pow", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * power(1 - l_discount, 1 + l_tax), 8) AS price, l_extendedprice / l_quantity AS unit_price FROM lineitem")
sql("mask_arith_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 0.9 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN 1 ELSE 0 END AS flag FROM orders")
sql("filter_conj", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 10")
sql("dropna_subset", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
sql("fillna", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql("group_size_filter", "SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents) t WHERE n >= 50")


@book.plan("dedup_keep_first", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) t WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    """The first row of a key by an explicit order; min over a struct combines map-side, a window wouldn't."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "first.*")


sql("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("value_replace", "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'BASIC' ELSE p_type END AS p_type FROM part")
sql("rowwise_clamp", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo, least(greatest(l_quantity, 5.0), 40.0) AS clamped FROM lineitem")
sql("composite_key", "SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), l_returnflag) AS k1, concat_ws('___', l_returnflag, l_linestatus) AS k2, l_partkey FROM lineitem")


@book.plan("dense_group_id", "SELECT p_partkey, dense_rank() OVER (ORDER BY concat_ws('|', p_brand, p_type)) - 1 AS group_id FROM part")
def dense_group_id(spark, sf_dir):
    """Ids by sorted key: ranks the distinct keys only, then joins them back."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("k"))
    ids = part.select("k").distinct().withColumn("group_id", (F.dense_rank().over(W.orderBy("k")) - 1).cast("long"))
    return part.join(ids, "k").select("p_partkey", "group_id")


sql("rounded_bucket", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(bround(l_discount * 100, 0) AS INT) AS bucket FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_discount * 100, 0) AS INT) AS bucket FROM lineitem")
sql("json_primary_pick", """SELECT id, CASE WHEN array_position(types, 'PRIMARY') > 0 THEN urls[array_position(types, 'PRIMARY') - 1] WHEN size(urls) > 1 THEN urls[1] ELSE urls[0] END AS url
FROM (SELECT id, from_json(u, 'array<string>') AS urls, from_json(t, 'array<string>') AS types FROM VALUES (1, '["u0","u1","u2"]', '["A","B","PRIMARY"]'), (2, '["u0","u1","u2"]', '["A","B","C"]'), (3, '["u0"]', '["A"]') AS v(id, u, t)) x""",
    "SELECT * FROM (VALUES (1, 'u2'), (2, 'u1'), (3, 'u0')) v(id, url)")
sql("split_positional", "SELECT event_id, CASE WHEN pr < 0.9 THEN 'train' ELSE 'test' END AS fold FROM (SELECT event_id, percent_rank() OVER (ORDER BY ts, event_id) AS pr FROM events) t")
sql("json_filter", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(get_json_object(props, '$.k') AS BIGINT) % 2 = 0",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")


@book.plan("stratified_sample")
def stratified_sample(spark, sf_dir):
    """A tenth of each language, by a hash of the key, so that reruns agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    share = F.percent_rank().over(order)
    return docs.withColumn("p", share).where("p < 0.1").drop("p")


@book.plan("weighted_sample")
def weighted_sample(spark, sf_dir):
    """100 customers without replacement, with chances by balance: the largest -ln(u) / w keys, u a hash of the key."""
    u = (F.pmod(F.xxhash64("c_custkey"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 1)
    weight = F.greatest(F.col("c_acctbal"), F.lit(0.01))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(-F.log(u) / weight, "c_custkey").limit(100)


# joins
sql("join_inner_multikey", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, a.n AS pair_rows FROM lineitem l
JOIN (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey) a
ON l.l_returnflag = a.l_returnflag AND l.l_linestatus = a.l_linestatus AND l.l_suppkey = a.l_suppkey""")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")


@book.plan("agg_joinback", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER (PARTITION BY l_partkey), 4) AS part_quantity, l_quantity / sum(l_quantity) OVER (PARTITION BY l_partkey) AS share FROM lineitem")
def agg_joinback(spark, sf_dir):
    """Aggregate and join back as one window: a single shuffle on the key."""
    total = F.sum("l_quantity").over(W.partitionBy("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(total, 4).alias("part_quantity"), (F.col("l_quantity") / total).alias("share"))


@book.plan("override_merge", "SELECT p_partkey, p_retailprice AS p_retailprice_pre_override, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def override_merge(spark, sf_dir):
    """Override rows replace values; the old ones stay under a suffix."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    override = part.where("p_size > 40").select("p_partkey", (F.col("p_retailprice") * 2).alias("new"))
    old = part.withColumnsRenamed({"p_retailprice": "p_retailprice_pre_override"}).drop("p_size")
    merged = old.join(override, "p_partkey", "left")
    return merged.select("p_partkey", "p_retailprice_pre_override", F.coalesce("new", "p_retailprice_pre_override").alias("p_retailprice"))


sql("anti_join", "SELECT c.c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)")
sql("semi_join", "SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)")


@book.plan("join_existing_pairs", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def join_existing_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return within(p, ["p_brand", "p_type", "p_size"], F.col("x.p_partkey") < F.col("y.p_partkey")).select(F.col("x.p_partkey").alias("a"), F.col("y.p_partkey").alias("b"))


@book.plan("sparse_attr_pairs", """SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON floor(a.c_acctbal) = floor(b.c_acctbal) AND a.c_custkey <> b.c_custkey""")
def sparse_attr_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").alias("k"))
    return within(c, ["k"], F.col("x.c_custkey") != F.col("y.c_custkey")).select(F.col("x.c_custkey").alias("a"), F.col("y.c_custkey").alias("b"))


sql("interval_join", """WITH s AS (SELECT user_id, event_id, unix_timestamp(ts) AS a, unix_timestamp(ts) + 3600 AS b, event_type FROM events)
SELECT x.user_id, x.event_id AS x, y.event_id AS y, greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.a <= y.b AND y.a <= x.b""",
    """WITH s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS b, event_type FROM events)
SELECT x.user_id, x.event_id AS x, y.event_id AS y, greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.a <= y.b AND y.a <= x.b""")


@book.plan("user_similarity", """WITH r AS (SELECT o.o_custkey AS u, l.l_partkey AS i, avg(l.l_quantity) AS q FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_partkey)
SELECT a.u AS u1, b.u AS u2, round(1 - tanh(sqrt(2 * avg((a.q - b.q) * (a.q - b.q)))), 6) AS sim, count(*) AS n FROM r a JOIN r b ON a.i = b.i AND a.u < b.u GROUP BY a.u, b.u HAVING count(*) >= 2""")
def user_similarity(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    r = both.groupBy(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.avg("l_quantity").alias("q"))
    d = F.col("x.q") - F.col("y.q")
    pairs = within(r, ["i"], F.col("x.u") < F.col("y.u")).select(F.col("x.u").alias("u1"), F.col("y.u").alias("u2"), (d * d).alias("d"))
    found = pairs.groupBy("u1", "u2").agg(F.round(1 - F.tanh(F.sqrt(2 * F.avg("d"))), 6).alias("sim"), F.count("*").alias("n"))
    return found.where("n >= 2")



@book.plan("lookup_broadcast", "SELECT c_custkey, n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def lookup_broadcast(spark, sf_dir):
    """A strict dictionary lookup: the dimension is checked for size and unique keys, a missing key is an error."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    if nation.count() <= 10_000:
        nation = F.broadcast(nation)
    found = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    strict = F.when(F.col("n_nationkey").isNull(), F.raise_error(F.lit("key not in the dictionary"))).otherwise(F.col("n_name"))
    return found.select("c_custkey", strict.alias("n_name"))


@book.plan("shared_attr_pairs", """WITH a AS (SELECT c_custkey AS id, concat('nation::', CAST(c_nationkey AS VARCHAR(9)), '::', CAST(floor(c_acctbal / 50) AS INT)) AS v FROM customer UNION ALL SELECT c_custkey, concat('bal::', CAST(floor(c_acctbal) AS INT)) FROM customer)
SELECT DISTINCT x.id AS src, y.id AS dst FROM a x JOIN a y ON x.v = y.v AND x.id <> y.id""")
def shared_attr_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation = F.expr("concat('nation::', CAST(c_nationkey AS VARCHAR(9)), '::', CAST(floor(c_acctbal / 50) AS INT))")
    balance = F.expr("concat('bal::', CAST(floor(c_acctbal) AS INT))")
    return sharing(c.select(F.col("c_custkey").alias("id"), F.explode(F.array(nation, balance)).alias("v"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


sql("value_overlap_match", """WITH t AS (SELECT DISTINCT p_type AS k, w FROM part LATERAL VIEW explode(split(p_name, ' ')) e AS w), u AS (SELECT DISTINCT p_brand AS k, w FROM part LATERAL VIEW explode(split(p_name, ' ')) e AS w)
SELECT t.k AS a, u.k AS b, count(*) AS overlap FROM t JOIN u ON t.w = u.w GROUP BY t.k, u.k""",
    """WITH t AS (SELECT DISTINCT p_type AS k, unnest(string_split(p_name, ' ')) AS w FROM part), u AS (SELECT DISTINCT p_brand AS k, unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT t.k AS a, u.k AS b, count(*) AS overlap FROM t JOIN u ON t.w = u.w GROUP BY t.k, u.k""")
sql("token_containment_join", """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT p_name, w FROM n LATERAL VIEW explode(split(p_name, ' ')) e AS w), z AS (SELECT p_name, count(*) AS k FROM t GROUP BY p_name)
SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.p_name < b.p_name JOIN z x ON x.p_name = a.p_name JOIN z y ON y.p_name = b.p_name
GROUP BY a.p_name, b.p_name, x.k, y.k HAVING count(*) = least(x.k, y.k) AND abs(x.k - y.k) <= 2""",
    """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM n), z AS (SELECT p_name, count(*) AS k FROM t GROUP BY p_name)
SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.p_name < b.p_name JOIN z x ON x.p_name = a.p_name JOIN z y ON y.p_name = b.p_name
GROUP BY a.p_name, b.p_name, x.k, y.k HAVING count(*) = least(x.k, y.k) AND abs(x.k - y.k) <= 2""")
sql("dtm_append", """WITH t AS (SELECT doc_id, lang, lower(w) AS w FROM documents LATERAL VIEW explode(split(text, ' ')) e AS w), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS term_id FROM (SELECT DISTINCT w FROM t WHERE lang = 'en' UNION SELECT DISTINCT w FROM t WHERE coalesce(lang, '') <> 'en') x)
SELECT t.doc_id, d.term_id, count(*) AS n FROM t JOIN d ON t.w = d.w GROUP BY t.doc_id, d.term_id""",
    """WITH t AS (SELECT doc_id, lang, lower(w) AS w FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w FROM documents) z), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS term_id FROM (SELECT DISTINCT w FROM t WHERE lang = 'en' UNION SELECT DISTINCT w FROM t WHERE coalesce(lang, '') <> 'en') x)
SELECT t.doc_id, d.term_id, count(*) AS n FROM t JOIN d ON t.w = d.w GROUP BY t.doc_id, d.term_id""")

# set operations
sql("union_all", "SELECT c_custkey AS k, c_name AS name, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("merge_value_sets", """SELECT p_brand, array_join(sort_array(collect_set(v)), ',') AS vals FROM (SELECT p_brand, p_type AS v FROM part UNION ALL SELECT p_brand, lower(p_type) FROM part) t WHERE length(v) > 2 GROUP BY p_brand""",
    """SELECT p_brand, array_to_string(list_sort(list(DISTINCT v)), ',') AS vals FROM (SELECT p_brand, p_type AS v FROM part UNION ALL SELECT p_brand, lower(p_type) FROM part) t WHERE length(v) > 2 GROUP BY p_brand""")
sql("unique_owner", "SELECT l_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1")
