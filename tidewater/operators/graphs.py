"""Graph operators, probabilistic and index structures, similarity search."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.operators.neighbours import deal, meet, nearest, pairs, rows_of
from tidewater.operators.sharing import sharing
from tidewater.operators.words import both_ways, counted, documents_words
from tidewater.plans.query import Book, table

book = Book()
sql = book.sql

TOK = ("(SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) e AS pos, w)",
       "(SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents) z)")


def both(name: str, text: str) -> None:
    sql(name, text.replace("TOK", TOK[0]), text.replace("TOK", TOK[1]))


# words at most two places apart, both ways round
PAIRS = "t AS (SELECT w, lead(w, 1) OVER o AS n1, lead(w, 2) OVER o AS n2 FROM TOK t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT a, b, count(*) AS c FROM (SELECT w AS a, n1 AS b FROM t UNION ALL SELECT w, n2 FROM t) z WHERE b IS NOT NULL GROUP BY a, b), p AS (SELECT a, b, CAST(sum(c) * 2 AS BIGINT) AS c FROM (SELECT a, b, c FROM h UNION ALL SELECT b, a, c FROM h) u GROUP BY a, b)"
COND = ", d AS (SELECT a, sum(c) AS deg FROM p GROUP BY a), e AS (SELECT p.a, p.b, p.c * 1.0e0 / d.deg AS p FROM p JOIN d ON p.a = d.a) "


def graph(name: str, text: str):
    """A plan whose other engine's SQL is over the pairs p."""
    return book.plan(name, f"WITH {PAIRS.replace('TOK', TOK[1])}{text}")


def word_graph(spark, sf_dir):
    """(a, b, c): how often two words are at most two places apart, twice over."""
    return counted(documents_words(spark, sf_dir), both_ways).select("a", "b", (F.col("n") * 2).alias("c"))


def shares(spark, sf_dir):
    """(a, b, p): a pair's share of all pairs of its first word."""
    return word_graph(spark, sf_dir).select("a", "b", (F.col("c") * F.lit(1.0) / F.sum("c").over(W.partitionBy("a"))).alias("p"))


def best_five(e):
    return e.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("p"), "b"))).where("r <= 5").select("a", "b", "p")


@graph("word_graph_jaccard", ", d AS (SELECT a, sum(c) AS deg FROM p GROUP BY a) SELECT p.a, p.b, p.c * 1.0e0 / (x.deg + y.deg - p.c) AS weight FROM p JOIN d x ON p.a = x.a JOIN d y ON p.b = y.a")
def word_graph_jaccard(spark, sf_dir):
    # the graph is the same both ways round, so that a word's degree is the sum of either side
    p = word_graph(spark, sf_dir).withColumn("y", F.sum("c").over(W.partitionBy("b"))).withColumn("x", F.sum("c").over(W.partitionBy("a")))
    return p.select("a", "b", (F.col("c") * F.lit(1.0) / (F.col("x") + F.col("y") - F.col("c"))).alias("weight"))


@graph("word_graph_cond", f"{COND}SELECT a, b, p FROM e")
def word_graph_cond(spark, sf_dir):
    return shares(spark, sf_dir)


@graph("most_similar_d1", f"{COND}SELECT a, b, p FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS r FROM e) x WHERE r <= 5")
def most_similar_d1(spark, sf_dir):
    return best_five(shares(spark, sf_dir))


@graph("most_similar_multi", f"{COND}SELECT b, round(sum(1 + p), 8) AS score FROM e WHERE a IN ('de', 'la', 'que') GROUP BY b ORDER BY score DESC, b LIMIT 20")
def most_similar_multi(spark, sf_dir):
    near = shares(spark, sf_dir).where("a IN ('de', 'la', 'que')").groupBy("b").agg(F.round(F.sum(1 + F.col("p")), 8).alias("score"))
    return near.orderBy(F.desc("score"), "b").limit(20)


# from one word, over the five best neighbours of each word, at most three steps
@graph("best_path", COND + ", k AS (SELECT a, b, p FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS r FROM e WHERE a <> b) x WHERE r <= 5), one AS (SELECT a, b, p FROM k WHERE a = 'de'), two AS (SELECT x.a, y.b, max(x.p * y.p) AS p FROM one x JOIN k y ON x.b = y.a WHERE x.a <> y.b GROUP BY x.a, y.b), three AS (SELECT x.a, y.b, max(x.p * y.p) AS p FROM two x JOIN k y ON x.b = y.a WHERE x.a <> y.b GROUP BY x.a, y.b) SELECT a, b, round(max(p), 10) AS p FROM (SELECT a, b, p FROM one UNION ALL SELECT a, b, p FROM two UNION ALL SELECT a, b, p FROM three) z GROUP BY a, b")
def best_path(spark, sf_dir):
    checkpoint_dir(spark)
    k = best_five(shares(spark, sf_dir).where("a <> b")).checkpoint()
    on = k.select(F.col("a").alias("via"), F.col("b").alias("to"), F.col("p").alias("more"))
    step = now = k.where("a = 'de'")
    for _ in range(2):
        now = now.join(on, F.col("b") == F.col("via")).where("a <> to").groupBy("a", F.col("to").alias("b")).agg(F.max(F.col("p") * F.col("more")).alias("p"))
        step = step.union(now)
    return step.groupBy("a", "b").agg(F.round(F.max("p"), 10).alias("p"))


def neighbourly(spark, sf_dir):
    """(w, l, r) of every token and its neighbours, from each document's array, without a window."""
    words = table(spark, sf_dir, "documents").select(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)").alias("ws"))
    return words.select(F.inline(F.expr("transform(ws, (x, i) -> named_struct('w', x, 'l', get(ws, i - 1), 'r', get(ws, i + 1)))")))


# the word that a rare one stands for, by its neighbours: frequent words known to follow the word before and to precede the one after


@book.plan("spell_context", "WITH t AS (SELECT w, lag(w) OVER o AS l, lead(w) OVER o AS r FROM TOK t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), v AS (SELECT w, count(*) AS n FROM t GROUP BY w), big AS (SELECT t.w AS a, t.r AS b, count(*) AS n FROM t JOIN v ON v.w = t.w WHERE t.r IS NOT NULL GROUP BY t.w, t.r), q AS (SELECT t.w, t.l, t.r FROM t JOIN v ON v.w = t.w WHERE v.n = 1 AND length(t.w) >= 5 AND t.l IS NOT NULL AND t.r IS NOT NULL), c AS (SELECT q.w, f.b AS candidate, f.n * g.n AS score FROM q JOIN big f ON f.a = q.l JOIN big g ON g.a = f.b AND g.b = q.r WHERE f.b <> q.w AND abs(length(f.b) - length(q.w)) <= 2 AND levenshtein(f.b, q.w) <= 2) SELECT w, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, candidate) AS k FROM c) z WHERE k = 1".replace("TOK", TOK[1]))
def spell_context(spark, sf_dir):
    """Candidates and rare words meet by the word before and a third of the candidate.

    Of three parts of a candidate at most two edits away one is left as it is, and stands in the rare
    word at a place that the edits left and right of it allow.
    """
    t = neighbourly(spark, sf_dir)
    big = t.where("r is not null").groupBy(F.col("w").alias("a"), F.col("r").alias("b")).agg(F.count("*").alias("n"))
    q = t.groupBy("w").agg(F.count("*").alias("n"), F.max("l").alias("l"), F.max("r").alias("r")).where("n = 1 and length(w) >= 5 and l is not null and r is not null").drop("n")
    parts = F.expr("transform(sequence(0, 2), k -> named_struct('k', k, 'size', length(b), 'text', substring(b, (k * length(b)) div 3 + 1, ((k + 1) * length(b)) div 3 - (k * length(b)) div 3)))")
    f = big.where("length(b) >= 3").select("a", "b", "n", F.explode(parts).alias("p"))
    probes = F.expr("""array_distinct(flatten(flatten(transform(filter(sequence(length(w) - 2, length(w) + 2), s -> s >= 3), s -> transform(sequence(0, 2), k -> transform(
        filter(sequence(-2, 2), d -> abs(d) + abs(length(w) - s - d) <= 2 AND (k * s) div 3 + d >= 0 AND ((k + 1) * s) div 3 + d <= length(w)),
        d -> named_struct('k', k, 'size', s, 'text', substring(w, (k * s) div 3 + d + 1, ((k + 1) * s) div 3 - (k * s) div 3))))))))""")
    p = lambda: (F.col("p.k").cast("int").alias("k"), F.col("p.size").cast("int").alias("size"), F.col("p.text").alias("text"))
    asked = q.select("w", "r", F.col("l").alias("a"), F.explode(probes).alias("p")).select("w", "r", "a", *p())
    near = f.select("a", "b", F.col("n").alias("before"), *p()).join(asked.hint("merge"), ["a", "k", "size", "text"]).where("b <> w and levenshtein(b, w) <= 2").select("w", "r", "b", "before").distinct()
    found = near.hint("merge").join(big.select(F.col("a").alias("b"), F.col("b").alias("r"), F.col("n").alias("after")), ["b", "r"])
    best = found.groupBy("w").agg(F.min(F.struct((-F.col("before") * F.col("after")).alias("s"), F.col("b").alias("candidate"))).alias("m"))
    return best.select("w", "m.candidate", (-F.col("m.s")).alias("score"))


# a rare word that is two known ones run together, split where the product of their counts is largest
sql("space_correct", "WITH v AS (SELECT w, count(*) AS n FROM " + TOK[0] + " t GROUP BY w), q AS (SELECT w, explode(sequence(2, length(w) - 2)) AS i FROM v WHERE n <= 2 AND length(w) >= 5), c AS (SELECT q.w, concat(a.w, ' ', b.w) AS apart, a.n * b.n AS score FROM q JOIN v a ON a.w = left(q.w, i) JOIN v b ON b.w = substring(q.w, i + 1) WHERE a.n >= 5 AND b.n >= 5) SELECT w, apart, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, apart) AS k FROM c) z WHERE k = 1",
    "WITH v AS (SELECT w, count(*) AS n FROM " + TOK[1] + " t GROUP BY w), q AS (SELECT w, unnest(range(2, length(w) - 1)) AS i FROM v WHERE n <= 2 AND length(w) >= 5), c AS (SELECT q.w, concat(a.w, ' ', b.w) AS apart, a.n * b.n AS score FROM q JOIN v a ON a.w = left(q.w, i) JOIN v b ON b.w = substring(q.w, i + 1) WHERE a.n >= 5 AND b.n >= 5) SELECT w, apart, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, apart) AS k FROM c) z WHERE k = 1")
both("spell_candidates", "WITH v AS (SELECT w, count(*) AS n FROM TOK t GROUP BY w), r AS (SELECT * FROM v WHERE n = 1 AND length(w) BETWEEN 5 AND 7), g AS (SELECT * FROM v WHERE n >= 20 AND length(w) >= 4) SELECT r.w, g.w AS candidate, levenshtein(r.w, g.w) AS dist FROM r JOIN g ON left(r.w, 2) = left(g.w, 2) AND abs(length(r.w) - length(g.w)) <= 1 WHERE levenshtein(r.w, g.w) <= 2")

EDGES = "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON floor(a.c_acctbal / 5) = floor(b.c_acctbal / 5) AND a.c_custkey <> b.c_custkey"


@book.plan("identity_edges", f"SELECT DISTINCT a, b, md5(concat_ws('::', CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS id FROM ({EDGES}) e")
def identity_edges(spark, sf_dir):
    pairs = sharing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 5).alias("v")))
    return pairs.select("a", "b", F.md5(F.concat_ws("::", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")).alias("id"))


def checkpoint_dir(spark) -> None:
    """spark.checkpoint.dir where it is set; a folder of our own only on a local master, as in tests."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))


def closure(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) by min-label propagation with pointer jumping; each round is cut in the shared folder."""
    checkpoint_dir(edges.sparkSession)
    both_ways = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both_ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    for _ in range(rounds):
        near = both_ways.join(labels.hint("merge"), F.col("b") == F.col("id")).groupBy(F.col("a").alias("k")).agg(F.min("component").alias("m"))
        low = labels.join(near.hint("merge"), F.col("id") == F.col("k")).select("id", F.least("component", "m").alias("c"), F.col("component").alias("before"))
        root = low.select(F.col("id").alias("r"), F.col("c").alias("rc"))
        labels = low.join(root.hint("merge"), F.col("c") == F.col("r"), "left").select("id", F.least("c", F.coalesce("rc", "c")).alias("component"), (F.least("c", F.coalesce("rc", "c")) < F.col("before")).alias("moved")).checkpoint()
        if labels.where("moved").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError("labels did not settle")


@book.plan("connected_components", f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a) SELECT id, min(reach) AS component FROM r GROUP BY id")
def connected_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 5).alias("k"))
    # customers of one key are linked in a chain, which has the same components as all pairs
    nxt = F.lead("c_custkey").over(W.partitionBy("k").orderBy("c_custkey"))
    return closure(c.select(F.col("c_custkey").alias("a"), nxt.alias("b")).where("b is not null"))


@book.plan("shortest_paths", "WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 7 + s_suppkey) % 25 AS b, 1 + s_suppkey % 9 AS w FROM supplier), r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS d, 0 AS hops UNION SELECT e.b, r.d + e.w, hops + 1 FROM r JOIN e ON e.a = r.n WHERE hops < 4) SELECT n, CAST(min(d) AS BIGINT) AS dist FROM r GROUP BY n")
def shortest_paths(spark, sf_dir):
    """Cheapest way from node 0 with at most four steps, by bounded relaxation."""
    s = table(spark, sf_dir, "supplier")
    e = s.select(F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).alias("b"), (1 + F.col("s_suppkey") % 9).alias("w")).distinct()
    best = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("dist"))
    for _ in range(4):
        step = best.join(e, F.col("n") == F.col("a")).select(F.col("b").alias("n"), (F.col("dist") + F.col("w")).alias("dist"))
        best = best.union(step).groupBy("n").agg(F.min("dist").alias("dist"))
    return best


def topo_levels(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, level, far) of the nodes of weighted edges (a, b, w): the longest paths to each by steps and by weight.

    Nodes come in topological order by level; a graph with a cycle gives no rows. A round settles the
    nodes whose predecessors are all settled, and each is cut in the shared folder.
    """
    checkpoint_dir(edges.sparkSession)
    left = edges.select("a", "b", "w").distinct().checkpoint()
    nodes = left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("id"))
    ready = nodes.join(left.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("far")).checkpoint()
    due = nodes.select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("far")).limit(0)
    done = ready
    for _ in range(rounds):
        if left.isEmpty():
            return done
        if ready.isEmpty():
            return done.limit(0)
        step = left.join(ready, F.col("a") == F.col("id")).select(F.col("b").alias("id"), (F.col("level") + 1).alias("level"), (F.col("far") + F.col("w")).alias("far"))
        due = due.union(step).groupBy("id").agg(F.max("level").alias("level"), F.max("far").alias("far")).checkpoint()
        left = left.join(ready, F.col("a") == F.col("id"), "left_anti").checkpoint()
        waiting = left.select(F.col("b").alias("id")).distinct()
        ready = due.join(waiting, "id", "left_anti").checkpoint()
        due = due.join(waiting, "id", "left_semi").checkpoint()
        done = done.union(ready)
    raise RuntimeError("levels did not settle")


STEPS = "SELECT DISTINCT s_nationkey AS a, s_nationkey + 1 + s_suppkey % 3 AS b, 1 + s_suppkey % 9 AS w FROM supplier"


def nation_steps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_nationkey") + 1 + F.col("s_suppkey") % 3).cast("long").alias("b"), (1 + F.col("s_suppkey") % 9).alias("w"))


@book.plan("critical_path", f"WITH RECURSIVE e AS ({STEPS}), r AS (SELECT a::BIGINT AS n, 0::BIGINT AS d FROM e UNION SELECT e.b, r.d + e.w FROM r JOIN e ON e.a = r.n) SELECT CAST(coalesce(max(d), 0) AS BIGINT) AS longest FROM r")
def critical_path(spark, sf_dir):
    return topo_levels(nation_steps(spark, sf_dir)).agg(F.coalesce(F.max("far"), F.lit(0)).alias("longest"))


@book.plan("topo_order", f"WITH RECURSIVE e AS ({STEPS}), r AS (SELECT a::BIGINT AS id, 0 AS level FROM e UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.id) SELECT id, CAST(max(level) AS INT) AS level FROM r GROUP BY id")
def topo_order(spark, sf_dir):
    return topo_levels(nation_steps(spark, sf_dir)).select("id", "level")


# vectors
V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
DIST = "list_distance(a.e, b.e)"


# a stated query set (every 20th vector) against all rows

def measured(name: str, text: str):
    """A plan whose other engine's SQL is over the vectors v."""
    return book.plan(name, f"WITH {V}" + text.replace("DIST", DIST))


def known(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


ASKED = "vec_id % 20 = 0"


@measured("knn_exact", ", d AS (SELECT a.vec_id AS q, b.vec_id AS n, round(DIST, 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT q, n, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS r FROM d) x WHERE r <= 5")
def knn_exact(spark, sf_dir):
    return nearest(known(spark, sf_dir), ASKED, 5).select("q", "n", "dist")


@measured("radius_join", ", d AS (SELECT a.vec_id AS q, b.vec_id AS n, round(DIST, 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT q, n, dist FROM d WHERE dist <= 1.2")
def radius_join(spark, sf_dir):
    return pairs(known(spark, sf_dir), ASKED, radius=1.2).select("q", "n", "dist")


@measured("knn_within_label", ", d AS (SELECT a.vec_id AS q, b.vec_id AS n, round(DIST, 6) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT q, n, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS r FROM d) x WHERE r <= 3")
def knn_within_label(spark, sf_dir):
    return nearest(known(spark, sf_dir), "true", 3, ["label"]).select("q", "n", "dist")


@measured("knn_vote", ", d AS (SELECT a.vec_id AS q, b.label AS l, b.vec_id AS n, round(DIST, 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), k AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS r FROM d) x WHERE r <= 5), c AS (SELECT q, l, count(*) AS n FROM k GROUP BY q, l) SELECT q, l AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, l) AS r FROM c) y WHERE r = 1")
def knn_vote(spark, sf_dir):
    votes = nearest(known(spark, sf_dir), ASKED, 5).groupBy("q", "label").agg(F.count("*").alias("n"))
    order = W.partitionBy("q").orderBy(F.desc("n"), F.asc_nulls_last("label"))
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("q", "label", "n")


@measured("knn_laplacian", ", d AS (SELECT a.vec_id AS q, b.vec_id AS n, round(DIST, 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id), k AS (SELECT q, n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS r FROM d) x WHERE r <= 3), s AS (SELECT q AS i, n AS j FROM k UNION SELECT n, q FROM k) SELECT i, j, -1 AS v FROM s UNION ALL SELECT i, i, CAST(count(*) AS INT) FROM s GROUP BY i")
def knn_laplacian(spark, sf_dir):
    """Neighbours among all vectors, whatever their labels, both ways round; degrees on the diagonal."""
    checkpoint_dir(spark)
    k = nearest(known(spark, sf_dir), "true", 3).select(F.explode(F.expr("array(named_struct('i', q, 'j', n), named_struct('i', n, 'j', q))")).alias("s"))
    s = k.select("s.*").distinct().checkpoint()
    return s.select("i", "j", F.lit(-1).alias("v")).union(s.groupBy("i").agg(F.count("*").cast("int").alias("v")).select("i", F.col("i").alias("j"), "v"))


@measured("grouping_eval", ", d AS (SELECT a.vec_id AS q, b.vec_id AS n, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same, round(DIST, 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), k AS (SELECT q, same, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS r FROM d), g AS (SELECT q, sum(same) AS gold FROM d GROUP BY q) SELECT k.q, sum(k.same) / 5.0e0 AS prec, CASE WHEN g.gold = 0 THEN 0 ELSE sum(k.same) * 1.0e0 / g.gold END AS rec FROM k JOIN g ON k.q = g.q WHERE k.r <= 5 GROUP BY k.q, g.gold")
def grouping_eval(spark, sf_dir):
    e = known(spark, sf_dir).where("vec_id is not null")
    k = nearest(e, ASKED, 5).groupBy("q").agg(F.sum(F.expr("if(q_label = label, 1, 0)")).alias("same"))
    # rows of a label, less those of the query's own id
    own = e.where(ASKED).groupBy(F.col("vec_id").alias("g"), "label").agg(F.count("*").alias("m"))
    totals = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("c"))
    gold = own.join(totals, F.col("label") == F.col("l"), "left").groupBy("g").agg(F.sum(F.coalesce(F.expr("m * (c - m)"), F.lit(0))).alias("gold"))
    rec = F.when(F.col("gold") == 0, F.lit(0.0)).otherwise(F.col("same") * F.lit(1.0) / F.col("gold"))
    return k.join(gold, F.col("q") == F.col("g")).select("q", (F.col("same") / F.lit(5.0)).alias("prec"), rec.alias("rec"))


# the signs of all 64 components, in two halves
CODE = ("c AS (SELECT vec_id, aggregate(slice(embedding, 1, 32), 0L, (s, x) -> s * 2 + CASE WHEN x > 0 THEN 1 ELSE 0 END) AS lo, aggregate(slice(embedding, 33, 32), 0L, (s, x) -> s * 2 + CASE WHEN x > 0 THEN 1 ELSE 0 END) AS hi FROM embeddings)",
        "c AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (32 - i)) ELSE 0::BIGINT END))::BIGINT AS lo, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + 32] > 0 THEN (1::BIGINT << (32 - i)) ELSE 0::BIGINT END))::BIGINT AS hi FROM embeddings)")
HAM = " SELECT a.vec_id AS q, min(BITX) AS dist FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id"
sql("hamming_nearest", "WITH " + CODE[0] + HAM.replace("BITX", "bit_count(a.lo ^ b.lo) + bit_count(a.hi ^ b.hi)"), "WITH " + CODE[1] + HAM.replace("min(BITX)", "CAST(min(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi))) AS INT)"))


@book.plan("knn_pq")
def knn_pq(spark, sf_dir):
    """Approximate neighbours by product quantisation: k-means codes of eight parts, table look-ups to rank."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("vec_id is not null")
    # the code books are fit on a bounded sample of 2,000 vectors, every vector is coded
    sample = np.array([r[0] for r in e.orderBy(F.xxhash64("vec_id")).limit(2000).select("embedding").collect()], dtype=float)
    parts, size = 8, sample.shape[1] // 8
    books = []
    rng = np.random.default_rng(3)
    for p in range(parts):
        x = sample[:, p * size : (p + 1) * size]
        c = x[rng.choice(len(x), min(32, len(x)), replace=False)]
        for _ in range(10):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
        books.append(c)

    def encode(frames):
        for f in frames:
            x = np.array(f["embedding"].tolist(), dtype=float)
            codes = [((x[:, None, p * size : (p + 1) * size] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)]
            yield pd.DataFrame({"vec_id": f["vec_id"], "code": list(np.stack(codes, 1).astype("int16"))})

    coded = e.mapInPandas(encode, "vec_id long, code array<short>")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    base = coded.select("vec_id", "code", none("array<float>", "embedding"))
    asked = e.where(ASKED).select("vec_id", none("array<short>", "code"), F.col("embedding").cast("array<float>"))

    def build(batch):
        return batch.column("vec_id").to_numpy(), batch.column("code").flatten().to_numpy().reshape(-1, parts)

    def search(base, queries):
        ids, code = base
        q_ids, (_, x) = queries.column("vec_id").to_numpy(), next(iter(rows_of(queries)[1].values()))
        for lo in range(0, len(x), 64):
            q = x[lo : lo + 64].astype(float)
            look = [((q[:, None, p * size : (p + 1) * size] - books[p][None]) ** 2).sum(2) for p in range(parts)]
            dist = sum(look[p][:, code[:, p]] for p in range(parts))
            for r, row in enumerate(dist):
                row = np.where(ids == q_ids[lo + r], np.inf, row)
                near = np.flatnonzero(row <= np.partition(row, min(4, len(row) - 1))[min(4, len(row) - 1)])
                near = near[np.lexsort((ids[near], row[near]))][:5]
                near = near[ids[near] != q_ids[lo + r]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q_ids[lo + r])), pa.array(ids[near]), pa.array(row[near])], names=["q", "n", "dist"])

    found = deal(base, asked).mapInArrow(meet(build, search), "q long, n long, dist double")
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("dist", "n"))).where("r <= 5").drop("r")


# Bloom filters and prefix indexes
RES = ("CAST(conv(substring(sha2(CAST({} AS STRING), 256), 1, 15), 16, 10) AS BIGINT) % 17117", "('0x' || substring(sha256(CAST({} AS VARCHAR)), 1, 15))::BIGINT % 17117")
POS = "(SELECT k, i, ((79 * x + 23) % 17117 + (i + 1) * ((73 * x + 61) % 17117)) % 17117 AS p FROM (SELECT k, RES AS x FROM (SELECT DISTINCT user_id AS k FROM events) u) y CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n)"
for _name, _text in {
    "bloom_positions": "SELECT k, i, p FROM POS t",
    "bloom_member": "SELECT t.k, count(*) = 5 AS maybe FROM POS t JOIN (SELECT DISTINCT p FROM POS s WHERE k % 2 = 0) f ON t.p = f.p GROUP BY t.k",
    "counting_bloom": "SELECT p, CAST(sum(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM POS t GROUP BY p HAVING sum(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END) > 0",
}.items():
    sql(_name, _text.replace("POS", POS).replace("RES", RES[0].format("k")), _text.replace("POS", POS).replace("RES", RES[1].format("k")))
sql("autocomplete_topk", "SELECT prefix, p_name, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, p_name) AS r FROM (SELECT p_name, n, explode(transform(filter(sequence(1, greatest(length(p_name), 1)), i -> i <= length(p_name)), i -> substring(p_name, 1, i))) AS prefix FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) c) x) y WHERE r <= 10",
    "SELECT prefix, p_name, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, p_name) AS r FROM (SELECT p_name, n, unnest(list_transform(range(1, length(p_name) + 1), lambda i: substring(p_name, 1, i))) AS prefix FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) c) x) y WHERE r <= 10")
sql("prefix_suffix_filter", "SELECT max(CASE WHEN p_name LIKE 'l%' AND p_name LIKE '%t' THEN p_partkey ELSE -1 END) AS best FROM part")

# HTML and pages
sql("html_paragraphs", r"SELECT page_id, i, trim(regexp_replace(p, '<[^>]*>', '')) AS txt FROM (SELECT page_id, posexplode(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS (i, p) FROM pages) t", r"SELECT page_id, i, trim(regexp_replace(p, '<[^>]*>', '', 'g'), ' ') AS txt FROM (SELECT page_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages) z) t")
LINKS = (r"(SELECT page_id, explode(regexp_extract_all(html, '<a [^>]*href=\"(/[^/:.\"]+)\"', 1)) AS link FROM pages)", r"""(SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^/:."]+)"', 1)) AS link FROM pages)""")
sql("html_links", f"SELECT page_id, link, count(*) AS n FROM {LINKS[0]} t GROUP BY page_id, link", f"SELECT page_id, link, count(*) AS n FROM {LINKS[1]} t GROUP BY page_id, link")
sql("html_fields", r"SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'NA') AS title, coalesce(nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), ''), 'NA') AS lang, coalesce(nullif(regexp_extract(html, 'price=\"([0-9.]+)\"', 1), ''), 'NA') AS price FROM pages",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'NA') AS title, coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), 'NA') AS lang, coalesce(nullif(regexp_extract(html, 'price="([0-9.]+)"', 1), ''), 'NA') AS price FROM pages""")
# links of all pages to what has not been fetched, the most wanted first
FRONT = "l AS (SELECT DISTINCT page_id, link FROM LINKS t), seen AS (SELECT DISTINCT regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS link FROM pages), next AS (SELECT l.link, count(*) AS score, 1 AS level FROM l WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.link = l.link) GROUP BY l.link) SELECT link, score, level FROM next ORDER BY score DESC, link LIMIT 50"
sql("crawl_frontier", "WITH " + FRONT.replace("LINKS", LINKS[0]), "WITH " + FRONT.replace("LINKS", LINKS[1]))


@book.plan("html_to_text")
def html_to_text(spark, sf_dir):
    """All data nodes of a page joined by blanks, by the standard library's parser."""
    from html.parser import HTMLParser

    import pandas as pd

    def text(html: str) -> str:
        found: list[str] = []
        parser = HTMLParser()
        parser.handle_data = found.append
        parser.feed(html or "")
        return " ".join(x.strip() for x in found if x.strip())

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "txt": f["html"].map(text)})

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, txt string")


@book.plan("dict_tagging")
def dict_tagging(spark, sf_dir):
    """Leftmost longest dictionary matches in token sequences, as spans."""
    import pandas as pd

    phrases = frozenset(tuple(x.split()) for x in ("the of", "of the", "and the", "in the and"))
    longest, first = max(map(len, phrases)), {p[0] for p in phrases}
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))

    def run(frames):
        for f in frames:
            out = []
            for d, w in zip(f["doc_id"], f["w"]):
                i = 0
                w = w.tolist()
                while i < len(w):
                    if w[i] not in first:
                        i += 1
                        continue
                    n = next((n for n in range(longest, 0, -1) if tuple(w[i : i + n]) in phrases), 0)
                    if n:
                        out.append((d, i, i + n, " ".join(w[i : i + n])))
                    i += n or 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "phrase"])

    return docs.mapInPandas(run, "doc_id long, start long, stop long, phrase string")
