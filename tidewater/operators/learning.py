"""Statistical learning as aggregates, or by pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.operators.graphs import checkpoint_dir
from tidewater.operators.neighbours import meet
from tidewater.operators.sharing import within
from tidewater.plans.query import Book, table

book = Book()
sql = book.sql

TOK = ("(SELECT doc_id, w FROM documents LATERAL VIEW explode(regexp_extract_all(lower(text), '[a-z]+', 0)) e AS w)", "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")


def both(name: str, text: str) -> None:
    sql(name, text.replace("TOK", TOK[0]), text.replace("TOK", TOK[1]))


both("tfidf", """WITH c AS (SELECT doc_id, w, count(*) AS tf FROM TOK t GROUP BY doc_id, w), d AS (SELECT w, count(*) AS df FROM c GROUP BY w), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT c.doc_id, c.w, c.tf * (ln((1.0e0 + n) / (1.0e0 + df)) + 1) AS x FROM c JOIN d ON c.w = d.w CROSS JOIN n)
SELECT doc_id, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS tfidf FROM s""")
NB = """WITH c AS (SELECT l.quality AS y, t.w, count(*) AS n FROM TOK t JOIN labels l ON t.doc_id = l.doc_id GROUP BY l.quality, t.w), v AS (SELECT DISTINCT w FROM c), k AS (SELECT y, sum(n) AS total FROM c GROUP BY y), vs AS (SELECT count(*) AS size FROM v),
p AS (SELECT k.y, v.w, ln((coalesce(c.n, 0) + 1.0e0) / (k.total + vs.size)) AS lp FROM k CROSS JOIN v CROSS JOIN vs LEFT JOIN c ON c.y = k.y AND c.w = v.w), """
both("nb_train", NB.rstrip(", \n") + " SELECT y, w, round(lp, 9) AS lp FROM p")
both("nb_predict", NB + """pr AS (SELECT quality AS y, ln(count(*) * 1.0e0 / sum(count(*)) OVER ()) AS prior FROM labels GROUP BY quality),
s AS (SELECT t.doc_id, p.y, sum(p.lp) + max(pr.prior) AS score FROM TOK t JOIN p ON p.w = t.w JOIN pr ON pr.y = p.y GROUP BY t.doc_id, p.y)
SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, y) AS r FROM s) x WHERE r = 1""")
both("nb_em", NB + """s AS (SELECT t.doc_id, p.y, sum(p.lp) AS score FROM TOK t JOIN p ON p.w = t.w GROUP BY t.doc_id, p.y), m AS (SELECT doc_id, y, score - max(score) OVER (PARTITION BY doc_id) AS z FROM s),
q AS (SELECT doc_id, y, exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id) AS r FROM m)
SELECT y, round(sum(r), 4) AS mass, count(*) AS docs FROM q WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = q.doc_id) GROUP BY y""")
sql("adaboost_round", """WITH d AS (SELECT l.doc_id, l.quality AS y, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS p, 1.0e0 / count(*) OVER () AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id), e AS (SELECT sum(CASE WHEN y <> p THEN w ELSE 0 END) AS err FROM d), a AS (SELECT ln((1 - err) / err) AS alpha FROM e),
u AS (SELECT doc_id, w * CASE WHEN y <> p THEN exp(alpha) ELSE 1 END AS w FROM d CROSS JOIN a) SELECT doc_id, round(w / sum(w) OVER (), 9) AS w FROM u""")
CF = """WITH r AS (SELECT o.o_custkey AS u, l.l_partkey AS i, avg(l.l_quantity) AS q FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_partkey),
s AS (SELECT a.u AS u1, b.u AS u2, 1 - tanh(sqrt(2 * avg((a.q - b.q) * (a.q - b.q)))) AS sim FROM r a JOIN r b ON a.i = b.i AND a.u <> b.u GROUP BY a.u, b.u), t AS (SELECT u1, sum(sim) AS total FROM s GROUP BY u1),
p AS (SELECT s.u1 AS u, r.i, sum(s.sim * r.q) AS x FROM s JOIN r ON r.u = s.u2 GROUP BY s.u1, r.i) SELECT p.u, p.i, round(CASE WHEN t.total > 1e-6 THEN p.x / t.total END, 6) AS predicted FROM p JOIN t ON t.u1 = p.u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = p.u AND r.i = p.i)"""


#: Users of a block whose predictions are made in one task.
BLOCK_USERS = 1024


class _Ratings:
    """The ratings of a block's neighbours: a user's items and quantities lie together."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("items")
        self.users, self.starts = batch.column("vec_id").to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        items = lists.flatten().dictionary_encode(null_encoding="encode")
        self.code, self.items = items.indices.to_numpy(), items.dictionary
        q = batch.column("qs").flatten()
        self.known, self.q = np.asarray(q.is_valid()), q.fill_null(0.0).to_numpy()


def _predict(base: _Ratings, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Sums of similarity times quantity over a user's neighbours, by item, and the sum of the similarities."""
    for r in range(len(queries)):
        sims = queries.column("sims")[r].values
        sure, sim = np.asarray(sims.is_valid()), sims.fill_null(0.0).to_numpy()
        at = np.searchsorted(base.users, queries.column("others")[r].values.to_numpy())
        n = base.starts[at + 1] - base.starts[at]
        every = np.repeat(base.starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        code, known = base.code[every], base.known[every] & np.repeat(sure, n)
        seen = np.bincount(code, minlength=len(base.items))
        terms = np.bincount(code[known], minlength=len(base.items))
        x = np.bincount(code, np.where(known, np.repeat(sim, n) * base.q[every], 0.0), len(base.items))
        own = pc.index_in(queries.column("items")[r].values.drop_null(), value_set=base.items).drop_null().to_numpy()
        seen[own] = 0
        items = np.flatnonzero(seen)
        total = pa.array([float(sim.sum()) if sure.any() else None], pa.float64())
        for lo in range(0, len(items), 250_000):
            i = items[lo : lo + 250_000]
            user = pa.array(np.full(len(i), queries.column("vec_id")[r].as_py()))
            yield pa.RecordBatch.from_arrays([user, base.items.take(pa.array(i)), pa.array(x[i], mask=terms[i] == 0), total.take(pa.array(np.zeros(len(i), int)))], names=["u", "i", "x", "total"])


@book.plan("cf_predict", CF)
def cf_predict(spark, sf_dir):
    """Similar users' quantities, weighted by similarity, of the parts that a user has not bought.

    The products of similarities and ratings are summed where they are made: a task has a range of
    users and the ratings of their neighbours.
    """
    checkpoint_dir(spark)
    r = ratings(spark, sf_dir).where("u is not null").checkpoint()
    near = within(r, ["i"], F.col("x.u") < F.col("y.u")).select(F.col("x.u").alias("u1"), F.col("y.u").alias("u2"), ((F.col("x.q") - F.col("y.q")) * (F.col("x.q") - F.col("y.q"))).alias("d"))
    near = near.groupBy("u1", "u2").agg((1 - F.tanh(F.sqrt(2 * F.avg("d")))).alias("sim"))
    both = near.select(F.explode(F.expr("array(named_struct('u', u1, 'other', u2, 'sim', sim), named_struct('u', u2, 'other', u1, 'sim', sim))")).alias("s")).select("s.*")
    s = both.groupBy("u").agg(F.collect_list(F.struct("other", "sim")).alias("s")).select("u", F.col("s.other").alias("others"), F.col("s.sim").alias("sims")).checkpoint()
    n, lo, hi = r.agg(F.count_distinct("u"), F.min("u"), F.max("u")).first()
    wide = max(1, ((hi or 0) - (lo or 0) + 1) * BLOCK_USERS // max(1, n))
    at = F.floor((F.col("u") - F.lit(lo or 0)) / wide).cast("string")
    users = r.groupBy("u").agg(F.collect_list(F.struct("i", "q")).alias("l")).select(F.col("u").alias("vec_id"), F.col("l.i").alias("items"), F.col("l.q").alias("qs"))
    needed = s.select(at.alias("at"), F.explode("others").alias("vec_id")).distinct().join(users, "vec_id").withColumn("kind", F.lit(0))
    asked = s.withColumn("at", at).withColumnRenamed("u", "vec_id").join(users.select("vec_id", "items"), "vec_id").withColumn("kind", F.lit(1))
    stream = needed.unionByName(asked, allowMissingColumns=True).repartition(min(4000, 4 * (n // BLOCK_USERS + 1)), "at").sortWithinPartitions("at", "kind", "vec_id")
    item = r.schema["i"].dataType.simpleString()
    found = stream.mapInArrow(meet(_Ratings, _predict), f"u long, i {item}, x double, total double")
    return found.select("u", "i", F.round(F.when(F.col("total") > 1e-6, F.col("x") / F.col("total")), 6).alias("predicted"))


def ratings(spark, sf_dir):
    """(u, i, q): a customer's mean quantity of a part."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.avg("l_quantity").alias("q"))


KM = """, c AS (SELECT label AS k, e FROM (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v) x WHERE r = 1), d AS (SELECT a.vec_id, b.k, round(DIST, 6) AS dist FROM v a CROSS JOIN c b) SELECT vec_id, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS r FROM d) y WHERE r = 1"""
sql("kmeans_assign", "WITH v AS (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings)" + KM.replace("DIST", "sqrt(aggregate(zip_with(a.e, b.e, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)" + KM.replace("DIST", "list_distance(a.e, b.e)"))
sql("two_view_max", "SELECT doc_id, CASE WHEN greatest(p0, q0) > greatest(p1, q1) THEN 0 ELSE 1 END AS label FROM (SELECT doc_id, n_chars / (n_chars + 500.0e0) AS p1, 500 / (n_chars + 500.0e0) AS p0, (doc_id % 10) / 10.0e0 AS q1, 1 - (doc_id % 10) / 10.0e0 AS q0 FROM documents) t")
DAILY = "(SELECT CAST(ts AS DATE) AS d, round(sum(value), 6) AS y FROM events GROUP BY CAST(ts AS DATE))"
sql("acf", f"WITH t AS (SELECT row_number() OVER (ORDER BY d) AS i, y - avg(y) OVER () AS z FROM {DAILY} x), v AS (SELECT sum(z * z) AS v FROM t) SELECT b.i - a.i AS lag_, round(sum(a.z * b.z) / max(v.v), 9) AS acf FROM t a JOIN t b ON b.i - a.i BETWEEN 0 AND 7 CROSS JOIN v GROUP BY b.i - a.i")
sql("iqr_fence", "WITH q AS (SELECT percentile(value, 0.1) AS lo, percentile(value, 0.9) AS hi FROM events) SELECT event_id, value FROM events CROSS JOIN q WHERE value < lo - 0.1 * (hi - lo) OR value > hi + 0.1 * (hi - lo)", "WITH q AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events) SELECT event_id, value FROM events CROSS JOIN q WHERE value < lo - 0.1 * (hi - lo) OR value > hi + 0.1 * (hi - lo)")
SEQ = "(SELECT user_id, event_id, event_type AS t, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
sql("backoff_tagger", f"""WITH s AS {SEQ}, tri AS (SELECT a, b, t FROM (SELECT a, b, t, row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, t) AS r FROM s WHERE b IS NOT NULL GROUP BY a, b, t) x WHERE r = 1), bi AS (SELECT a, t FROM (SELECT a, t, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, t) AS r FROM s WHERE a IS NOT NULL GROUP BY a, t) x WHERE r = 1)
SELECT s.event_id, coalesce(tri.t, bi.t, 'view') AS predicted FROM s LEFT JOIN tri ON s.a = tri.a AND s.b = tri.b LEFT JOIN bi ON s.a = bi.a""")
DIMS = ("(SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x)", "(SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
sql("weighted_doc_vector", f"SELECT label, pos, round(CASE WHEN sum(vec_id % 7) = 0 THEN 0 ELSE sum(x * (vec_id % 7)) / sum(vec_id % 7) END, 7) AS v FROM {DIMS[0]} t GROUP BY label, pos", f"SELECT label, pos, round(CASE WHEN sum(vec_id % 7) = 0 THEN 0 ELSE sum(x * (vec_id % 7)) / sum(vec_id % 7) END, 7) AS v FROM {DIMS[1]} t GROUP BY label, pos")
sql("training_pairs", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % 20 = 0) SELECT a, b, same FROM (SELECT *, row_number() OVER (PARTITION BY a, same ORDER BY b DESC) AS r FROM p) x WHERE r <= 3")


def _features(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@book.plan("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=10, seed=1, maxIter=5).fit(_features(spark, sf_dir)).transform(_features(spark, sf_dir)).select("vec_id", "prediction")


@book.plan("logistic_l1")
def logistic_l1(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression

    x = _features(spark, sf_dir)
    return LogisticRegression(elasticNetParam=1.0, regParam=0.01, maxIter=10).fit(x).transform(x).select("vec_id", "prediction")


@book.plan("als_ratings")
def als_ratings(spark, sf_dir):
    from pyspark.ml.recommendation import ALS

    r = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    r = r.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.avg("l_quantity").alias("rating"))
    return ALS(rank=4, maxIter=3, seed=1).fit(r).transform(r).select("user", "item", "prediction")


@book.plan("pca_2")
def pca_2(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    x = _features(spark, sf_dir)
    return PCA(k=2, inputCol="features", outputCol="p").fit(x).transform(x).select("vec_id", vector_to_array("p").alias("p"))


@book.plan("word2vec")
def word2vec(spark, sf_dir):
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    w = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return Word2Vec(vectorSize=8, minCount=1, seed=1, inputCol="w", outputCol="v").fit(w).getVectors().select("word", vector_to_array("vector").alias("v"))


@book.plan("lda_topics")
def lda_topics(spark, sf_dir):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    w = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    x = CountVectorizer(inputCol="w", outputCol="features").fit(w).transform(w)
    return LDA(k=3, maxIter=3, seed=1).fit(x).transform(x).select("p_partkey", vector_to_array("topicDistribution").alias("t"))


@book.plan("tree_ensemble")
def tree_ensemble(spark, sf_dir):
    from pyspark.ml.classification import RandomForestClassifier

    x = _features(spark, sf_dir)
    return RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(x).transform(x).select("vec_id", "prediction")


@book.plan("fm_regression")
def fm_regression(spark, sf_dir):
    from pyspark.ml.regression import FMRegressor

    x = _features(spark, sf_dir)
    return FMRegressor(factorSize=2, maxIter=5, seed=1).fit(x).transform(x).select("vec_id", "prediction")


@book.plan("user_regression")
def user_regression(spark, sf_dir):
    """A least-squares line per part: quantity by discount."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_discount").alias("x"), F.col("l_quantity").alias("y"))
    of_part = W.partitionBy("l_partkey")
    t = t.withColumn("mx", F.avg("x").over(of_part)).withColumn("my", F.avg("y").over(of_part))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = t.groupBy("l_partkey").agg(total(dx * dy).alias("xy"), total(dx * dx).alias("xx"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    slope = F.col("xy") / F.greatest(F.lit(1e-12), F.col("xx"))
    return sums.select("l_partkey", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


@book.plan("viterbi")
def viterbi(spark, sf_dir):
    """Most likely two-state path (slow or busy) behind each user's event gaps."""
    import numpy as np

    t = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"))

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        gap = np.diff(pdf["t"].to_numpy(), prepend=pdf["t"].iloc[0]) < 86_400
        emit = np.log(np.where(gap[:, None], [[0.2, 0.8]], [[0.8, 0.2]]))
        step = np.log([[0.7, 0.3], [0.3, 0.7]])
        best, back = emit[0] + np.log(0.5), []
        for e in emit[1:]:
            total = best[:, None] + step
            back.append(total.argmax(0))
            best = total.max(0) + e
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        return pd.DataFrame({"event_id": pdf["event_id"], "state": state[::-1]})

    return t.groupBy("user_id").applyInPandas(path, "event_id long, state int")


@book.plan("laplacian_rls")
def laplacian_rls(spark, sf_dir):
    """Closed-form Laplacian-regularised least squares over all vectors, every label known on even ids.

    Vectors are dealt to blocks by the hash of their id, and each block of 400 at most is solved on its
    own; a block without labels scores 0.
    """
    import numpy as np

    most = 400
    e = table(spark, sf_dir, "embeddings")
    n_rows = e.count()
    # blocks are dealt a fifth short, as their sizes vary
    blocks = 1 if n_rows <= most else -(-n_rows * 5 // (most * 4))
    e = e.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["embedding"].tolist(), dtype=float)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        k = np.exp(-d / (d.mean() or 1.0))
        a = np.where(np.argsort(np.argsort(d, axis=1), axis=1) <= 5, k, 0)
        a = np.maximum(a, a.T)
        lap = np.diag(a.sum(1)) - a
        known = (pdf["vec_id"] % 2 == 0).to_numpy().astype(float)
        y = np.where(pdf["label"] >= 5, 1.0, -1.0) * known
        n, labelled = len(x), known.sum()
        if not labelled:
            return pd.DataFrame({"vec_id": pdf["vec_id"], "score": np.zeros(n)})
        alpha = np.linalg.solve(known[:, None] * k + 0.01 * labelled * np.eye(n) + 0.01 * labelled / n**2 * lap @ k, y)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "score": k @ alpha})

    def solve_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "label"])
        return pd.concat([solve(pdf.iloc[at]) for at in np.array_split(np.arange(len(pdf)), -(-len(pdf) // most))])

    return e.groupBy("block").applyInPandas(solve_all, "vec_id long, score double")
