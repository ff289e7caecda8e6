"""Queries over embeddings and labels: search, graphs, PageRank, hashing, classification, latent vectors, clusters, reports.

Searches take as queries every vector whose id is divisible by 20, against all vectors. Training rows are those whose id ends
in 0, 1 or 2, which stands for a 30 % sample that SQL can name as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, cluster, graph, lsh, report, retrieval_session, similarity
from ..operators import feedback as fb
from ..operators.latent import Technique, latent, sim_rows, topic_terms
from ..plans.stages import cut

K, ROUNDS = 10, 25
PLANES, WIDE = lsh.planes(64, 8, 4), lsh.planes(64, 8, 24)
CENTRES = 8
SESSION_SEED = 1  # the first round of a session shows its nearest neighbours


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def kept(c: str) -> Column:
    """A score that its operator has rounded already; rounding it once more could meet exact halves."""
    return (F.col(c) + F.lit(0.0)).alias(c)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, vec, class"""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), long("label").alias("class"))


def _asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 20 == 0)


def _train(c: Column) -> Column:
    return c % 10 < 3


def _shown(top: DataFrame) -> DataFrame:
    return top.select("query_id", "object_id", kept("score"), long("rank").alias("rank"))


def _cosines(spark, d) -> DataFrame:
    return similarity.matrix(_vectors(spark, d), "cosine").withColumn("score", F.round("score", 9))


def _near_cosines(spark, d, least: float) -> DataFrame:
    """The cosines of at least `least`, and of each vector with itself."""
    return similarity.matrix(_vectors(spark, d), "cosine", least=least).withColumn("score", F.round("score", 9))


def _edges(spark, d) -> DataFrame:
    """Nearest-neighbour edges without a node's edge to itself, normalised by column; written down, since PageRank reads them often."""
    return cut(graph.column_normalised(graph.nearest_edges(_vectors(spark, d), K, exclude_self=True)))


# ---- search and matrices ----


def latent_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return _shown(similarity.top_k(_asked(v), v, "cosine", K))


def dot_matrix_scaled(spark, d):
    return similarity.scaled_matrix(_vectors(spark, d), "dot", 6)


def cosine_matrix(spark, d):
    return similarity.matrix(_vectors(spark, d), "cosine", finish=lambda s: similarity.half_up(similarity.to_unit(s), 6))


def mahalanobis_topk(spark, d):
    v = _vectors(spark, d).select("id", "vec")
    white = similarity.whitened(v)
    return _shown(similarity.top_k(_asked(white), white, "euclidean", K, exclude_self=True))


def knn_retrieve(spark, d):
    v = _vectors(spark, d)
    return _shown(similarity.top_k(_asked(v), v, "euclidean", K, exclude_self=True))


# ---- graphs ----


def knn_graph(spark, d):
    return graph.nearest_edges(_vectors(spark, d), K).select("src", "dst", kept("w"))


def knn_graph_compat(spark, d):
    return graph.place_edges(_vectors(spark, d), K).select("src", "dst", kept("w"))


def graph_normalise(spark, d):
    return graph.column_normalised(cut(graph.nearest_edges(_vectors(spark, d), K, exclude_self=True))).select("src", "dst", r6("w").alias("w"))


def _ranked_nodes(scores: DataFrame, k: int) -> DataFrame:
    named = scores.select(F.col("run").alias("query_id"), F.col("node").alias("object_id"), F.round("score", 8).alias("score"))
    return similarity.ranked(named, k, False).select("query_id", "object_id", kept("score"), long("rank").alias("rank"))


def ppr_topm(spark, d):
    """Nearest nodes of each query's seeds, itself and the node after it."""
    v = _vectors(spark, d)
    seeds = _asked(v).select(F.col("id").alias("run"), F.explode(F.array("id", F.col("id") + 1)).alias("node"))
    seeds = seeds.join(v.select(F.col("id").alias("node")), "node", "left_semi").select("run", "node")
    return _ranked_nodes(graph.pagerank(_edges(spark, d), graph.uniform_seeds(seeds), 0.65, ROUNDS, k=K), K)


def _class_seeds(v: DataFrame) -> DataFrame:
    return graph.uniform_seeds(v.where(_train(F.col("id"))).select(F.col("class").alias("run"), F.col("id").alias("node")))


def ppr_classify(spark, d):
    """The class whose PageRank from its training members is largest at each other node."""
    v = _vectors(spark, d)
    scores = graph.pagerank(_edges(spark, d), _class_seeds(v), 0.375, 2 * ROUNDS)
    votes = scores.select(F.col("node").alias("query_id"), F.col("run").alias("class"), F.round("score", 9).alias("score"))
    return classify.weighted_majority(votes.where((F.col("score") > 0) & ~_train(F.col("query_id")))).select("query_id", "predicted")


def _neighbour_votes(spark, d) -> DataFrame:
    """The ten training nodes with the largest PageRank from each other node: query_id, class, score (as exact as votes need)."""
    v = _vectors(spark, d)
    seeds = graph.uniform_seeds(v.where(~_train(F.col("id"))).select(F.col("id").alias("run"), F.col("id").alias("node")))
    trained = v.where(_train(F.col("id"))).select(F.col("id").alias("node"), "class")
    scores = graph.pagerank(_edges(spark, d), seeds, 0.65, ROUNDS, k=K, among=trained, votes=True)
    named = scores.join(trained, "node").select(F.col("run").alias("query_id"), F.col("node").alias("object_id"), "class", F.round("score", 8).alias("score"))
    return similarity.ranked(named.where("score > 0"), K, False)


def ppr_vote(spark, d):
    votes = cut(_neighbour_votes(spark, d))
    both = classify.majority(votes).withColumnRenamed("predicted", "voting").join(classify.weighted_majority(votes).withColumnRenamed("predicted", "weighted"), "query_id")
    return both.select("query_id", "voting", "weighted")


def ppr_reseed(spark, d):
    """Two rounds: the nodes of the query's class among the first results become seeds of the second."""
    v = _vectors(spark, d)
    edges = _edges(spark, d)
    own = _asked(v).select(F.col("id").alias("run"), F.col("id").alias("node"))
    first = _ranked_nodes(graph.pagerank(edges, graph.uniform_seeds(own), 0.8, ROUNDS, k=K), K)
    found = first.select(F.col("query_id").alias("run"), F.col("object_id").alias("node"))
    wanted = v.select(F.col("id").alias("run"), F.col("class").alias("wanted"))
    relevant = found.join(wanted, "run").join(v.select(F.col("id").alias("node"), "class"), "node").where("class = wanted").select("run", "node")
    seeds = cut(own.union(relevant).distinct())
    return _ranked_nodes(graph.pagerank(edges, graph.uniform_seeds(seeds), 0.8, ROUNDS, k=K), K)


# ---- hashing ----


def lsh_codes(spark, d):
    return lsh.codes(_vectors(spark, d), PLANES).select("object_id", long("table_id").alias("table_id"), "code")


def lsh_buckets(spark, d):
    return lsh.buckets(lsh.codes(_vectors(spark, d), PLANES)).select(long("table_id").alias("table_id"), "code", "n", "first", "last")


def lsh_multiprobe(spark, d):
    coded = cut(lsh.packed(_vectors(spark, d), PLANES))
    return lsh.within(_asked(coded), coded, 8, 50).select("query_id", "object_id", long("level").alias("level"))


def lsh_rerank(spark, d):
    coded = cut(lsh.packed(_vectors(spark, d), PLANES))
    out = lsh.search(_asked(coded), coded, 8, 50, K)
    return out.select("query_id", "object_id", kept("score"), long("rank").alias("rank"), "n_candidates")


def lsh_search(spark, d):
    """The ten nearest of the objects within one bit of the query's code in any of 24 tables: recall@10 of 0.93 and more."""
    coded = cut(lsh.packed(_vectors(spark, d), WIDE))
    return _shown(lsh.search(_asked(coded), coded, 2, None, K))


# ---- classification ----


def knn_classify_tiebreak(spark, d):
    v = _vectors(spark, d)
    out = classify.knn_classes(v.where(~_train(F.col("id"))), v.where(_train(F.col("id"))), 5)
    return out.select("query_id", "predicted", long("k_used").alias("k_used"))


def accuracy_report(spark, d):
    """Accuracy of the two PageRank votes and the neighbours' vote."""
    labels = _vectors(spark, d).select(F.col("id").alias("object_id"), "class")
    both = cut(ppr_vote(spark, d))
    predicted = {"voting": both.select("query_id", F.col("voting").alias("predicted")), "weighted": both.select("query_id", F.col("weighted").alias("predicted")), "knn": knn_classify_tiebreak(spark, d)}
    out = None
    for name, p in predicted.items():
        one = classify.accuracy(p, labels).select(F.lit(name).alias("method"), "n", r6("accuracy").alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def cart_best_split(spark, d):
    rows = _vectors(spark, d).where(_train(F.col("id"))).select("class", F.posexplode("vec").alias("feature", "value"))
    return classify.best_splits(rows, []).select(long("feature").alias("feature"), r6("threshold").alias("threshold"), kept("gini"))


def cart_predict(spark, d):
    v = _vectors(spark, d)
    return classify.cart(v.where(_train(F.col("id"))), v.where(~_train(F.col("id"))))


def train_anti_join(spark, d):
    v = _vectors(spark, d)
    trained = v.where(_train(F.col("id"))).select("id")
    return v.join(trained, "id", "left_anti").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def label_from_parent(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    objects = docs.select(F.concat_ws("_", "doc_id", "source").alias("object_id"))
    return report.labelled(objects, labels.select(F.col("doc_id").alias("parent"), long("quality").alias("class")))


# ---- clusters ----


def _laplacian(spark, d, normalised: bool) -> DataFrame:
    edges = cut(cluster.adjacency(_near_cosines(spark, d, 0.5), 0.5))
    return cluster.laplacian(edges, normalised).select("i", "j", (F.round("l", 9) + F.lit(0.0)).alias("l"))


def laplacian_unnorm(spark, d):
    return _laplacian(spark, d, False)


def laplacian_norm(spark, d):
    return _laplacian(spark, d, True)


def kmeans_fixed(spark, d):
    """Three rounds from the vectors with the smallest ids."""
    v = _vectors(spark, d)
    centres = [r.vec for r in v.orderBy("id").limit(CENTRES).collect()]
    return cluster.kmeans_from(v, centres, 3).select("object_id", long("cluster").alias("cluster"))


def kmeans(spark, d):
    return cluster.kmeans(_vectors(spark, d), CENTRES)


def spectral(spark, d):
    """Clusters for each threshold and both Laplacians."""
    sim = cut(_near_cosines(spark, d, 0.5))
    out = None
    for least in (0.7, 0.6, 0.5):
        for normalised in (False, True):
            one = cluster.spectral(sim, CENTRES, least, normalised).select(F.lit(least).alias("least"), F.lit(normalised).alias("normalised"), "object_id", "cluster")
            out = one if out is None else out.unionByName(one)
    return out


def latent_partition(spark, d):
    v = _vectors(spark, d).select("id", "vec")
    scaled = cluster.latent_clusters(v, True).withColumnRenamed("cluster", "scaled")
    plain = cluster.latent_clusters(v, False).withColumnRenamed("cluster", "plain")
    return scaled.join(plain, "object_id").select("object_id", long("scaled").alias("scaled"), long("plain").alias("plain"))


# ---- latent vectors: no SQL for iterative fits; tests hold them against numpy ----


def latent_partition_svd(spark, d):
    """The partition by the largest of four SVD values, scaled by column; of NMF values as they are."""
    scaled = cluster.latent_clusters(_latent(spark, d, Technique.SVD).withColumnRenamed("object_id", "id"), True).withColumnRenamed("cluster", "svd")
    plain = cluster.latent_clusters(_latent(spark, d, Technique.NMF).withColumnRenamed("object_id", "id"), False).withColumnRenamed("cluster", "nmf")
    return scaled.join(plain, "object_id").select("object_id", long("svd").alias("svd"), long("nmf").alias("nmf"))


def latent_search_svd(spark, d):
    """Cosine search among the SVD values."""
    held = cut(_latent(spark, d, Technique.SVD).withColumnRenamed("object_id", "id"))
    return _shown(similarity.top_k(_asked(held), held, "cosine", K))


def _latent(spark, d, technique: Technique) -> DataFrame:
    v = _vectors(spark, d).select("id", "vec")
    if technique in (Technique.NMF, Technique.LDA):
        v = v.select("id", F.transform("vec", lambda x: F.abs(x)).alias("vec"))
    return latent(v, technique)[0].select(F.col("id").alias("object_id"), "vec")


def pca_latent(spark, d):
    return _latent(spark, d, Technique.PCA)


def svd_latent(spark, d):
    return _latent(spark, d, Technique.SVD)


def nmf_latent(spark, d):
    return _latent(spark, d, Technique.NMF)


def lda_latent(spark, d):
    return _latent(spark, d, Technique.LDA)


def zipped_ranks(spark, d):
    """Three rankings side by side, joined on their places."""
    every = _methods(spark, d)
    return report.zipped({name: every.where(F.col("method") == name) for name in ("cosine", "dot", "euclidean")})


def _names(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("dim"), F.concat(F.lit("dim"), F.col("id")).alias("term"))


def topic_terms_svd(spark, d):
    return topic_terms(latent(_vectors(spark, d).select("id", "vec"), Technique.SVD)[1], _names(spark))


def semantic_files(spark, d):
    """Objects ranked in each topic of the similarity matrix."""
    rows = cut(sim_rows(_cosines(spark, d)))
    held = latent(rows, Technique.SVD)[0].select("id", F.posexplode("vec").alias("topic", "score"))
    return similarity.ranked(held.select("topic", F.col("id").alias("object_id"), "score"), K, False, by="topic")


# ---- feedback and reports ----


def _methods(spark, d) -> DataFrame:
    """method, query_id, object_id, rank of three searches."""
    v = _vectors(spark, d)
    one = lambda name, df: df.select(F.lit(name).alias("method"), "query_id", "object_id", long("rank").alias("rank"))
    return cut(one("cosine", latent_cosine_topk(spark, d)).unionByName(one("euclidean", similarity.top_k(_asked(v), v, "euclidean", K))).unionByName(one("dot", similarity.top_k(_asked(v), v, "dot", K))))


def method_pivot_report(spark, d):
    return report.side_by_side(_methods(spark, d), ["cosine", "dot", "euclidean"])


def method_scores(spark, d):
    """Choice scores of the three searches of the smallest query, results of the next query being the round before."""
    every = _methods(spark, d)
    v = _vectors(spark, d)
    relevant = v.where("class = 0").select(F.col("id").alias("object_id"))
    return fb.method_scores(every.where("query_id = 0"), every.where("query_id = 20"), relevant).select("method", F.round("score", 4).alias("score"))


def session_results(spark, d):
    """The eight result sets of a session on the smallest object, after a round in which its class was judged relevant."""
    v = _vectors(spark, d).select("id", "vec", "class")
    first = v.orderBy("id").first()
    classes = lambda ids: {r.id: r["class"] for r in v.where(F.col("id").isin(ids)).select("id", "class").collect()}
    judge = lambda ids: {i: 1 if c == first["class"] else -1 for i, c in classes(ids).items()}
    s = retrieval_session.start(v.select("id", "vec"), first.id, K)
    s, _, _ = retrieval_session.step(s, judge, np.random.default_rng(SESSION_SEED))
    return retrieval_session.results(s).select("method", "query_id", "object_id", kept("score"), long("rank").alias("rank"))


def dominant_report(spark, d):
    top = latent_cosine_topk(spark, d)
    labels = _vectors(spark, d).select(F.col("id").alias("object_id"), "class")
    lines = report.dominant_class(top, labels)
    return lines.select("query_id", "k", "class", "n")


def ranked_lines(spark, d):
    top = latent_cosine_topk(spark, d)
    return top.select("query_id", "rank", report.line(F.col("object_id"), F.col("score").cast("decimal(18,6)")).alias("line"))


# ---- SQL ----

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label::BIGINT AS class FROM embeddings)"
_COS = f"{_V},\ncos AS MATERIALIZED (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS score FROM v a CROSS JOIN v b)"
_EUC = "round(sqrt(list_sum(list_transform(range(1, len(a.vec) + 1), lambda k: (a.vec[k] - b.vec[k]) * (a.vec[k] - b.vec[k])))), 9)"
_TOP = "SELECT query_id, object_id, score + 0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {0}, object_id) AS rank FROM scored) WHERE rank <= 10"
_KNN = """,
knn AS MATERIALIZED (SELECT i AS src, j AS dst, score AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM cos WHERE i <> j) WHERE r <= 10),
edges AS MATERIALIZED (SELECT src, dst, w / (sum(w) OVER (PARTITION BY dst) + 1e-7) AS w FROM knn)"""


def _ppr(name: str, seeds: str, c: float, rounds: int) -> str:
    """CTEs of an unrolled PageRank; seeds(run, node, p)."""
    out = f",\n{name}0 AS MATERIALIZED (SELECT run, node, p AS score FROM {seeds})"
    for k in range(1, rounds + 1):
        out += f""",
{name}{k} AS MATERIALIZED (SELECT run, node, sum(score) AS score FROM (SELECT run, src AS node, {1 - c!r} * w * score AS score FROM {name}{k - 1} JOIN edges ON dst = node
  UNION ALL SELECT run, node, {c!r} * p FROM {seeds}) GROUP BY ALL)"""
    return out


_UNIFORM = ",\n{0} AS MATERIALIZED (SELECT run, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY run) AS p FROM (SELECT DISTINCT run, node FROM ({1})))"
_RANKED = ",\n{0} AS (SELECT * FROM (SELECT run AS query_id, node AS object_id, round(score, 8) AS score, row_number() OVER (PARTITION BY run ORDER BY round(score, 8) DESC, node) AS rank FROM {1}) WHERE rank <= 10)"
_SHOW = "SELECT query_id, object_id, score + 0.0 AS score, rank FROM {0}"

_VOTES = (
    _UNIFORM.format("seeds", "SELECT id AS run, id AS node FROM v WHERE id % 10 >= 3")
    + _ppr("u", "seeds", 0.65, ROUNDS)
    + f""",
votes AS (SELECT * FROM (SELECT run AS query_id, class, round(score, 8) AS score, row_number() OVER (PARTITION BY run ORDER BY round(score, 8) DESC, node) AS r FROM u{ROUNDS} JOIN v ON v.id = node WHERE node % 10 < 3 AND round(score, 8) > 0) WHERE r <= 10),
voting AS (SELECT query_id, class AS voting FROM (SELECT query_id, class, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, class) AS r FROM votes GROUP BY query_id, class) WHERE r = 1),
weighted AS (SELECT query_id, class AS weighted FROM (SELECT query_id, class, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, class) AS r FROM votes GROUP BY query_id, class) WHERE r = 1)"""
)
_NEAR = f"""
dists AS (SELECT a.id AS query_id, b.id AS object_id, b.class, {_EUC} AS score FROM v a CROSS JOIN v b WHERE a.id % 10 >= 3 AND b.id % 10 < 3),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id) AS rank FROM dists) WHERE rank <= 20),
kc AS (SELECT a.query_id, a.rank AS k, b.class, count(*) AS n FROM near a JOIN near b ON a.query_id = b.query_id AND b.rank <= a.rank WHERE a.rank >= 5 GROUP BY ALL),
lead AS (SELECT query_id, k, min(class) AS class, count(*) AS leaders FROM (SELECT *, max(n) OVER (PARTITION BY query_id, k) AS top FROM kc) WHERE n = top GROUP BY ALL),
settled AS (SELECT query_id, min_by(class, k) AS predicted, min(k) AS k_used FROM lead WHERE leaders = 1 GROUP BY query_id),
knnp AS (SELECT near.query_id, coalesce(predicted, class) AS predicted, coalesce(k_used, 1) AS k_used FROM near LEFT JOIN settled ON settled.query_id = near.query_id WHERE rank = 1)"""


def _codes_sql(planes: np.ndarray = PLANES) -> str:
    tables = []
    for t, rows in enumerate(planes):
        bits = " + ".join(f"CASE WHEN list_dot_product(vec, {[float(x) for x in row]!r}::DOUBLE[]) >= 0 THEN {1 << (len(rows) - 1 - k)} ELSE 0 END" for k, row in enumerate(rows))
        tables.append(f"SELECT id AS object_id, {t}::BIGINT AS table_id, ({bits})::BIGINT AS code FROM v")
    return f"{_V},\ncodes AS MATERIALIZED ({' UNION ALL '.join(tables)})"


_PROBE = """,
dist AS (SELECT a.object_id AS query_id, b.object_id, min(bit_count(xor(a.code, b.code))) AS h FROM codes a JOIN codes b USING (table_id) WHERE a.object_id % 20 = 0 AND bit_count(xor(a.code, b.code)) < 8 GROUP BY ALL),
running AS (SELECT query_id, h, sum(count(*)) OVER (PARTITION BY query_id ORDER BY h) AS found FROM dist GROUP BY query_id, h),
lev AS (SELECT query_id, coalesce(min(h) FILTER (found >= 50), 7) AS level FROM running GROUP BY query_id),
cand AS (SELECT dist.query_id, object_id, level::BIGINT AS level FROM dist JOIN lev USING (query_id) WHERE h <= level)"""
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_EVERY_KIND = "(SELECT 'vect' AS kind UNION ALL SELECT 'prob')"


def _session_sql() -> str:
    """One round whose neighbours are judged, both rewritten queries, and four searches with each."""
    cosine = "round(coalesce(list_dot_product(a.q, b.vec) / nullif(sqrt(list_dot_product(a.q, a.q)) * sqrt(list_dot_product(b.vec, b.vec)), 0), 0), 9)"
    edges = _KNN.replace("FROM cos WHERE", "FROM pairs WHERE").replace("PARTITION BY i ", "PARTITION BY kind, i ").replace("PARTITION BY dst", "PARTITION BY kind, dst")
    edges = edges.replace("SELECT i AS src", "SELECT kind, i AS src").replace("SELECT src, dst, w / ", "SELECT kind, src, dst, w / ")
    bits = [" + ".join(f"CASE WHEN list_dot_product(vec, {[float(x) for x in row]!r}::DOUBLE[]) >= 0 THEN {1 << (len(rows) - 1 - k)} ELSE 0 END" for k, row in enumerate(rows)) for rows in PLANES]
    coded = " UNION ALL ".join(f"SELECT kind, id, {t} AS table_id, ({b})::BIGINT AS code FROM {{0}}" for t, b in enumerate(bits))
    return (
        f"""WITH {_V},
me AS (SELECT * FROM v ORDER BY id LIMIT 1),
shown AS (SELECT b.id, b.vec, b.class, {_EUC} AS score FROM me a CROSS JOIN v b WHERE a.id <> b.id ORDER BY score, b.id LIMIT 10),
told AS (SELECT shown.id, shown.vec, {_UNIT.format("shown.vec")} AS unit, shown.class = me.class AS good FROM shown CROSS JOIN me),
dims AS (SELECT unnest(range(1, 65)) AS dim),
qv AS (SELECT dim, vec[dim] + coalesce((SELECT avg(unit[dim]) FROM told WHERE good), 0) - coalesce((SELECT avg(unit[dim]) FROM told WHERE NOT good), 0) AS x FROM me CROSS JOIN dims),
counts AS (SELECT dim, CASE WHEN x <> 0 THEN 0.5 ELSE 0 END::DOUBLE AS half, (SELECT count(*) FROM v WHERE vec[dim] <> 0)::DOUBLE AS n, (SELECT count(*) FROM v)::DOUBLE AS nn,
  (SELECT count(*) FROM told WHERE good AND vec[dim] <> 0)::DOUBLE AS r, (SELECT count(*) FROM told WHERE good)::DOUBLE AS judged FROM qv),
odds AS (SELECT dim, (r + half + n / nn) / (judged + half + 1) AS p, (n - r - half + n / nn) / (nn - judged - half + 1) AS u FROM counts),
clamped AS (SELECT dim, CASE WHEN p <= 0 THEN 1e-5 WHEN p >= 1 THEN 0.99 ELSE p END::DOUBLE AS p, CASE WHEN u <= 0 THEN 1e-5 WHEN u >= 1 THEN 0.99 ELSE u END::DOUBLE AS u FROM odds),
asked AS MATERIALIZED (SELECT 'vect' AS kind, (SELECT id FROM me) AS id, list(x ORDER BY dim) AS q FROM qv
  UNION ALL SELECT 'prob', (SELECT id FROM me), list(ln(p * (1 - u) / (u * (1 - p))) ORDER BY dim) FROM clamped),
others AS (SELECT kind, v.id, v.vec FROM v CROSS JOIN asked WHERE v.id <> asked.id),
nodes AS MATERIALIZED (SELECT * FROM others UNION ALL SELECT kind, id, q FROM asked),
pairs AS MATERIALIZED (SELECT kind, a.id AS i, b.id AS j, {cosine.replace("a.q", "a.vec")} AS score FROM nodes a JOIN nodes b USING (kind)){edges},
seeds AS MATERIALIZED (SELECT kind AS run, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS p FROM {_EVERY_KIND} CROSS JOIN (SELECT id AS node FROM told WHERE good UNION ALL SELECT id FROM me))"""
        + _ppr("u", "seeds", 0.65, ROUNDS).replace("ON dst = node", "ON dst = node AND kind = run")
        + f""",
ocodes AS ({coded.format("others")}),
qcodes AS ({coded.format("(SELECT kind, id, q AS vec FROM asked)")}),
dist AS (SELECT kind, b.id, min(bit_count(xor(a.code, b.code))) AS h FROM qcodes a JOIN ocodes b USING (kind, table_id) WHERE bit_count(xor(a.code, b.code)) < 8 GROUP BY ALL),
running AS (SELECT kind, h, sum(count(*)) OVER (PARTITION BY kind ORDER BY h) AS found FROM dist GROUP BY kind, h),
lev AS (SELECT kind, coalesce(min(h) FILTER (found >= 10), 7) AS level FROM running GROUP BY kind),
every AS (SELECT 'knn' AS name, kind, b.id AS object_id, {_EUC.replace("a.vec", "a.q")} AS score, 1 AS sign FROM asked a JOIN others b USING (kind)
  UNION ALL SELECT 'prob', kind, b.id, round(list_dot_product(a.q, b.vec), 9), -1 FROM asked a JOIN others b USING (kind)
  UNION ALL SELECT 'lsh', kind, b.id, {cosine}, -1 FROM asked a JOIN others b USING (kind) JOIN dist ON dist.kind = a.kind AND dist.id = b.id JOIN lev ON lev.kind = a.kind WHERE h <= level
  UNION ALL SELECT 'ppr', run, node, round(score, 9), -1 FROM u{ROUNDS} WHERE node <> (SELECT id FROM me))
SELECT name || '_' || kind AS method, (SELECT id FROM me) AS query_id, object_id, score + 0.0 AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY sign * score, object_id) AS rank FROM every) WHERE rank <= 10"""
    )


_METHODS = f""",
ms AS (SELECT 'cosine' AS method, i AS query_id, j AS object_id, -score AS s FROM cos WHERE i % 20 = 0
  UNION ALL SELECT 'dot', a.id, b.id, -round(list_dot_product(a.vec, b.vec), 9) FROM v a CROSS JOIN v b WHERE a.id % 20 = 0
  UNION ALL SELECT 'euclidean', a.id, b.id, {_EUC} FROM v a CROSS JOIN v b WHERE a.id % 20 = 0),
methods AS (SELECT * FROM (SELECT method, query_id, object_id, row_number() OVER (PARTITION BY method, query_id ORDER BY s, object_id) AS rank FROM ms) WHERE rank <= 10)"""
_LAP = ",\ne AS (SELECT i, j, score AS w FROM cos WHERE score >= 0.5),\ndeg AS (SELECT i, sum(w) AS d FROM e GROUP BY i)"


def _kmeans_sql() -> str:
    out = f"{_V},\nl AS (SELECT id, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM v),\nc0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, vec FROM v ORDER BY id LIMIT {CENTRES})"
    near = "SELECT id, c FROM (SELECT v.id, k.c, row_number() OVER (PARTITION BY v.id ORDER BY round(list_sum(list_transform(range(1, 65), lambda q: (v.vec[q] - k.vec[q]) * (v.vec[q] - k.vec[q]))), 9), k.c) AS r FROM v CROSS JOIN c{0} k) WHERE r = 1"
    for k in range(1, 4):
        out += f",\na{k} AS MATERIALIZED ({near.format(k - 1)}),\nm{k} AS (SELECT c, list(x ORDER BY dim) AS vec FROM (SELECT c, dim, avg(x) AS x FROM a{k} JOIN l USING (id) GROUP BY c, dim) GROUP BY c),"
        out += f"\nc{k} AS MATERIALIZED (SELECT c, coalesce(m{k}.vec, c{k - 1}.vec) AS vec FROM c{k - 1} LEFT JOIN m{k} USING (c))"
    return f"WITH {out}\nSELECT id AS object_id, c AS cluster FROM ({near.format(3)})"


ORACLES = {
    "latent_cosine_topk": f"WITH {_COS},\nscored AS (SELECT i AS query_id, j AS object_id, score FROM cos WHERE i % 20 = 0)\n" + _TOP.format("DESC"),
    "dot_matrix_scaled": f"WITH {_V},\nm AS (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.vec, b.vec), 9) AS s FROM v a CROSS JOIN v b)\nSELECT i, j, round(coalesce(s / nullif(max(s) OVER (PARTITION BY j), 0), 0), 6) + 0.0 AS score FROM m",
    "cosine_matrix": f"WITH {_COS.replace('round(', '(', 1).replace(', 9) AS score', ') AS score')}\nSELECT i, j, round((score + 1) / 2, 6) + 0.0 AS score FROM cos",
    "knn_retrieve": f"WITH {_V},\nscored AS (SELECT a.id AS query_id, b.id AS object_id, {_EUC} AS score FROM v a CROSS JOIN v b WHERE a.id % 20 = 0 AND a.id <> b.id)\n" + _TOP.format("ASC"),
    "knn_graph": f"WITH {_COS}\nSELECT i AS src, j AS dst, score + 0.0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM cos) WHERE r <= 10",
    "knn_graph_compat": f"""WITH {_COS},
no AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no, count(*) OVER () AS n FROM v),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score, j) - 1 AS place FROM cos),
cells AS (SELECT i, place FROM placed JOIN no ON id = j WHERE no > n - 10)
SELECT cos.i AS src, cos.j AS dst, score + 0.0 AS w FROM cells JOIN no ON no.no = place JOIN cos ON cos.i = cells.i AND cos.j = no.id""",
    "graph_normalise": f"WITH {_COS}{_KNN}\nSELECT src, dst, round(w, 6) + 0.0 AS w FROM edges",
    "ppr_topm": f"WITH {_COS}{_KNN}"
    + _UNIFORM.format("seeds", "SELECT a.id AS run, b.id AS node FROM v a JOIN v b ON b.id = a.id OR b.id = a.id + 1 WHERE a.id % 20 = 0")
    + _ppr("u", "seeds", 0.65, ROUNDS) + _RANKED.format("t", f"u{ROUNDS}") + "\n" + _SHOW.format("t"),
    "ppr_classify": f"WITH {_COS}{_KNN}"
    + _UNIFORM.format("seeds", "SELECT class AS run, id AS node FROM v WHERE id % 10 < 3")
    + _ppr("u", "seeds", 0.375, 2 * ROUNDS)
    + f"\nSELECT query_id, predicted FROM (SELECT node AS query_id, run AS predicted, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, run) AS r FROM u{2 * ROUNDS} WHERE node % 10 >= 3 AND round(score, 9) > 0) WHERE r = 1",
    "ppr_vote": f"WITH {_COS}{_KNN}{_VOTES}\nSELECT query_id, voting, weighted FROM voting JOIN weighted USING (query_id)",
    "ppr_reseed": f"WITH {_COS}{_KNN}"
    + _UNIFORM.format("s1", "SELECT id AS run, id AS node FROM v WHERE id % 20 = 0") + _ppr("u", "s1", 0.8, ROUNDS) + _RANKED.format("t1", f"u{ROUNDS}")
    + _UNIFORM.format("s2", "SELECT id AS run, id AS node FROM v WHERE id % 20 = 0 UNION ALL SELECT query_id, object_id FROM t1 JOIN v a ON a.id = query_id JOIN v b ON b.id = object_id WHERE a.class = b.class")
    + _ppr("x", "s2", 0.8, ROUNDS) + _RANKED.format("t2", f"x{ROUNDS}") + "\n" + _SHOW.format("t2"),
    "lsh_codes": f"WITH {_codes_sql()}\nSELECT * FROM codes",
    "lsh_buckets": f"WITH {_codes_sql()}\nSELECT table_id, code, count(*) AS n, min(object_id) AS first, max(object_id) AS last FROM codes GROUP BY ALL",
    "lsh_multiprobe": f"WITH {_codes_sql()}{_PROBE}\nSELECT * FROM cand",
    "lsh_rerank": f"WITH {_codes_sql()}{_PROBE},\nscored AS (SELECT query_id, object_id, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS score, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM cand JOIN v a ON a.id = query_id JOIN v b ON b.id = object_id)\n"
    + _TOP.format("DESC").replace("rank FROM (", "rank, n_candidates FROM (", 1),
    "lsh_search": f"""WITH {_codes_sql(WIDE)},
cand AS (SELECT DISTINCT a.object_id AS query_id, b.object_id FROM codes a JOIN codes b USING (table_id) WHERE a.object_id % 20 = 0 AND bit_count(xor(a.code, b.code)) < 2),
scored AS (SELECT query_id, object_id, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS score FROM cand JOIN v a ON a.id = query_id JOIN v b ON b.id = object_id)
"""
    + _TOP.format("DESC"),
    "session_results": _session_sql(),
    "knn_classify_tiebreak": f"WITH {_V},{_NEAR}\nSELECT query_id, predicted, k_used FROM knnp",
    "accuracy_report": f"""WITH {_COS}{_KNN}{_VOTES},{_NEAR},
p AS (SELECT 'voting' AS method, query_id, voting AS predicted FROM voting UNION ALL SELECT 'weighted', query_id, weighted FROM weighted UNION ALL SELECT 'knn', query_id, predicted FROM knnp)
SELECT method, count(*) AS n, round(avg(CASE WHEN predicted = class THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM p JOIN v ON id = query_id GROUP BY method""",
    "cart_best_split": f"""WITH {_V},
l AS (SELECT class, unnest(range(0, 64)) AS feature, unnest(vec) AS value FROM v WHERE id % 10 < 3),
vals AS (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt FROM (SELECT DISTINCT feature, value FROM l)),
sides AS (SELECT p.feature, p.value, p.nxt, l.class, count(*) FILTER (l.value <= p.value) AS lc, count(*) FILTER (l.value > p.value) AS rc FROM vals p JOIN l USING (feature) WHERE nxt IS NOT NULL GROUP BY ALL),
g AS (SELECT feature, (value + nxt) / 2 AS threshold, round((sum(lc) - sum(lc * lc) / sum(lc) + sum(rc) - sum(rc * rc) / sum(rc)) / (sum(lc) + sum(rc)), 9) AS gini FROM sides GROUP BY feature, value, nxt)
SELECT feature, round(threshold, 6) + 0.0 AS threshold, gini + 0.0 AS gini FROM g ORDER BY g.gini, g.feature, g.threshold LIMIT 1""",
    "train_anti_join": f"WITH {_V}\nSELECT class, count(*) AS n, min(id) AS first FROM v WHERE id NOT IN (SELECT id FROM v WHERE id % 10 < 3) GROUP BY class",
    "label_from_parent": "SELECT documents.doc_id || '_' || source AS object_id, quality::BIGINT AS class FROM documents JOIN labels USING (doc_id)",
    "laplacian_unnorm": f"WITH {_COS}{_LAP}\nSELECT e.i, e.j, round(CASE WHEN e.i = e.j THEN deg.d ELSE 0 END - w, 9) + 0.0 AS l FROM e JOIN deg ON deg.i = e.i",
    "laplacian_norm": f"WITH {_COS}{_LAP}\nSELECT e.i, e.j, round(CASE WHEN e.i = e.j THEN 1 ELSE 0 END - coalesce(w / nullif(sqrt(a.d * b.d), 0), 0), 9) + 0.0 AS l FROM e JOIN deg a ON a.i = e.i JOIN deg b ON b.i = e.j",
    "kmeans_fixed": _kmeans_sql(),
    "latent_partition": f"""WITH {_V},
l AS (SELECT id, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM v),
s AS (SELECT *, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) AS y FROM l WINDOW w AS (PARTITION BY dim)),
r AS (SELECT id, dim, row_number() OVER (PARTITION BY id ORDER BY y DESC, dim) AS ry, row_number() OVER (PARTITION BY id ORDER BY x DESC, dim) AS rx FROM s)
SELECT id AS object_id, min(dim) FILTER (ry = 1) AS scaled, min(dim) FILTER (rx = 1) AS plain FROM r GROUP BY id""",
    "method_pivot_report": f"WITH {_COS}{_METHODS}\nSELECT query_id, rank, max(object_id) FILTER (method = 'cosine') AS cosine, max(object_id) FILTER (method = 'dot') AS dot, max(object_id) FILTER (method = 'euclidean') AS euclidean FROM methods GROUP BY query_id, rank",
    "zipped_ranks": f"WITH {_COS}{_METHODS}\nSELECT query_id, rank, max(object_id) FILTER (method = 'cosine') AS cosine, max(object_id) FILTER (method = 'dot') AS dot, max(object_id) FILTER (method = 'euclidean') AS euclidean FROM methods GROUP BY query_id, rank",
    "method_scores": f"""WITH {_COS}{_METHODS}
SELECT a.method, round(count(v.id) / (count(b.object_id) + 1e-10), 4) AS score FROM methods a LEFT JOIN v ON v.id = a.object_id AND v.class = 0
LEFT JOIN methods b ON b.method = a.method AND b.object_id = a.object_id AND b.query_id = 20 WHERE a.query_id = 0 GROUP BY a.method""",
    "dominant_report": f"""WITH {_COS}{_METHODS},
n AS (SELECT query_id, class, count(*) AS n FROM methods JOIN v ON id = object_id WHERE method = 'cosine' GROUP BY ALL)
SELECT query_id, k, class, n FROM (SELECT *, (sum(n) OVER (PARTITION BY query_id))::BIGINT AS k, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, class) AS r FROM n) WHERE r = 1""",
    "ranked_lines": f"WITH {_COS},\nscored AS (SELECT i AS query_id, j AS object_id, score FROM cos WHERE i % 20 = 0)\nSELECT query_id, rank, '& ' || object_id || ' & ' || printf('%.2f', round_even(score::DECIMAL(18,6), 2)::DOUBLE) AS line FROM ("
    + _TOP.format("DESC") + ")",
}

QUERIES = {
    f.__name__: f
    for f in (
        latent_cosine_topk, dot_matrix_scaled, cosine_matrix, mahalanobis_topk, knn_retrieve, knn_graph, knn_graph_compat, graph_normalise, ppr_topm, ppr_classify, ppr_vote, ppr_reseed, lsh_codes, lsh_buckets,
        lsh_multiprobe, lsh_rerank, lsh_search, knn_classify_tiebreak, accuracy_report, cart_best_split, cart_predict, train_anti_join, label_from_parent, laplacian_unnorm, laplacian_norm, kmeans_fixed, kmeans, spectral,
        zipped_ranks, latent_partition, latent_partition_svd, latent_search_svd, pca_latent, svd_latent, nmf_latent, lda_latent, topic_terms_svd, semantic_files, method_pivot_report, method_scores, session_results, dominant_report, ranked_lines,
    )
}
