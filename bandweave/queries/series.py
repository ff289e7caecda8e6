"""Queries over event and order series: bands, words, weights, sequence search, and feedback on word weights.

Searches take as queries every object whose id is divisible by 20, against all objects; edit_topk and dtw_topk take every object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import cumulative_bands, sampled_bands
from ..functions.ids import canonical, display, half_even
from ..operators import feedback as fb
from ..operators import sequence, similarity, symbolic, weights
from ..operators.latent import Technique, latent, topic_terms
from ..plans.stages import cut
from ..sources.series import event_series, order_series

R = 3
BANDS, SAMPLED = cumulative_bands(R), sampled_bands(R)
KEY = ("object_id", "sensor")


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def kept(c: str) -> Column:
    """A score that its operator has rounded already; rounding it once more could meet exact halves."""
    return (F.col(c) + F.lit(0.0)).alias(c)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- SQL ----


def _band_sql(x: str, levels: tuple[float, ...], op: str) -> str:
    return " + ".join(f"CASE WHEN {x} {op} {level!r} THEN 1 ELSE 0 END" for level in levels[1:-1])


def _label_sql(band: str, labels: tuple[float, ...]) -> str:
    return f"CASE {band} " + " ".join(f"WHEN {i} THEN {x!r}::DOUBLE" for i, x in enumerate(labels)) + " END"


CTES = f"""
series AS (SELECT user_id AS object_id, event_type AS sensor, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value FROM events),
bounds AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM series WINDOW w AS (PARTITION BY object_id, sensor)),
scaled AS (SELECT object_id, sensor, t, value, CASE WHEN hi > lo THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - lo) * 2.0::DOUBLE / (hi - lo) + -1.0::DOUBLE)) ELSE -1.0::DOUBLE END AS scaled FROM bounds),
banded AS (SELECT *, {_band_sql('scaled', BANDS.levels, '>')} AS band FROM scaled),
quant AS (SELECT *, {_label_sql('band', BANDS.labels)} AS label FROM banded),
framed AS (SELECT object_id, sensor, t, string_agg(band::VARCHAR, '-') OVER w AS word, avg(label) OVER w AS avg FROM quant
  WINDOW w AS (PARTITION BY object_id, sensor ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
words AS (SELECT * FROM framed WHERE t % 3 = 0),
counts AS (SELECT object_id, sensor, word, count(*) AS n FROM words GROUP BY ALL),
tf AS (SELECT *, n / sum(n) OVER (PARTITION BY object_id, sensor) AS tf FROM counts),
idf AS (SELECT sensor, word, count(*) AS df, ln((SELECT count(DISTINCT object_id) FROM words)::DOUBLE / count(*)) AS idf FROM tf GROUP BY ALL),
tfidf AS (SELECT tf.*, df, idf, tf * idf AS tfidf FROM tf JOIN idf USING (sensor, word)),
entropy AS (SELECT *, -tf * log2(tf + 1e-7) AS entropy FROM tf),
vocab AS (SELECT row_number() OVER (ORDER BY o, sensor, t, word) - 1 AS dim, sensor, word FROM
  (SELECT sensor, word, min(object_id) AS o, min_by(t, (object_id, t)) AS t FROM words GROUP BY ALL)),
weights AS (SELECT object_id, dim, tfidf AS w FROM tfidf JOIN vocab USING (sensor, word) WHERE tfidf <> 0),
seqs AS (SELECT object_id, sensor, list(word ORDER BY t) AS ws, list(avg ORDER BY t) AS avgs, list(entropy ORDER BY t) AS es
  FROM words JOIN entropy USING (object_id, sensor, word) GROUP BY ALL)"""


def _sql(body: str, more: str = "") -> str:
    return f"WITH {CTES.strip()}{more}\n{body}"


_TOP = "SELECT query_id, object_id, score + 0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {0}, object_id) AS rank FROM scored) WHERE rank <= 10"

_WARP = """list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_transform(range(1, len(b) + 1), lambda j: list_sum(list_transform(b[1:j], lambda v: abs(v))))), list_transform(a, lambda v: [v])),
  lambda prev, x: list_reduce(list_prepend([prev[1] + abs(x[1])], list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE])),
    lambda acc, jj: list_append(acc, abs(x[1] - b[jj[1]::INT]) + least(prev[jj[1]::INT + 1], acc[len(acc)], prev[jj[1]::INT]))))[-1]"""

_EDIT = """list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_transform(range(1, len(be) + 1), lambda j: list_sum(be[1:j]))), list_transform(range(1, len(ae) + 1), lambda i: [i::DOUBLE])),
  lambda prev, x: list_reduce(list_prepend([prev[1] + ae[x[1]::INT]], list_transform(range(1, len(be) + 1), lambda j: [j::DOUBLE])),
    lambda acc, jj: list_append(acc, least(prev[jj[1]::INT + 1] + abs(ae[x[1]::INT] - be[jj[1]::INT]), acc[len(acc)] + abs(ae[x[1]::INT] - be[jj[1]::INT]),
      prev[jj[1]::INT] + CASE WHEN aw[x[1]::INT] = bw[jj[1]::INT] THEN 0.0 ELSE abs(ae[x[1]::INT] - be[jj[1]::INT]) END))))[-1]"""

_PAIRS = "(SELECT x.object_id AS query_id, y.object_id, x.avgs AS a, y.avgs AS b, x.ws AS aw, y.ws AS bw, x.es AS ae, y.es AS be FROM seqs x JOIN seqs y USING (sensor) WHERE {0})"


def _sequence_top_sql(distance: str) -> str:
    return _sql(_TOP.format("ASC"), f",\nscored AS (SELECT query_id, object_id, round(sum(d), 9) AS score FROM (SELECT query_id, object_id, {distance} AS d FROM {_PAIRS.format('TRUE')}) GROUP BY ALL)")


def _sequence_matrix_sql(distance: str) -> str:
    return _sql(
        "SELECT i, j, round(coalesce((m - s) / nullif(m, 0), 0), 6) + 0.0 AS score FROM (SELECT *, max(s) OVER (PARTITION BY j) AS m FROM every)",
        f""",
half AS (SELECT query_id AS i, object_id AS j, round(sum(d), 9) AS s FROM (SELECT query_id, object_id, {distance} AS d FROM {_PAIRS.format('x.object_id <= y.object_id')}) GROUP BY ALL),
every AS (SELECT i, j, s FROM half UNION ALL SELECT j, i, s FROM half WHERE i <> j)""",
    )


# ---- queries ----


def _words(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.words_of(event_series(spark, d), BANDS)


def series_minmax(spark, d):
    return symbolic.minmax(event_series(spark, d)).select(*KEY, long("t").alias("t"), r6("scaled").alias("scaled"))


def series_stats(spark, d):
    return symbolic.statistics(symbolic.minmax(event_series(spark, d))).select(*KEY, r6("mean").alias("mean"), r6("deviation").alias("deviation"))


def band_histogram(spark, d):
    q = symbolic.quantise(symbolic.minmax(event_series(spark, d)), BANDS)
    return q.groupBy("sensor", long("band").alias("band"), r6("label").alias("label")).agg(F.count("*").alias("n"))


def band_histogram_left(spark, d):
    q = symbolic.quantise(symbolic.minmax(event_series(spark, d)), SAMPLED, left_closed=True)
    return q.groupBy("sensor", long("band").alias("band"), r6("label").alias("label")).agg(F.count("*").alias("n"))


def words_sliding(spark, d):
    return _words(spark, d).select(*KEY, long("t").alias("t"), "word")


def word_avg(spark, d):
    return _words(spark, d).select(*KEY, long("t").alias("t"), r6("avg").alias("avg"))


def segment_means(spark, d):
    return symbolic.tumbling_mean(event_series(spark, d)).select(*KEY, long("step").alias("step"), r6("mean").alias("mean"))


def word_count(spark, d):
    every = _words(spark, d).unionByName(symbolic.words_of(order_series(spark, d), BANDS))
    return weights.word_counts(every).groupBy("component", "sensor", "word").agg(F.sum("n").alias("n"), F.count("*").alias("objects"))


def tf(spark, d):
    return weights.term_frequency(_words(spark, d)).select(*KEY, "word", "n", r6("tf").alias("tf"))


def idf(spark, d):
    words = _words(spark, d)
    n = words.select("object_id").distinct().count()
    return weights.inverse_document_frequency(weights.term_frequency(words), n).select("sensor", "word", "df", r6("idf").alias("idf"))


def tfidf(spark, d):
    return weights.tf_idf(_words(spark, d)).select(*KEY, "word", "n", r6("tf").alias("tf"), r6("tfidf").alias("tfidf"))


def idf2_tfidf2(spark, d):
    return weights.tf_idf2(_words(spark, d)).select(*KEY, "word", r6("idf2").alias("idf2"), r6("tfidf2").alias("tfidf2"))


def vocab_index(spark, d):
    return weights.vocabulary(_words(spark, d)).select(long("dim").alias("dim"), "sensor", "word")


def entropy_weights(spark, d):
    return weights.entropy(weights.term_frequency(_words(spark, d))).select(*KEY, "word", r6("entropy").alias("entropy"))


def dense_vectors(spark, d):
    words = _words(spark, d)
    held = weights.tf_idf(words)
    out = weights.dense(held, weights.vocabulary(words), words, "tfidf")
    return out.select("object_id", F.posexplode("vec").alias("dim", "w")).select("object_id", long("dim").alias("dim"), r6("w").alias("w"))


def seq_vectors(spark, d):
    words = _words(spark, d)
    seq = weights.sequences(words, weights.tf_idf(words), ["tf", "tfidf"])
    return seq.select(*KEY, F.posexplode("seq").alias("place", "s")).select(*KEY, long("place").alias("place"), long("s.t").alias("t"), "s.word", r6("s.tf").alias("tf"), r6("s.tfidf").alias("tfidf"))


def _word_vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """id and vec, the TF-IDF of every word of the vocabulary, written down; and the vocabulary."""
    words = _words(spark, d)
    vocab = cut(weights.vocabulary(words))
    return cut(weights.dense(weights.tf_idf(words), vocab, words, "tfidf").withColumnRenamed("object_id", "id")), vocab


def word_latent_topk(spark, d):
    """Cosine search among the latent vectors that each technique gives of the objects' word weights."""
    objects, _ = _word_vectors(spark, d)
    out = None
    for technique in Technique:
        held = cut(latent(objects, technique)[0])
        top = similarity.top_k(held.where(F.col("id") % 20 == 0), held, "cosine", 10, exclude_self=True)
        one = top.select(F.lit(technique.value).alias("technique"), "query_id", "object_id", kept("score"), long("rank").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def word_topic_terms(spark, d):
    """The words of each latent topic by falling score, for techniques whose signs are settled."""
    objects, vocab = _word_vectors(spark, d)
    names = vocab.select("dim", F.concat_ws(":", *DIMS).alias("term"))
    out = None
    for technique in (Technique.SVD, Technique.NMF, Technique.LDA):
        one = topic_terms(latent(objects, technique)[1], names).select(F.lit(technique.value).alias("technique"), "topic", long("rank").alias("rank"), "term", "score")
        out = one if out is None else out.unionByName(one)
    return out


def id_normalise(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    padded = canonical(F.concat_ws("_", c.c_custkey, c.c_nationkey))
    return c.select("c_custkey", padded.alias("padded"), display(padded).alias("shown"))


def round_half_even(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), half_even(F.col("l_extendedprice").cast("decimal(18,4)"), 1).cast("double").alias("price"))


def _sparse(spark, d, weight="tfidf") -> DataFrame:
    """Word weights, written down: searches read them for the queries, the objects and the norms."""
    return cut(weights.tf_idf(_words(spark, d)).select("object_id", "component", "sensor", "word", F.col(weight).alias("w")))


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("object_id") % 20 == 0)


def _topped(scored: DataFrame, up: bool) -> DataFrame:
    out = similarity.ranked(scored.withColumn("score", F.round("score", 9)), 10, up)
    return out.select("query_id", "object_id", kept("score"), long("rank").alias("rank"))


DIMS = ["component", "sensor", "word"]


def _bag_cosine(w: DataFrame) -> DataFrame:
    top = cut(_topped(similarity.sparse_scores(_asked(w), w, "cosine_distance", DIMS).where("query_id <> object_id"), True))
    out = similarity.filled(top, _asked(w), w, 10, 1.0, exclude_self=True)
    return out.select("query_id", "object_id", "score", long("rank").alias("rank"))


def bag_cosine_topk(spark, d):
    return _bag_cosine(_sparse(spark, d))


def bag_counts_topk(spark, d):
    w = weights.word_counts(_words(spark, d)).select("object_id", *DIMS, F.col("n").cast("double").alias("w"))
    return _bag_cosine(cut(w))


def bag_tf_topk(spark, d):
    return _bag_cosine(_sparse(spark, d, "tf"))


def bag_tfidf2_topk(spark, d):
    return _bag_cosine(cut(weights.tf_idf2(_words(spark, d)).select("object_id", *DIMS, F.col("tfidf2").alias("w"))))


def bag_euclid_topk(spark, d):
    w = _sparse(spark, d)
    return _topped(similarity.sparse_euclidean(_asked(w), w, DIMS).where("query_id <> object_id"), True)


def dot_topk(spark, d):
    w = _sparse(spark, d, "tf")
    top = cut(_topped(similarity.sparse_scores(_asked(w), w, "dot", DIMS), False))
    return similarity.filled(top, _asked(w), w, 10, 0.0).select("query_id", "object_id", "score", long("rank").alias("rank"))


def _sequence_vectors(spark, d) -> DataFrame:
    words = _words(spark, d)
    seq = weights.sequences(words, weights.tf_idf(words), ["tfidf"])
    return cut(seq.select("object_id", "component", "sensor", F.transform("seq", lambda s: s["tfidf"]).alias("seq")))


def _sequence_topk(asked: DataFrame, seq: DataFrame, measure: str, exclude_self: bool = False) -> DataFrame:
    out = sequence.sequence_top_k(asked, seq, measure, exclude_self=exclude_self)
    return out.select("query_id", "object_id", kept("score"), long("rank").alias("rank"))


def seq_cosine_topk(spark, d):
    seq = _sequence_vectors(spark, d)
    return _sequence_topk(_asked(seq), seq, "cosine_distance", exclude_self=True)


def seq_euclid_topk(spark, d):
    seq = _sequence_vectors(spark, d)
    return _sequence_topk(_asked(seq), seq, "euclidean", exclude_self=True)


def _entropy_sequences(spark, d) -> DataFrame:
    words = _words(spark, d)
    return cut(weights.sequences(words, weights.entropy(weights.term_frequency(words)), ["entropy"]))


def edit_topk(spark, d):
    seq = _entropy_sequences(spark, d)
    return _sequence_topk(seq, seq, "edit")


def dtw_topk(spark, d):
    seq = _entropy_sequences(spark, d)
    return _sequence_topk(seq, seq, "dtw")


def edit_matrix_scaled(spark, d):
    return sequence.sequence_matrix(_entropy_sequences(spark, d), "edit")


def dtw_matrix_scaled(spark, d):
    return sequence.sequence_matrix(_entropy_sequences(spark, d), "dtw")


# feedback on word weights: the wanted class is users whose id is even; the query object is the smallest id


def _weights(spark, d) -> tuple[DataFrame, DataFrame, int]:
    words = _words(spark, d)
    vocab = cut(weights.vocabulary(words))
    w = cut(weights.tf_idf(words).where("tfidf <> 0").join(vocab, DIMS).select("object_id", "dim", F.col("tfidf").alias("w")))
    return w, vocab, words.select("object_id").distinct().count()


def _told(w: DataFrame) -> DataFrame:
    return w.select("object_id").distinct().select("object_id", F.when(F.col("object_id") % 7 == 0, 1).when(F.col("object_id") % 7 == 1, -1).otherwise(0).alias("relevance"))


def _query(w: DataFrame) -> DataFrame:
    return w.where(F.col("object_id") == w.agg(F.min("object_id")).first()[0]).select("dim", F.col("w").alias("q"))


def prob_weights_init(spark, d):
    w, _, n = _weights(spark, d)
    return fb.initial_weights(w, n).select(long("dim").alias("dim"), r6("q").alias("q"))


def prob_weights_feedback(spark, d):
    w, _, n = _weights(spark, d)
    return fb.feedback_weights(w, _told(w), _query(w), n).select(long("dim").alias("dim"), r6("q").alias("q"))


def prob_topk(spark, d):
    w, _, n = _weights(spark, d)
    return fb.best(fb.scores(w, fb.feedback_weights(w, _told(w), _query(w), n)), 10).select("object_id", kept("score"))


def rocchio(spark, d):
    w, _, _ = _weights(spark, d)
    return fb.rocchio(_query(w), w, _told(w)).select(long("dim").alias("dim"), r6("q").alias("q"))


def query_change(spark, d):
    w, _, _ = _weights(spark, d)
    before = _query(w)
    return fb.change(before, fb.rocchio(before, w, _told(w)))


def relative_importance(spark, d):
    w, vocab, _ = _weights(spark, d)
    before = _query(w)
    out = fb.relative_importance(before, fb.rocchio(before, w, _told(w)), vocab)
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("level", name("component"), name("sensor"), F.coalesce(long("dim"), F.lit(-1).cast("long")).alias("dim"), kept("change"), F.round("scaled", 4).alias("scaled"))


def feedback_curve(spark, d):
    """Share of wanted users (even ids) among the ten best, in each of three rounds of simulated feedback."""
    w, _, n = _weights(spark, d)
    labels = w.select("object_id").distinct().withColumn("class", F.col("object_id") % 2)
    got = fb.rounds(w, labels, 0, _query(w), n, 3)
    out = None
    for k, (_, found) in enumerate(got, 1):
        judged = fb.judged_by_class(found, labels, 0).agg(F.avg(F.when(F.col("relevance") == 1, 1.0).otherwise(0.0)).alias("relevance"), F.count("*").alias("n"))
        judged = judged.select(F.lit(k).cast("long").alias("round"), r6("relevance").alias("relevance"), "n")
        out = judged if out is None else out.unionByName(judged)
    return out


_FEEDBACK = """,
told AS (SELECT DISTINCT object_id, CASE object_id % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS relevance FROM weights),
query AS (SELECT dim, w AS q FROM weights WHERE object_id = (SELECT min(object_id) FROM weights)),
total AS (SELECT count(DISTINCT object_id)::DOUBLE AS nn FROM words),
held AS (SELECT dim, count(*) AS n FROM weights GROUP BY dim)"""


def _rewrite_sql(name: str, query: str, told: str) -> str:
    """CTEs that rewrite a query from judgements."""
    return f""",
{name}_r AS (SELECT dim, count(*) AS r FROM weights JOIN {told} USING (object_id) WHERE relevance = 1 GROUP BY dim),
{name}_m AS (SELECT held.dim, n, nn, coalesce(r, 0) + CASE WHEN coalesce(q, 0) <> 0 THEN 0.5 ELSE 0 END AS hits,
  (SELECT count(*) FROM {told} WHERE relevance = 1) + CASE WHEN coalesce(q, 0) <> 0 THEN 0.5 ELSE 0 END AS judged
  FROM held CROSS JOIN total LEFT JOIN {name}_r USING (dim) LEFT JOIN {query} USING (dim)),
{name}_p AS (SELECT dim, (hits + n / nn) / (judged + 1)::DOUBLE AS p, (n - hits + n / nn) / (nn - judged + 1) AS u FROM {name}_m),
{name}_c AS (SELECT dim, CASE WHEN p <= 0 THEN 1e-5 WHEN p >= 1 THEN 0.99 ELSE p END::DOUBLE AS p, CASE WHEN u <= 0 THEN 1e-5 WHEN u >= 1 THEN 0.99 ELSE u END::DOUBLE AS u FROM {name}_p),
{name} AS MATERIALIZED (SELECT dim, ln(p * (1 - u) / (u * (1 - p))) AS q FROM {name}_c)"""


_ROCCHIO = """,
size AS (SELECT relevance, count(*) AS size FROM told WHERE relevance <> 0 GROUP BY relevance),
length AS (SELECT object_id, sqrt(sum(w * w)) AS length FROM weights GROUP BY object_id),
moved AS (SELECT dim, sum(w / length * relevance / size) AS q FROM weights JOIN told USING (object_id) JOIN length USING (object_id) JOIN size USING (relevance) GROUP BY dim),
after AS (SELECT dim, sum(q) AS q FROM (SELECT * FROM query UNION ALL SELECT * FROM moved) GROUP BY dim)"""


def _curve_sql() -> str:
    more, query, out = _FEEDBACK, "query", []
    for k in (1, 2, 3):
        more += f""",
best{k} AS MATERIALIZED (SELECT object_id FROM (SELECT object_id, round(sum(w * q), 9) AS score FROM weights JOIN {query} USING (dim) GROUP BY object_id) ORDER BY score DESC, object_id LIMIT 10),
told{k} AS (SELECT object_id, CASE WHEN object_id % 2 = 0 THEN 1 ELSE -1 END AS relevance FROM best{k})""" + _rewrite_sql(f"q{k}", query, f"told{k}")
        out.append(f"SELECT {k}::BIGINT AS round, round(avg(CASE WHEN relevance = 1 THEN 1.0 ELSE 0.0 END), 6) AS relevance, count(*) AS n FROM told{k}")
        query = f"q{k}"
    return _sql(" UNION ALL ".join(out), more)


_SPARSE = """,
asked AS (SELECT * FROM {0} WHERE object_id % 20 = 0),
dots AS (SELECT a.object_id AS query_id, b.object_id, sum(a.{1} * b.{1}) AS dot FROM asked a JOIN {0} b USING (sensor, word) GROUP BY ALL),
norms AS (SELECT object_id, sum({1} * {1}) AS n FROM {0} GROUP BY object_id)"""


def _bag_cosine_sql(table: str, weight: str, more: str = "") -> str:
    scored = """,
scored AS (SELECT a.object_id AS query_id, b.object_id, round(1 - coalesce(dot / nullif(sqrt(a.n * b.n), 0), 0), 9) AS score
  FROM norms a JOIN norms b ON a.object_id % 20 = 0 AND a.object_id <> b.object_id LEFT JOIN dots ON query_id = a.object_id AND dots.object_id = b.object_id)"""
    return _sql(_TOP.format("ASC"), more + _SPARSE.format(table, weight) + scored)


ORACLES = {
    "series_minmax": _sql("SELECT object_id, sensor, t, round(scaled, 6) + 0.0 AS scaled FROM scaled"),
    "series_stats": _sql("SELECT object_id, sensor, round(avg(scaled), 6) + 0.0 AS mean, round(stddev_pop(scaled), 6) + 0.0 AS deviation FROM scaled GROUP BY ALL"),
    "band_histogram": _sql("SELECT sensor, band::BIGINT AS band, round(label, 6) + 0.0 AS label, count(*) AS n FROM quant GROUP BY ALL"),
    "band_histogram_left": _sql(
        f"SELECT sensor, band::BIGINT AS band, round({_label_sql('band', SAMPLED.labels)}, 6) + 0.0 AS label, count(*) AS n FROM (SELECT sensor, {_band_sql('scaled', SAMPLED.levels, '>=')} AS band FROM scaled) GROUP BY ALL"
    ),
    "words_sliding": _sql("SELECT object_id, sensor, t, word FROM words"),
    "word_avg": _sql("SELECT object_id, sensor, t, round(avg, 6) + 0.0 AS avg FROM words"),
    "segment_means": _sql("SELECT object_id, sensor, (t // 3)::BIGINT AS step, round(avg(value), 6) + 0.0 AS mean FROM series GROUP BY ALL"),
    "word_count": f"WITH {CTES.strip()}, " + CTES.strip().split("tf AS")[0].rstrip().rstrip(",").replace("user_id AS object_id, event_type AS sensor", "o_custkey AS object_id, o_orderpriority AS sensor").replace(
        "PARTITION BY user_id, event_type ORDER BY ts, event_id", "PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey"
    ).replace("value FROM events", "o_totalprice AS value FROM orders").replace("series", "oseries").replace("bounds", "obounds").replace("scaled AS (", "oscaled AS (").replace("FROM scaled", "FROM oscaled").replace("banded", "obanded").replace("quant", "oquant").replace(
        "framed", "oframed"
    ).replace("words", "owords").replace("counts", "ocounts")
    + """
SELECT 'E' AS component, sensor, word, sum(n)::BIGINT AS n, count(*) AS objects FROM counts GROUP BY ALL
UNION ALL SELECT 'O', sensor, word, sum(n)::BIGINT, count(*) FROM ocounts GROUP BY ALL""",
    "tf": _sql("SELECT object_id, sensor, word, n, round(tf, 6) + 0.0 AS tf FROM tf"),
    "idf": _sql("SELECT sensor, word, df, round(idf, 6) + 0.0 AS idf FROM idf"),
    "tfidf": _sql("SELECT object_id, sensor, word, n, round(tf, 6) + 0.0 AS tf, round(tfidf, 6) + 0.0 AS tfidf FROM tfidf"),
    "idf2_tfidf2": _sql(
        "SELECT object_id, sensor, word, round(idf2, 6) + 0.0 AS idf2, round(tf * idf2 + 1e-7, 6) + 0.0 AS tfidf2 FROM (SELECT *, ln((SELECT count(DISTINCT sensor) FROM words)::DOUBLE / count(*) OVER (PARTITION BY object_id, word)) AS idf2 FROM tf)"
    ),
    "vocab_index": _sql("SELECT dim, sensor, word FROM vocab"),
    "entropy_weights": _sql("SELECT object_id, sensor, word, round(entropy, 6) + 0.0 AS entropy FROM entropy"),
    "dense_vectors": _sql(
        "SELECT object_id, dim, round(coalesce(tfidf, 0), 6) + 0.0 AS w FROM (SELECT DISTINCT object_id FROM words) CROSS JOIN vocab LEFT JOIN tfidf USING (object_id, sensor, word)"
    ),
    "seq_vectors": _sql(
        "SELECT object_id, sensor, row_number() OVER (PARTITION BY object_id, sensor ORDER BY t) - 1 AS place, t, word, round(tf, 6) + 0.0 AS tf, round(tfidf, 6) + 0.0 AS tfidf FROM words JOIN tfidf USING (object_id, sensor, word)"
    ),
    "id_normalise": """SELECT c_custkey, replace(p, '_', '-') AS padded, replace(ltrim(replace(p, '_', '-'), '0'), '-', '_') AS shown
FROM (SELECT c_custkey, CASE WHEN length(x) < 7 THEN lpad(x, 7, '0') ELSE x END AS p FROM (SELECT c_custkey, c_custkey || '_' || c_nationkey AS x FROM customer))""",
    "round_half_even": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (round_even(l_extendedprice::DECIMAL(18,4), 1))::DOUBLE AS price FROM lineitem",
    "bag_cosine_topk": _bag_cosine_sql("tfidf", "tfidf"),
    "bag_counts_topk": _bag_cosine_sql("counted", "n", ",\ncounted AS (SELECT object_id, sensor, word, n::DOUBLE AS n FROM counts)"),
    "bag_tf_topk": _bag_cosine_sql("tf", "tf"),
    "bag_tfidf2_topk": _bag_cosine_sql("second", "w", """,
second AS (SELECT object_id, sensor, word, tf * ln((SELECT count(DISTINCT sensor) FROM words)::DOUBLE / count(*) OVER (PARTITION BY object_id, word)) + 1e-7 AS w FROM tf)"""),
    "bag_euclid_topk": _sql(
        _TOP.format("ASC"),
        _SPARSE.format("tfidf", "tfidf") + ",\nscored AS (SELECT a.object_id AS query_id, b.object_id, round(sqrt(greatest(0, a.n + b.n - 2 * coalesce(dot, 0))), 9) AS score FROM norms a JOIN norms b ON a.object_id % 20 = 0 AND a.object_id <> b.object_id LEFT JOIN dots ON query_id = a.object_id AND dots.object_id = b.object_id)",
    ),
    "dot_topk": _sql(
        _TOP.format("DESC"),
        _SPARSE.format("tf", "tf") + ",\nscored AS (SELECT a.object_id AS query_id, b.object_id, round(coalesce(dot, 0), 9) AS score FROM norms a JOIN norms b ON a.object_id % 20 = 0 LEFT JOIN dots ON query_id = a.object_id AND dots.object_id = b.object_id)",
    ),
    "seq_euclid_topk": _sql(
        _TOP.format("ASC"),
        """,
lists AS (SELECT object_id, sensor, list(tfidf ORDER BY t) AS v FROM words JOIN tfidf USING (object_id, sensor, word) GROUP BY ALL),
scored AS (SELECT a.object_id AS query_id, b.object_id, round(sum(sqrt(list_sum(list_transform(range(1, greatest(len(a.v), len(b.v)) + 1), lambda k: (coalesce(a.v[k], 0) - coalesce(b.v[k], 0)) * (coalesce(a.v[k], 0) - coalesce(b.v[k], 0)))))), 9) AS score
  FROM lists a JOIN lists b USING (sensor) WHERE a.object_id % 20 = 0 AND a.object_id <> b.object_id GROUP BY ALL)""",
    ),
    "seq_cosine_topk": _sql(
        _TOP.format("ASC"),
        """,
items AS (SELECT object_id, sensor, row_number() OVER (PARTITION BY object_id, sensor ORDER BY t) AS p, tfidf FROM words JOIN tfidf USING (object_id, sensor, word)),
lens AS (SELECT object_id, sensor, sqrt(sum(tfidf * tfidf)) AS n FROM items GROUP BY ALL),
dots AS (SELECT a.object_id AS query_id, b.object_id, a.sensor, sum(a.tfidf * b.tfidf) AS dot FROM items a JOIN items b USING (sensor, p) WHERE a.object_id % 20 = 0 GROUP BY ALL),
scored AS (SELECT a.object_id AS query_id, b.object_id, round(sum(1 - coalesce(dot / nullif(a.n * b.n, 0), 0)), 9) AS score FROM lens a JOIN lens b USING (sensor)
  LEFT JOIN dots ON query_id = a.object_id AND dots.object_id = b.object_id AND dots.sensor = a.sensor WHERE a.object_id % 20 = 0 AND a.object_id <> b.object_id GROUP BY ALL)""",
    ),
    "edit_topk": _sequence_top_sql(_EDIT),
    "dtw_topk": _sequence_top_sql(_WARP),
    "edit_matrix_scaled": _sequence_matrix_sql(_EDIT),
    "dtw_matrix_scaled": _sequence_matrix_sql(_WARP),
    "prob_weights_init": _sql("SELECT dim, round(ln(0.5 * (1 - u) / (u * 0.5)), 6) + 0.0 AS q FROM (SELECT dim, CASE WHEN n / nn >= 1 THEN 0.99 ELSE n / nn END::DOUBLE AS u FROM held CROSS JOIN total)", _FEEDBACK),
    "prob_weights_feedback": _sql("SELECT dim, round(q, 6) + 0.0 AS q FROM new", _FEEDBACK + _rewrite_sql("new", "query", "told")),
    "prob_topk": _sql("SELECT object_id, score + 0.0 AS score FROM (SELECT object_id, round(sum(w * q), 9) AS score FROM weights JOIN new USING (dim) GROUP BY object_id) ORDER BY score DESC, object_id LIMIT 10", _FEEDBACK + _rewrite_sql("new", "query", "told")),
    "rocchio": _sql("SELECT dim, round(q, 6) + 0.0 AS q FROM after", _FEEDBACK + _ROCCHIO),
    "query_change": _sql(
        "SELECT count(*) AS dims, count(*) FILTER (round(coalesce(query.q, 0), 9) <> round(coalesce(after.q, 0), 9)) AS changed FROM query FULL JOIN after USING (dim)", _FEEDBACK + _ROCCHIO
    ),
    "relative_importance": _sql(
        """SELECT level, coalesce(component, '') AS component, coalesce(sensor, '') AS sensor, coalesce(dim, -1) AS dim, change + 0.0 AS change, round(coalesce((change - min(change) OVER (PARTITION BY level)) / nullif(max(change) OVER (PARTITION BY level) - min(change) OVER (PARTITION BY level), 0), 0), 4) AS scaled
FROM (SELECT CASE WHEN component IS NOT NULL THEN 'component' WHEN sensor IS NOT NULL THEN 'sensor' ELSE 'word' END AS level, component, sensor, dim, round(sum(gap), 9) AS change
  FROM (SELECT 'E' AS component, sensor, dim, coalesce(query.q, 0) - coalesce(after.q, 0) AS gap FROM query FULL JOIN after USING (dim) JOIN vocab USING (dim)) GROUP BY GROUPING SETS ((component), (sensor), (dim)))""",
        _FEEDBACK + _ROCCHIO,
    ),
    "feedback_curve": _curve_sql(),
}

QUERIES = {
    f.__name__: f
    for f in (
        series_minmax, series_stats, band_histogram, band_histogram_left, words_sliding, word_avg, segment_means, word_count, tf, idf, tfidf, idf2_tfidf2, vocab_index, entropy_weights, dense_vectors, seq_vectors,
        id_normalise, round_half_even, bag_cosine_topk, bag_counts_topk, bag_tf_topk, bag_tfidf2_topk, bag_euclid_topk, dot_topk, seq_cosine_topk, seq_euclid_topk, edit_topk, dtw_topk, edit_matrix_scaled, dtw_matrix_scaled, prob_weights_init, prob_weights_feedback, prob_topk,
        rocchio, query_change, relative_importance, feedback_curve, word_latent_topk, word_topic_terms,
    )
}
