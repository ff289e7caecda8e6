"""Latent vectors: PCA, truncated SVD, NMF and LDA of object vectors (id, vec), and their topics."""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot


class Technique(Enum):
    PCA = "pca"
    SVD = "svd"
    NMF = "nmf"
    LDA = "lda"


def latent(objects: DataFrame, technique: Technique, k: int = 4, seed: int = 3, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """(latent, components): id and vec of length k; and topic (from 0), dim, score of each component.

    Signs of PCA components are arbitrary; the largest entry of an SVD component is positive. NMF and LDA need vectors without negative numbers. k must not be larger
    than the dimension.
    """
    return {Technique.PCA: _pca, Technique.SVD: _svd, Technique.NMF: _nmf, Technique.LDA: _lda}[technique](objects, k, seed, iterations)


def _projected(objects: DataFrame, axes: list[list[float]]) -> DataFrame:
    scores = [dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in axis])) for axis in axes]
    return objects.select("id", F.array(*scores).alias("vec"))


def _components(df: DataFrame, axes: list[list[float]]) -> DataFrame:
    rows = [(t, d, float(x)) for t, axis in enumerate(axes) for d, x in enumerate(axis)]  # k x dimension numbers
    return df.sparkSession.createDataFrame(rows, "topic int, dim int, score double")


def _pca(objects: DataFrame, k: int, seed: int, iterations: int):
    features = objects.select("id", array_to_vector("vec").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(features).transform(features)
    model = PCA(k=k, inputCol="centred", outputCol="out").fit(centred)
    axes = model.pc.toArray().T.tolist()
    return model.transform(centred).select("id", vector_to_array("out").alias("vec")), _components(objects, axes)


#: Dimensions up to which the driver decomposes the product of the vectors' columns; more are an error.
WIDEST = 4_096


def _gram(objects: DataFrame) -> np.ndarray:
    """The sum of vec' vec over all vectors: partial sums in Arrow batches, dimension x dimension numbers on the driver."""
    width = objects.select(F.max(F.size("vec"))).first()[0] or 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} dimensions; {WIDEST} at most")

    def partial(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
            if len(x):
                total += x.T @ x
        yield pd.DataFrame({"row": np.arange(width), "products": list(total)})

    rows = objects.select("vec").mapInPandas(partial, "row int, products array<double>").select("row", F.posexplode("products").alias("k", "x"))
    out = np.zeros((width, width))
    for r in rows.groupBy("row", "k").agg(F.sum("x").alias("x")).collect():
        out[r.row, r.k] = r.x
    return out


def _signed(axes: np.ndarray) -> list[list[float]]:
    """Axes (rows) turned so that the largest entry of each, by absolute value, is positive."""
    return [(a * (1.0 if a[np.abs(a).argmax()] >= 0 else -1.0)).tolist() for a in axes]


def _svd(objects: DataFrame, k: int, seed: int, iterations: int):
    axes = _signed(np.linalg.eigh(_gram(objects))[1].T[::-1][:k])
    return _projected(objects, axes), _components(objects, axes)


def _nonnegative(cross: np.ndarray, gram: np.ndarray, start: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Rows w >= 0 that minimise |x - w h|, given x h' (cross) and h h' (gram), by coordinate descent over all rows at once."""
    w = start.copy()
    for _ in range(rounds):
        for r in np.flatnonzero(np.diag(gram) > 1e-12):
            w[:, r] = np.maximum(0.0, w[:, r] + (cross[:, r] - w @ gram[:, r]) / gram[r, r])
    return w


def _nmf(objects: DataFrame, k: int, seed: int, iterations: int):
    """Alternating non-negative least squares. Rows of the left factor are solved where the vectors lie, from the right factor
    alone; each round sends back sums of k x dimension and k x k numbers."""
    width = objects.select(F.max(F.size("vec"))).first()[0] or 0
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (k, width))

    def solved(pdf: pd.DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
        return x, _nonnegative(x @ h.T, h @ h.T, np.full((len(x), len(h)), 0.1))

    def sums(h: np.ndarray):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x, w = solved(pdf, h)
                    yield pd.DataFrame({"v": [np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])]})

        parts = objects.select("vec").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("p", "x"))
        return [r.x for r in parts.groupBy("p").agg(F.sum("x").alias("x")).orderBy("p").collect()]

    for _ in range(iterations if width else 0):
        got = np.array(sums(h))
        cross, gram = got[: k * width].reshape(k, width), got[k * width :].reshape(k, k)
        h = _nonnegative(cross.T, gram, h.T).T

    def apply(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": list(solved(pdf, h)[1]) if len(pdf) else []})

    held = objects.select("id", "vec").mapInPandas(apply, f"id {dict(objects.dtypes)['id']}, vec array<double>")
    return held, _components(objects, h.tolist())


def _lda(objects: DataFrame, k: int, seed: int, iterations: int):
    features = objects.select("id", array_to_vector("vec").alias("features"))
    model = LDA(k=k, maxIter=iterations, seed=seed).fit(features)
    axes = model.topicsMatrix().toArray().T.tolist()
    return model.transform(features).select("id", vector_to_array("topicDistribution").alias("vec")), _components(objects, axes)


def topic_terms(components: DataFrame, names: DataFrame, top: int | None = None) -> DataFrame:
    """topic, rank, term, score: terms by falling score. names: dim, term."""
    order = W.partitionBy("topic").orderBy(F.col("score").desc(), "dim")
    out = components.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.join(names, "dim").select("topic", "rank", "term", "score")


def sim_rows(sim: DataFrame) -> DataFrame:
    """The rows of a similarity table (i, j, score) as vectors (id, vec), columns in id order, as similarities in [0, 1]."""
    item = F.struct("j", ((F.col("score") + 1) / 2).alias("s"))
    return sim.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("vec"))
