"""Clustering: latent arg-max, k-means, Laplacians, and spectral clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax

#: Nodes up to which spectral() computes eigenvectors, in one task; more are an error.
LOCAL_NODES = 5_000


def column_scaled(latent: DataFrame) -> DataFrame:
    """Vectors (id, vec) with every column mapped to [0, 1]; a constant column becomes 0."""
    long = latent.select("id", F.posexplode("vec").alias("dim", "x"))
    bounds = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    held = bounds.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("b")).first()  # one row for each latent column
    bounds_of = held.b or []
    lo, hi = (F.array(*[F.lit(float(b[name])) for b in bounds_of]) if bounds_of else F.array().cast("array<double>") for name in ("lo", "hi"))
    scaled = F.transform("vec", lambda x, i: F.coalesce(F.try_divide(x - F.get(lo, i), F.get(hi, i) - F.get(lo, i)), F.lit(0.0)))
    return latent.select("id", scaled.alias("vec"))


def latent_clusters(latent: DataFrame, scale: bool) -> DataFrame:
    """object_id, cluster: the place of the largest latent value, after scaling the columns if asked for."""
    return (column_scaled(latent) if scale else latent).select(F.col("id").alias("object_id"), argmax(F.col("vec")).alias("cluster"))


def kmeans(objects: DataFrame, k: int, seed: int = 1, rounds: int = 100) -> DataFrame:
    """object_id, cluster by Lloyd's rounds from random rows. k must not be larger than the number of objects."""
    features = objects.select("id", array_to_vector("vec").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="random").fit(features)
    return model.transform(features).select(F.col("id").alias("object_id"), F.col("prediction").alias("cluster"))


def kmeans_from(objects: DataFrame, centres: list[list[float]], rounds: int) -> DataFrame:
    """object_id, cluster after a fixed number of Lloyd's rounds from given centres. An empty cluster keeps its centre; equal
    distances go to the first centre. Only the centres, k vectors, are held by the driver."""
    def assigned(c: np.ndarray) -> DataFrame:
        def run(batches):
            for pdf in batches:
                x = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
                d = np.array([((x - row) ** 2).sum(1) for row in c])
                yield pd.DataFrame({"object_id": pdf["id"], "cluster": np.round(d, 9).argmin(0).astype(np.int32)})

        return objects.select("id", "vec").mapInPandas(run, f"object_id {dict(objects.dtypes)['id']}, cluster int")

    c = np.array(centres, np.float64)
    for _ in range(rounds):
        met = assigned(c).join(objects.select(F.col("id").alias("object_id"), "vec"), "object_id").select("cluster", F.posexplode("vec").alias("dim", "x"))
        for r in met.groupBy("cluster", "dim").agg(F.avg("x").alias("x")).collect():
            c[r.cluster, r.dim] = r.x
    return assigned(c)


def adjacency(sim: DataFrame, least: float) -> DataFrame:
    """i, j, w: the scores of at least `least`; smaller ones are no edges."""
    return sim.where(F.col("score") >= least).select("i", "j", F.col("score").alias("w"))


def laplacian(edges: DataFrame, normalised: bool) -> DataFrame:
    """i, j, l: the Laplacian D - A, or I - D^-1/2 A D^-1/2, where it is not zero by absence. edges hold their diagonal."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("d"))
    met = edges.join(degree, "i").join(degree.withColumnRenamed("i", "j").withColumnRenamed("d", "dj"), "j")
    one = F.when(F.col("i") == F.col("j"), F.col("d") if not normalised else F.lit(1.0)).otherwise(0.0)
    part = F.coalesce(F.try_divide(F.col("w"), F.sqrt(F.col("d") * F.col("dj"))), F.lit(0.0)) if normalised else F.col("w")
    return met.select("i", "j", (one - part).alias("l"))


def embedding(matrix: np.ndarray, k: int) -> np.ndarray:
    """The eigenvectors of the k smallest eigenvalues of a symmetric matrix, as columns."""
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, :k]


def power_iteration(sim: DataFrame, k: int, least: float, rounds: int = 20) -> DataFrame:
    """object_id, cluster by power iteration on the similarities of at least `least`; a node without an edge has no row."""
    edges = adjacency(sim, least).where("w > 0")
    got = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="i", dstCol="j", weightCol="w").assignClusters(edges)
    return got.select(F.col("id").cast(dict(sim.dtypes)["i"]).alias("object_id"), "cluster")


def spectral(sim: DataFrame, k: int, least: float, normalised: bool = True, seed: int = 1) -> DataFrame:
    """object_id, cluster: k-means on the rows of the spectral embedding. The eigenvectors are exact, and computed in one task: more
    than LOCAL_NODES nodes are an error (power_iteration() is another method, for graphs of any size)."""
    edges = adjacency(sim, least)
    n = sim.select("i").distinct().count()
    kind = dict(sim.dtypes)["i"]
    if n > LOCAL_NODES:
        raise ValueError(f"spectral() takes {LOCAL_NODES} nodes at most, not {n}; power_iteration() takes any number")
    nodes = sim.select(F.col("i").alias("node")).distinct().withColumn("one", F.lit(1))
    cells = laplacian(edges, normalised).withColumn("one", F.lit(1))

    def embed(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(own.node.to_numpy())
        full = np.zeros((len(ids), len(ids)))
        full[np.searchsorted(ids, part.i.to_numpy()), np.searchsorted(ids, part.j.to_numpy())] = part.l.to_numpy()
        return pd.DataFrame({"id": ids, "vec": embedding(full, k).tolist()})

    rows = cells.groupBy("one").cogroup(nodes.groupBy("one")).applyInPandas(embed, f"id {kind}, vec array<double>")
    return kmeans(rows, k, seed)
